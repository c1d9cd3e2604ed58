import random

import corpus_pipeline
from tessera.llm import minhash
from tessera.llm.shared import durable


def test_near_dedup_links_from_080(spark):
    """A pair at 51/61 is linked in the pipeline; bands miss few pairs at either threshold."""
    words = [f"w{k}" for k in range(60)]
    near = [*words[:30], "other", *words[31:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "something else")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert (minhash.rows_for(85), minhash.rows_for(80)) == (minhash.ROWS, 5)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Null and repeated ids against brute force: copies under one id, a namesake of a dropped row, rows without an id."""
    rng = random.Random(7)
    prose = lambda: " ".join(f"v{rng.randrange(500)}" for _ in range(60))
    a, b, c, d = (prose() for _ in range(4))
    near = a.replace(a.split()[30], "other")
    rows = [(1, a), (1, a), (5, near), (5, b), (None, c), (None, c), (None, d), (2, d), (None, ""), (None, None), (3, "")]
    docs = durable(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(max(0, len((t or "").split()) - 4))} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [min((r for r, g in zip(rows, group, strict=True) if g == one), key=key) for one in set(group)]
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
