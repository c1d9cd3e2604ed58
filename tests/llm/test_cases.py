"""Cases beyond the fixture: clashes of hashes, long texts in pieces, null and repeated ids, odd columns, what decides a result."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm import bpe, decontaminate, exchange, html, lines, minhash, quality, queries, repeats, suffixes, tokens, urls

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, `doc.x` string, rest string, batch long, kept boolean"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_suffixes(rows):
    first, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if b[k : k + 50] in first:
                gone[k : k + 50] = True
        first.update(b[k : k + 50] for k in range(len(b) - 49))
        out[i] = (len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def brute_repeats(rows):
    count, words = {}, {i: t.split() for i, t in rows}
    for w in words.values():
        for k in range(len(w) - 34):
            count[tuple(w[k : k + 35])] = count.get(tuple(w[k : k + 35]), 0) + 1
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.fixture(scope="module")
def long_rows():
    """Texts of several batches of 4,000 bytes that repeat each other and themselves, runs of one word among them."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(900)
    return [(5, shared + " " + prose(2500)), (2, prose(1200) + " " + shared[300:] + " tail"), (9, prose(30)), (7, "same " * 1500), (8, prose(700) + " " + prose(50) * 3), (11, ""), (12, prose(40))]


def test_long_texts_in_pieces(spark, long_rows):
    docs = frame(spark, long_rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["data"])) for r in suffixes.dedup_suffixes(docs, limit=4000).collect()}
    assert got == brute_suffixes(long_rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.dedup_repeats(docs, limit=4000).collect()}
    assert got == brute_repeats(long_rows)


def test_refinement_and_names_decide(spark, monkeypatch):
    """Without the buckets of later rounds nothing is removed: no hash of a whole string or window stands beside them."""
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(90)}" for _ in range(200))
    docs = frame(spark, [(1, text), (2, text)])
    removed = lambda f: sum(r["n_removed"] for r in f(docs).collect())
    assert removed(suffixes.dedup_suffixes) == len(text) and removed(repeats.dedup_repeats) == 400
    none = lambda part, got, keys: [np.zeros(len(g[0]), np.uint64) for g in got]
    monkeypatch.setattr(suffixes, "name_shared", none)
    monkeypatch.setattr(suffixes, "_refine", lambda part, got: none(part, got, 2))
    monkeypatch.setattr(repeats, "name_shared", none)
    assert removed(suffixes.dedup_suffixes) == removed(repeats.dedup_repeats) == 0


def test_names_agree_between_batches():
    """Equal substrings get equal interior symbols whatever stands around them, and runs are one symbol."""
    rng = np.random.default_rng(5)
    inner = rng.integers(1, 9, 400).astype(np.uint64)
    inner[100:160] = 7
    table: dict = {}
    parses = []
    for side in range(2):
        name = np.concatenate([rng.integers(1, 9, 50 + 13 * side).astype(np.uint64), inner, rng.integers(1, 9, 50).astype(np.uint64)])
        symbols = repeats.Symbols(name, np.arange(len(name)), np.array([0, len(name)]))
        for k in range(3):
            (_, _, columns), wanted = symbols.wanted(k)
            said = np.array([table.setdefault((k, *key), 1000 * (k + 1) + len(table)) for key in zip(*(c.tolist() for c in columns[:4]), strict=True)], dtype=np.uint64)
            symbols = symbols.named(wanted, said)
        inside = (symbols.start >= 90 + 13 * side) & (symbols.start < 400 + 13 * side)
        parses.append((symbols.name[inside].tolist(), (symbols.start[inside] - 13 * side).tolist()))
    assert parses[0] == parses[1] and max(np.diff(parses[0][1])) >= 59


def test_line_clashes(monkeypatch):
    """Lines that agree in the first 64 bits of their hash stay apart, in a batch and between batches."""

    def digest(key):
        own = xxhash.xxh3_64_intdigest(key)
        return (own % 3).to_bytes(8, "little") + own.to_bytes(8, "little")

    monkeypatch.setattr(lines.xxhash, "xxh3_128_digest", digest)
    texts = [b"a line that is long enough 1", b"a line that is long enough 2\na line that is long enough 1", b"a line that is long enough 3\nother text of ten or more", b"other text of ten or more"]
    asked = [lines._ask([i], [t], 10) for i, t in enumerate(texts)]
    bits = lines._answer([[*a[5][:4], a[5][4].astype(np.uint32)] for a in asked])
    several = [sorted((b[at] & 1).tolist()) for b, at in zip(bits, (a[4] for a in asked), strict=True)]
    assert several == [[1], [0, 1], [0, 1], [1]]


def test_odd_columns_and_equal_rows(spark):
    """A name with a dot, names that operators use themselves, a thousand equal rows, null ids."""
    text = "the same words stand here again and again in a row of no meaning at all"
    rows = [(1, text, "x", "r", 3, True)] * 500 + [(None, text, "y", None, None, None)] * 500 + [(2, text + " but more of them", "z", "s", 4, False), (3, None, None, None, None, None)]
    docs = frame(spark, rows, ODD).repartition(4)
    kept = lines.with_unique_lines(docs)
    assert kept.columns == docs.columns and kept.count() == 1002 and {r["doc.x"] for r in kept.collect()} == {"x", "y", "z", None}
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 1002 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (None, 1, False), (2, 2, True), (3, 3, True)}
    for f in (repeats.dedup_repeats, suffixes.dedup_suffixes, lambda d: quality.judge(d, None), lambda d: bpe.digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)):
        assert f(docs).count() == 1002
    bench = frame(spark, [(None, "again and again in a row"), (4, None), (5, "")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).where("n_hit = 6").count() == 1001
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == 1


def test_null_ids_link(spark):
    words = [f"w{k}" for k in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(7, " ".join(words)), (None, " ".join(near)), (None, "x " + " ".join(near)), (8, "alone " * 3)]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 7), (0, 7), (7, 7), (8, 8)]


def test_hubs_are_dealt_to_slices(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join([*words[: 2 * k], f"new{k}", *words[2 * k + 1 :]])) for k in range(40)] + [(100, " ".join(words))]
    assert {r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_benchmark_longer_than_an_automaton(spark):
    item = " ".join(f"q{k}" for k in range(300))
    docs = frame(spark, [(1, "a " + " ".join(f"q{k}" for k in range(95, 120)) + " b"), (2, "nothing")])
    for nodes in (1 << 20, 200):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, frame(spark, [(1, item)], "item_id long, text string"), nodes=nodes).collect()}
        assert got == {1: (25, ["1"]), 2: (0, [])}
    assert len(list(decontaminate._blocks(frame(spark, [(1, item)], "item_id long, text string"), "item_id", "text", 10, 200))) > 5


PAGES = [
    ("<article><p class='ad'>buy<p>real text</article>", "real text"),
    ("<article><section id='related-work'><p>cited</p></section><div class='search-tree'>tree</div><h2 class='side'>head</h2></article>", "cited\n\ntree\n\nhead"),
    ("<article>x<svg><svg></svg>junk</svg>y</article>", "xy"),
    ("<form><main><p>inside a form</p></main></form>", "inside a form"),
    ("<article><p>one</p><div class='comment-list'><article>a reader</article></div><p title=5\">two</p></article>", "one\n\ntwo"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><aside>no</aside>", "a\n\nb\n\nc\n\nd"),
    ("<title>t<body>lost", ""),
]


def test_markup(spark):
    rows = [(k, f"http://h{k}/", page) for k, (page, _) in enumerate(PAGES)]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, (_, text) in enumerate(PAGES)}


def _page(k):
    quoted = "a sentence that a third of the pages quote" if k % 3 == 0 else f"and nothing on {k}"
    return f"<article><p>own words of page {k}</p><p>share this text with all of your friends</p><p>{quoted}</p></article>"


def _own(k):
    return f"own words of page {k}\n\n" + ("a sentence that a third of the pages quote" if k % 3 == 0 else f"and nothing on {k}")


def test_repeats_decide_inside_articles(spark):
    """What more than half of a host's articles hold goes, however the host is dealt; a sentence that some share stays."""
    rows = [(k, f"http://h/{k}", _page(k)) for k in range(24)] + [(100 + k, f"http://few/{k}", _page(k)) for k in range(4)]
    df = frame(spark, rows, "page_id long, url string, html string")
    for group in (1000, 6):
        got = {r["page_id"]: r["text"] for r in html.extract(df, group=group).collect()}
        assert {k: got[k] for k in range(24)} == {k: _own(k) for k in range(24)} and "share this text" in got[100]


def test_without_the_suffix_array_texts_differ(monkeypatch):
    pages = {"page_id": list(range(24)), "url": [f"http://h/{k}" for k in range(24)], "host": ["h"] * 24, "key": list(range(24)), "html": [_page(k) for k in range(24)]}
    parsed = lambda: pa.Table.from_batches(list(html._parse(iter([pa.RecordBatch.from_pydict(pages)]))))
    assert html._settle(parsed()).column("text").to_pylist() == [_own(k) for k in range(24)]
    monkeypatch.setattr(html, "refine", lambda symbols, at, depth, gram: np.arange(len(at)))  # no two runs in one bucket
    assert all("share this text" in t for t in html._settle(parsed()).column("text").to_pylist())


def test_rules_are_found_by_bucket(spark):
    rules = [urls.Rule(f"w{k}.example.com/p{k}", "block") for k in range(600)] + [urls.Rule("zip", "block", urls.EXTENSION), urls.Rule("wp-login.php", "block", urls.SEGMENT)]
    cases = [(1, "http://a.w7.example.com/p7x"), (2, "http://w7.example.com/p8"), (3, "http://h/a.zip"), (4, "http://h/wp-login.php?x"), (5, "http://h/a.zip/b"), (6, "http://wp-login.php/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(frame(spark, cases, "page_id long, url string"), rules).collect()}
    assert got == {1: ("w7.example.com/p7", "block"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow")}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé' \n\t日1.!B\u3000\x1c", max_size=60))
def test_chunks_do_not_change_ids(text):
    enc = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == _tiktoken().encode_ordinary(text)
    assert enc.chunks and not bpe.begins_at_space(r"\w+ \w+|.")


def _tiktoken():
    ranks = bpe.load_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_other_patterns_and_a_megabyte_without_a_break():
    ranks = bpe.load_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    own, lib = bpe.Encoder(ranks, r"[\s\S]+"), tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert np.frombuffer(own.encode("one two  three"), "<u4").tolist() == lib.encode_ordinary("one two  three")
    text = "".join(random.Random(2).choice("abcdefghij") for _ in range(200_000))
    ids = bpe.Encoder(ranks, P.PATTERN).encode(text)
    assert bpe.Encoder(ranks, P.PATTERN).decode(ids) == text.encode() and len(ids) // 4 < 150_000


def test_tokenizer_that_splits_at_space():
    import json

    config = json.load(open(P.path("word_bpe_49k.json")))
    assert tokens.splits_at_space(config) and not tokens.splits_at_space(json.load(open(P.path("byte_bpe_50k.json"))))
    config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] += r"|\s+x"
    assert not tokens.splits_at_space(config)


def test_registered_bpe_and_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lib, want = _tiktoken(), {}
    for r in docs:
        ids = np.array(lib.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        want[r["doc_id"]] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in queries.queries()["op8_byte_bpe"](spark, SF).collect()} == want
    got = sorted(map(tuple, queries.queries()["op3_token_shards"](spark, SF).collect()))
    assert len(got) == len(docs) and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def walk(trees, x):
    """The trees, one row and one node at a time."""
    total = trees.start
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_registered_quality_and_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = quality.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in queries.queries()["op5_quality_rules"](spark, SF).collect():
        _, x = quality.statistics([texts[r["doc_id"]]])
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and walk(trees, x[0]) >= 0)
    import html as entities
    import re

    plain = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():  # these pages: one article of headings and paragraphs, some not closed
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        plain[r["page_id"]] = "\n\n".join(x for x in parts if x)
    assert {r["page_id"]: r["text"] for r in queries.queries()["op9_html_extraction"](spark, SF).collect()} == plain


def test_pipeline_against_its_parts(spark, tmp_path):
    """All five stages over a small table: what is left is what plain code keeps, null and repeated ids included."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(n))
    a, b, leak, line = prose(60), prose(50), prose(12), "a line that stands in many documents"
    rows = [(1, a), (2, a + " more"), (3, f"{b}\n{line}"), (4, f"{prose(40)}\n{line}"), (None, prose(45)), (5, "too short"), (6, prose(20) + " " + leak + " " + prose(20)), (7, None), (8, "so " * 40), (9, prose(30)), (9, prose(30))]
    frame(spark, [(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {(i, t) for i, t in rows}
    texts = {(i, t) for i, t in texts if t and len(t.split()) >= 10 and len(set(t.split())) > 2} - {(2, a + " more")}
    texts = {(i, t.replace("\n" + line, "") if i == 4 else t) for i, t in texts if leak not in t}
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in texts)
    assert sorted(r["decoded_sha256"] for r in got) == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns and stage(spark, empty, str(tmp_path)).count() == 0


def test_batches_are_spread(spark):
    """Rows of batches are light, and yet go to as many tasks as their texts are worth."""
    docs = frame(spark, [(k, f"{k} text " * 400) for k in range(64)])
    packed = exchange.pack(docs, limit=4000, apart=True)
    told = packed.route(lambda b: ([(np.arange(3, dtype=np.uint64) << np.uint64(60), [np.arange(3)])], None), lambda part, _, got: [g[0] + 1 for g in got], [["<i8"]], ["<i8"], 1, "probe")
    assert packed.answered().rdd.getNumPartitions() >= 16 and told.parts >= 16
