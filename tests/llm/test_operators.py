"""Each operator against brute force, on a small fixture with nulls, blanks, copies, repeated ids and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import bpe, decontaminate, html, lines, minhash, quality, queries, repeats, suffixes, tokens, urls
from tessera.llm.hashing import PerfectHash
from tessera.llm.suffixes import refine

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept boolean, rest string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(300), prose(70), "A line that many Documents hold, é " + prose(4)
    texts = [None, "", " \n\t ", "one", "two words", "one", base, base, base.upper(), "a " * 200, "aaaa" * 300, "\n".join([line] * 3), "x\n \n" + line + "  \ny", "日本語 " * 40]
    for _ in range(25):
        words = base.split()
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(6)]
    texts += [f"{prose(12)}\n{lower(line)}\n{prose(9)}" for _ in range(5)]
    texts += [prose(rng.randint(5, 150)) for _ in range(20)]
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, True, "z") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_likelihood_keeps_similar_sets():
    rng = np.random.default_rng(1)
    regs = []
    for _ in range(40):
        both = rng.integers(0, 2**63, 920, dtype=np.uint64)
        for _ in range(2):
            keys = np.sort(np.concatenate([both, rng.integers(0, 2**63, 80, dtype=np.uint64)]))
            regs.append(minhash.registers(keys, np.array([0, 1000])))
    a, b = np.concatenate(regs[::2]), np.concatenate(regs[1::2])
    n = np.full(40, 1000)
    assert minhash.doubtful(a, b, n, n, 85).all()
    assert not minhash.doubtful(a[:-1], a[1:], n[1:], n[1:], 85).any()
    assert (minhash.merge(a, b) >= a).all()


def test_decontamination(spark, docs, rows):
    items = [(1, rows[6][1][:200]), (2, "two words"), (3, None), (4, ""), (5, "TWO, words!"), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    expected = {}
    for i, t, *_ in rows:
        w, hit, found = word.findall(lower(t or "")), set(), set()
        for x, who in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= who
        expected[i] = (len(w), len(hit), sorted(found))
    for size in (1 << 20, 30):  # one automaton, and several
        got = by_id(decontaminate.decontaminate(docs, bench, nodes=size))
        assert {i: (r["n_words"], r["n_hit"], sorted(r["items"])) for i, r in got.items()} == expected
        kept = decontaminate.clean(docs, bench, nodes=size)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in expected.items() if not x[1]}


def test_token_shards(spark, docs, rows):
    from tokenizers import Tokenizer

    lib, at, expected = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    more = [*rows, (rows[0][0], "again", True, "z"), (None, "no id", True, "z")]
    for i, t, *_ in sorted(more, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    some = spark.createDataFrame(more, SCHEMA)
    folder = tokens.new_folder(some)
    tokens.write_shards(some, P.path("word_bpe_49k.json"), folder)
    got = tokens.read_shards(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64))
    for n in (0, 1, 2, 100, len(keys)):
        index = PerfectHash(keys[:n])
        again = PerfectHash.from_bytes(index.to_bytes())
        assert sorted(index.slot(keys[:n]).tolist()) == list(range(n)) == sorted(again.slot(keys[:n]).tolist())


def test_repeats(docs, rows):
    count, words = collections.Counter(), {i: WORD.findall(t or "") for i, t, *_ in rows}
    for w in words.values():
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    expected = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        expected[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {i: (r["n_words"], r["n_removed"], r["text"]) for i, r in by_id(repeats.dedup_repeats(docs)).items()} == expected


def test_quality(spark, docs, rows):
    got = by_id(quality.judge(docs, None))
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        some = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        expected = (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(some) - len(set(some)), len(twice), failed, 1.0, not failed)
        assert tuple(got[i]) == expected


def test_trees_learn_and_keep_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) > 0.6).astype(float)
    model = quality.fit(x[:1500], y[:1500], monotone=[1, 0, -1])
    assert ((model.score(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.93
    grid = np.repeat(x[:50], 20, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.score(grid).reshape(50, 20), axis=1) >= -1e-12).all()


def test_lines(docs, rows):
    holders = collections.defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\r\x0b\x0c"))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    expected = {}
    for i, t, *_ in rows:
        old = (t or "").split("\n")
        new = [x for x in old if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        expected[i] = (len(old), len(old) - len(new), "\n".join(new))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in by_id(lines.dedup_lines(docs)).items()} == expected
    kept = lines.with_unique_lines(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: (r["text"], r["rest"]) for r in kept.collect()} == {i: (x[2], "z") for i, x in expected.items()}


def test_urls(spark):
    cases = [
        ("http://A.Example.com/en/7", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://example.com/en/9?x", "example.com", "/en/9", "com/en/", "block"),
        ("http://xcom/en/9", "xcom", "/en/9", None, "allow"),
        ("https://example.net/de/80#a", "example.net", "/de/80", "example.net/de/8", "block"),
        ("x://b.net/de/1", "b.net", "/de/1", "net/de/", "block"),
        ("x://b.net/DE/1", "b.net", "/DE/1", None, "allow"),
        ("http://free-bets.example.org/fr/", "free-bets.example.org", "/fr/", None, "block"),
        ("http://alphabets.example.org/", "alphabets.example.org", "/", None, "allow"),
        ("http://h?/com/en/", "h", "", None, "allow"),
        ("no scheme com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    got = urls.judge(spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(cases)], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]


def test_bpe(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoder(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    got = by_id(bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN))
    for i, t, *_ in rows:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == lib.encode_ordinary(t or "") and got[i]["data"].decode() == (t or "")
    rng = random.Random(4)
    odd = [" ", "  ", "\n", "a", "é", "1", ".", "'s", "\t", "the", "\u0301", "ß", "\x1c", "\x85", "\u00a0", "aaaa"]
    for _ in range(3000):
        t = "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode_ordinary(t)


def test_html(spark):
    article = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a>Home</a></nav><article><h1>Caf&eacute; &amp; co</h1><p><b>One<br> two\n three</p><div class='comments'><p>nice</div><form>go</form><p>Last</article><footer>foot</footer>"
    plain = "<body><div>repeated words that stand on every page of it</div><p>own text {}</p>"
    pages = [(0, "http://h/0", article), (1, "http://h/1", None), (2, None, ""), *((k, f"http://h/{k}", plain.format(k)) for k in range(3, 8))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "Café & co\n\nOne two three\n\nLast" and got[1] == got[2] == ""
    assert all(got[k] == f"own text {k}" for k in range(3, 8))


def test_html_in_groups(spark):
    """A large host is dealt into groups; copies, repeated rows, a null id and pages with an article come through whole."""
    plain = "<body><div>the same notice is put on all pages</div><p>only page {} says this</p><p>short</p>"
    page = "<nav>Menu</nav><article><p>the same notice is put on all pages</p></article>"
    pages = [(k, f"http://big/{k}", plain.format(k)) for k in range(40)] + [(100 + k, "http://big/0", plain.format(0)) for k in range(3)]
    pages += [(50, "http://big/50", page), (50, "http://big/50", page), (None, "http://big/51", plain.format(51)), (60, "http://small/", plain.format(60))]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = html.extract(df, group=12).collect()
    assert len(got) == len(pages)
    text = {p: f"only page {p if p is not None else 51} says this" for p, _, _ in pages} | {100 + k: "only page 0 says this" for k in range(3)}
    for r in got:
        if r["page_id"] == 50:
            assert r["text"] == "the same notice is put on all pages"
        elif r["page_id"] == 60:  # its host has no other page
            assert r["text"] == "the same notice is put on all pages\n\nonly page 60 says this\n\nshort"
        else:
            assert r["text"] == text[r["page_id"]], r


def test_html_counts_runs_over_all_groups_of_a_host(spark):
    """A run is judged by its distinct pages on the whole host; copies that land in several groups are one page."""
    often, twice = "this box stands on three of the pages", "and that box stands on two of the pages only"
    page = lambda k: f"<body><p>only page {k} says this</p>" + (f"<div>{often}</div>" if k in (3, 17, 31) else "") + (f"<div>{twice}</div>" if k in (5, 23) else "")
    pages = [(k, f"http://big/{k}", page(k)) for k in range(40)] + [(100 + k, "http://big/5", page(5)) for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole, dealt = ({r["page_id"]: r["text"] for r in html.extract(df, group=g).collect()} for g in (1000, 4))
    assert dealt == whole
    assert all(dealt[k] == f"only page {k} says this" for k in (3, 17, 31))
    assert all(dealt[k].endswith(twice) for k in (5, 23, *range(100, 120)))


def test_suffixes(docs, rows):
    first, expected = set(), {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if b[k : k + 50] in first:
                gone[k : k + 50] = True
        first.update(b[k : k + 50] for k in range(len(b) - 49))
        expected[i] = (len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    assert {i: tuple(r)[1:4] + (bytes(r["data"]),) for i, r in by_id(suffixes.dedup_suffixes(docs)).items()} == expected


def test_bucket_pointer_refinement():
    data = np.frombuffer(b"abracadabra" * 30 + bytes(range(200)), dtype=np.uint8)
    at = np.arange(len(data) - 50)
    bucket = refine(data, at, 50)
    text = data.tobytes()
    assert len({(b, text[i : i + 50]) for i, b in zip(at.tolist(), bucket.tolist(), strict=True)}) == len(set(bucket.tolist())) == len({text[i : i + 50] for i in at})


def test_empty_tables(spark, docs):
    none = docs.where("doc_id < 0")
    path = P.path("byte_bpe_50k.tiktoken")
    folder = tokens.new_folder(none)
    bench = spark.createDataFrame([], "item_id long, text string")
    tokens.write_shards(none, P.path("word_bpe_49k.json"), folder)
    for out in (
        minhash.near_duplicates(none), decontaminate.decontaminate(none, bench), decontaminate.decontaminate(docs, bench).where("n_hit > 0"), repeats.dedup_repeats(none), suffixes.dedup_suffixes(none), lines.dedup_lines(none),
        quality.judge(none, None), bpe.encode(none, path, P.PATTERN), tokens.read_shards(spark, folder), bpe.digests(none, path, P.PATTERN), quality.keep(none, None), decontaminate.clean(none, bench), lines.with_unique_lines(none),
        urls.judge(spark.createDataFrame([], "page_id long, url string")), html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0
    assert quality.fit_on(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_repeated_rows_and_null_ids(spark):
    text = "words of a document that come again and again in the same order " * 6
    some = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(some).collect()) == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]
    for f in (repeats.dedup_repeats, suffixes.dedup_suffixes, lines.dedup_lines):
        assert f(some).count() == 4


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (queries._table(spark, sf, n) for n in ("documents", "labels"))
    trees = quality.fit_on(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.95
