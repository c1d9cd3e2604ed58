"""Main-text extraction from HTML with a suffix array per host.

A page is cut into text blocks; markup tells which blocks stand in an article, which in menus, forms and
the like, and which are undecided.  The word streams of a host's pages are laid end to end and their
suffixes sorted; word runs that repeat across distinct pages are boilerplate.  What they cover of
undecided blocks is removed where the runs stand on ``PAGES`` pages.  Inside articles texts repeat for
good reasons, quotations and copies among them, so there a block goes only if runs cover the whole of it
that stand in more than half of the host's distinct articles, of which there must be ``ARTICLES``; copies
of an article are one.  A page's text is its article's blocks that stay or, without an article element,
what is left of its undecided blocks.

A host may hold a third of all pages: its pages are dealt into groups of about ``GROUP`` pages and
``GROUP_BYTES`` at most, each with a suffix array of its own.  The groups' runs and their distinct
pages are summed over the host, so a run is judged by all pages of the host, however it is dealt.

Cases: a null or empty page has no text; unclosed and misnested tags end with the block or container
around them, or where a new block implies their end; equal rows have equal results, and their copies
count as one page; a page whose host is empty is grouped with its like; null ids are ids like others; an
empty table gives none; columns besides id, url and html are not looked at; a very long page is parsed
whole by one worker.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import Joined, Slices, mix
from tessera.llm.shared import column, durable, free, size_batches, trim
from tessera.llm.suffixes import refine
from tessera.llm.urls import host_and_path

#: Pages of one host in a suffix array and bytes of their html, about.
GROUP, GROUP_BYTES = 1500, 8 << 20
#: Hosts of more than one group whose sizes are broadcast, at most: some megabytes.
LARGE_HOSTS = 50_000
#: Words of a repeated run, and distinct pages it must stand on, to be boilerplate outside articles.
RUN, PAGES = 6, 3
#: Distinct articles that a host must have for a block inside articles to be boilerplate, which more than half of them hold.
ARTICLES = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is not text of the page, up to the first end tag.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
#: The same, but they nest.
NESTED = {"template", "svg", "object", "math", "canvas", "audio", "video"}
#: Elements that hold something other than the article; those in WRAPS may wrap an article as well.
APART = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset"}
WRAPS = {"nav", "header", "form", "head", "fieldset"}
#: Inline elements; all others begin and end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open element whose end a new element implies, up to the container around both.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Words of class, id and role that mark something other than the article.
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "widget", "complementary", "contentinfo",
}
#: Words that may stand beside those in one name, as in ``comment-list``; any other makes it a name of its own, as in ``related-work``.
NEUTRAL_WORDS = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "desktop", "fixed", "form", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile",
    "outer", "page", "panel", "primary", "right", "section", "secondary", "site", "slot", "sticky", "sub", "text", "thread", "top", "unit", "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=\d)")


def _apart(token: str) -> bool:
    """Whether a class, id or role marks something other than the article: by all of its words."""
    parts = [p for p in _PARTS.split(token) if p and not p.isdigit()]
    return any(p in APART_WORDS for p in parts) and all(p in APART_WORDS or p in NEUTRAL_WORDS for p in parts)


def _marks(rest: str) -> tuple[bool, bool]:
    """Whether class, id or role mark something apart, and whether the role is main."""
    apart = main = False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        tokens = (a or b or c).lower().split()
        apart = apart or any(map(_apart, tokens))
        main = main or (name.lower() == "role" and tokens == ["main"])
    return apart, main


def _skip(page: str, name: str, at: int) -> int:
    """Where an element's content ends, whose end tag closes it: the first one, or for elements that nest the one of its depth."""
    tags = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I)
    depth = 1
    for m in tags.finditer(page, at):
        if m[1]:
            depth -= 1
        elif name in NESTED and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def blocks(page: str) -> tuple[list[tuple[int, str]], bool]:
    """(zone, text) of each block in page order, and whether the page has an article element.

    Zones: 0 undecided, 1 article, 2 apart (markup rules it out).
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, zone, and whether an article inside is one all the same
    plain: list[str] = []
    has_article, zone, at = False, 0, 0

    opened: Counter = Counter()

    def pop(name: str) -> None:
        """Close elements up to one of this name."""
        while True:
            got = stack.pop()[0]
            opened[got] -= 1
            if got == name:
                return

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(plain)).replace("\0", "")).strip()
        plain.clear()
        if text:
            out.append((zone, text))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        plain.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        empty = m["rest"].rstrip().endswith("/")
        if name in RAW or name in NESTED:
            if not m["close"] and not empty:
                at = _skip(page, name, at)
            continue
        if name in INLINE or (name in VOID and name != "hr"):
            if name == "br":
                plain.append(" ")
            continue
        flush()
        if m["close"]:
            if opened[name]:
                pop(name)
            zone = stack[-1][1] if stack else 0
            continue
        if stack and stack[-1][0] == "p":  # a paragraph ends where another block begins
            pop("p")
        ends = IMPLIED.get(name, ())
        if any(opened[e] for e in ends):
            holds = _HOLDS.get(name, {"table"})
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in holds), -1) + 1
            k = next((i for i in range(k, len(stack)) if stack[i][0] in ends), len(stack))
            while len(stack) > k:
                pop(stack[-1][0])
        zone, wraps = stack[-1][1:] if stack else (0, False)
        if name == "hr" or empty:
            continue
        apart, main = _marks(m["rest"]) if m["rest"] else (False, False)
        inner, inner_wraps = zone, wraps
        if name in ("article", "main") or main:
            if (zone != 2 or wraps) and not apart:
                inner, inner_wraps, has_article = 1, False, True
        elif zone != 2:
            if (name in APART and not (name == "header" and zone == 1)) or (apart and not (zone == 1 and name in HEADINGS)):
                inner, inner_wraps = 2, name in WRAPS and not apart
        stack.append((name, inner, inner_wraps))
        opened[name] += 1
        zone = inner
    plain.append(page[at:])
    flush()
    return out, has_article


class Streams:
    """Word streams of pages' blocks, end to end.

    Each block is followed by a negative token that no other block has, so that no run goes beyond its
    block.  The tokens of a block shorter than a run carry its whole text: such blocks repeat whole or
    not at all.
    """

    def __init__(self, texts: list[str], page: list[int]):
        """``page`` is the number of each block's page, ascending."""
        joined = Joined([t.encode() for t in texts])
        words = joined.word_hashes()
        self.n_words = joined.n_words
        sizes = np.maximum(self.n_words, RUN) + 1
        self.begin = np.cumsum(sizes) - sizes
        block = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(block)) - self.begin[block]
        data = -1 - block
        whole = Slices(joined.data).hash(joined.begin, joined.end)
        inside = place < sizes[block] - 1
        short = inside & (self.n_words[block] < RUN)
        long = inside & ~short
        data[short] = (mix(whole[block[short]] + place[short].astype(np.uint64), 91) >> np.uint64(1)).astype(np.int64)
        data[long] = (words[joined.first[block[long]] + place[long]] >> np.uint64(1)).astype(np.int64)
        self.data, self.page = data, np.array(page, dtype=np.int64)[block] if len(texts) else block
        ends = np.concatenate([[0], np.cumsum(data < 0)])
        self.at = np.flatnonzero(ends[RUN:] == ends[:-RUN]) if len(data) >= RUN else np.zeros(0, np.int64)  # where runs begin
        self.sizes = sizes

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bucket of each run in the suffix array, and the buckets' distinct pages, as pairs."""
        bucket = refine(np.unique(self.data, return_inverse=True)[1].astype(np.int64), self.at, RUN, gram=1)
        pairs = np.unique(np.stack([bucket, self.page[self.at]], axis=1), axis=0)
        return bucket, pairs[:, 0], pairs[:, 1]

    def names(self, at: np.ndarray) -> np.ndarray:
        """A hash of the run at each place, the same in all groups."""
        return Slices(self.data.view(np.uint64)).hash(at, at + RUN).view(np.int64)

    def covered(self, hit: np.ndarray) -> list[np.ndarray]:
        """Which words of each block the runs that ``hit`` marks cover; all or none for short blocks."""
        edge = np.zeros(len(self.data) + 1, dtype=np.int64)
        at = self.at[hit]
        edge[at] += 1
        edge[at + RUN] -= 1
        mask = np.cumsum(edge[:-1]) > 0
        return [mask[b : b + n] for b, n in zip(self.begin.tolist(), np.maximum(self.n_words, 1).tolist(), strict=True)]


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its blocks (pressed, NUL between), their zones, and a hash of the article."""
    squeeze = zstandard.ZstdCompressor()
    for b in it:
        zones, texts, articles = [], [], []
        for page in b.column("html").to_pylist():
            some, has_article = blocks(page)
            zones.append(bytes(z for z, _ in some))
            texts.append(squeeze.compress("\0".join(t for _, t in some).encode()))
            articles.append(xxhash.xxh3_64_intdigest("\n".join(t for z, t in some if z == 1).encode()) - (1 << 63) if has_article else None)
        columns = {"zones": pa.array(zones, pa.binary()), "texts": pa.array(texts, pa.binary()), "article": pa.array(articles, pa.int64())}
        same = [c for c in b.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in same), *columns.values()], names=[*same, *columns])
    trim()


class Host:
    """The pages of a host or of a group of it: copies once, with streams outside and inside articles."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.key, self.article = table.column("key").to_numpy(), table.column("article").to_pylist()
        unzip = zstandard.ZstdDecompressor()
        self.zones = table.column("zones").to_pylist()
        self.texts = [unzip.decompress(x).decode().split("\0") if z else [] for x, z in zip(table.column("texts").to_pylist(), self.zones, strict=True)]
        first = np.unique(self.key, return_index=True)[1].tolist()
        self.outside, self.outside_at = self._stream(first, lambda z: z != 1)
        own = sorted({a: i for i, a in reversed(list(enumerate(self.article))) if a is not None}.values())
        self.inside, self.inside_at = self._stream(own, lambda z: z == 1)
        self.page_keys, self.article_keys = self.key[first], np.array([self.article[i] for i in own], dtype=np.int64)

    def _stream(self, rows: list[int], wanted) -> tuple[Streams, dict]:
        texts, page, at = [], [], {}
        for n, i in enumerate(rows):
            for k, z in enumerate(self.zones[i]):
                if wanted(z):
                    at[i, k] = len(texts)
                    texts.append(self.texts[i][k])
                    page.append(n)
        return Streams(texts, page), at

    def settle(self, outside: np.ndarray, inside: np.ndarray) -> pa.Table:
        """All pages' texts, given which runs are boilerplate."""
        out_words, in_words = self.outside.covered(outside), self.inside.covered(inside)
        page_of = {k: i for i, k in reversed(list(enumerate(self.key.tolist())))}
        article_of = {a: i for i, a in reversed(list(enumerate(self.article))) if a is not None}
        texts = []
        for i, (zones, own) in enumerate(zip(self.zones, self.texts, strict=True)):
            if self.article[i] is not None:
                # copies of an article are equal block for block, though not at the same places among the page's blocks
                first = article_of[self.article[i]]
                kept = [t for k, t in zip([k for k, z in enumerate(self.zones[first]) if z == 1], [t for z, t in zip(zones, own, strict=True) if z == 1], strict=True) if not in_words[self.inside_at[first, k]].all()]
            else:
                first, kept = page_of[int(self.key[i])], []
                for k, (z, t) in enumerate(zip(zones, own, strict=True)):
                    if z == 0:
                        gone = out_words[self.outside_at[first, k]]
                        kept.append(t if not gone.any() else "" if gone.all() else b" ".join(w for w, g in zip(t.encode().split(), gone.tolist(), strict=True) if not g).decode())
            texts.append("\n\n".join(t for t in kept if t))
        return pa.table({"page_id": self.table.column("page_id"), "url": self.table.column("url"), "text": pa.array(texts, pa.string())})


def _many(run_page: np.ndarray, bucket: np.ndarray, least: int) -> np.ndarray:
    """Which runs stand on ``least`` distinct pages; ``run_page`` has a bucket number for each page that holds it."""
    return (np.bincount(run_page, minlength=int(bucket.max()) + 1)[bucket] >= least) if len(bucket) else np.zeros(0, dtype=bool)


def _least(articles: int) -> int:
    """Distinct articles that a block must stand in to be boilerplate inside them."""
    return articles // 2 + 1 if articles >= ARTICLES else articles + 1


def _settle(table: pa.Table) -> pa.Table:
    """The text of a whole host's pages."""
    host = Host(table)
    hits = []
    for stream, least in ((host.outside, PAGES), (host.inside, _least(len(host.article_keys)))):
        bucket, run, _ = stream.runs()
        hits.append(_many(run, bucket, least))
    return host.settle(*hits)


COUNTED = "host string, dealt long, inside boolean, run long, pages long"
#: What a group is told: pages and articles that another group counts, and runs inside articles whose pages are asked for.
PAGE, ARTICLE, WANTED = 0, 1, 2


def _counter(again: bool):
    """Counts of a group's runs over its distinct pages or articles, less those that another group counts.

    At first: all runs outside articles; inside, those that stand in more than half of the group's
    articles, for one that stands in more than half of the host's does so in some group; and, with a
    null run, the number of the group's articles.  Again: the wanted runs inside articles.
    """

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        host, kind, what = Host(table), told.column("kind").to_numpy(), told.column("what").to_numpy()
        rows = []
        for inside, stream, keys in ((False, host.outside, host.page_keys), (True, host.inside, host.article_keys)):
            if again and not inside:
                continue
            bucket, runs, page = stream.runs()
            own = ~np.isin(keys, what[kind == (ARTICLE if inside else PAGE)])
            n = np.bincount(runs[own[page]], minlength=int(bucket.max(initial=-1)) + 1)
            some, one = np.unique(bucket, return_index=True)
            names, n = stream.names(stream.at[one]), n[some]
            if inside:
                keep = np.isin(names, what[kind == WANTED]) if again else 2 * n > own.sum()
                names, n = names[keep], n[keep]
                if not again:
                    rows.append((True, [None], [int(own.sum())]))
            rows.append((inside, names.tolist(), n.tolist()))
        host_name, dealt = (x.as_py() for x in key)
        size = sum(len(n) for _, _, n in rows)
        columns = [[host_name] * size, [dealt] * size, [i for i, _, n in rows for _ in n], [x for _, names, _ in rows for x in names], [x for _, _, n in rows for x in n]]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "dealt", "inside", "run", "pages"])

    return run


def _settle_known(table: pa.Table, known: pa.Table) -> pa.Table:
    """The text of a group's pages, given the host's boilerplate among the group's runs."""
    host = Host(table)
    inside, run = np.array(known.column("inside").to_pylist(), dtype=bool), known.column("run").to_numpy()
    return host.settle(*(np.isin(s.names(s.at), run[inside == i]) for s, i in ((host.outside, False), (host.inside, True))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """``page_id, url, text``, one row per input row; pages are parsed once and their blocks' texts, not html, are shuffled."""
    spark = pages.sparkSession
    size_batches(spark)
    host, _ = host_and_path(column(pages, url_col).cast("string"))
    page = F.coalesce(column(pages, html_col).cast("string"), F.lit(""))
    rows = pages.select(column(pages, id_col).alias("page_id"), column(pages, url_col).cast("string").alias("url"), page.alias("html"), host.alias("host"))
    of_id = rows.schema["page_id"].dataType.simpleString()
    need = F.ceil(F.greatest(F.count(F.lit(1)) / group, F.sum(F.octet_length("html")) / GROUP_BYTES)).cast("long")
    large = durable(rows.groupBy("host").agg(need.alias("groups")).where("groups > 1"))
    n_large = large.count()
    if n_large <= LARGE_HOSTS:  # beyond that many the hosts are joined, and AQE splits a large one
        large = F.broadcast(large)
    rows = rows.withColumn("key", F.xxhash64("url", "html"))
    blocks_of = f"page_id {of_id}, url string, host string, key long, %szones binary, texts binary, article long"
    schema, place = f"page_id {of_id}, url string, text string", ["host", "dealt"]
    small = rows.join(large, "host", "left_anti").select(rows.columns) if n_large else rows
    small = small.mapInArrow(_parse, blocks_of % "").groupBy("host").applyInArrow(_settle, schema)
    if not n_large:
        return small
    dealt = F.pmod(F.xxhash64("page_id", "key"), "groups").alias("dealt")
    big = durable(rows.join(large, "host").select("page_id", "url", "host", "key", dealt, "html").mapInArrow(_parse, blocks_of % "dealt long, "))
    # copies of a page or article may be dealt to several groups: one of these counts it
    keys = big.select("host", "dealt", F.lit(PAGE).alias("kind"), F.col("key").alias("what")).unionByName(big.where("article is not null").select("host", "dealt", F.lit(ARTICLE).alias("kind"), F.col("article").alias("what")))
    copies = keys.groupBy("host", "kind", "what").agg(F.collect_set("dealt").alias("at")).where("size(at) > 1")
    elsewhere = copies.select("host", F.explode("at").alias("dealt"), "kind", "what", F.array_min("at").alias("first")).where("dealt != first").select(*place, "kind", "what")
    elsewhere = durable(elsewhere)
    counted = durable(big.groupBy(*place).cogroup(elsewhere.groupBy(*place)).applyInArrow(_counter(False), COUNTED))
    free(spark)
    groups = counted.where("run is null")
    wanted = groups.select(*place).join(counted.where("inside and run is not null").select("host", F.col("run").alias("what")).distinct(), "host")
    wanted = durable(wanted.select(*place, F.lit(WANTED).alias("kind"), "what"))
    known = counted.where("not inside").groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("host", F.lit(False).alias("inside"), "run")
    known = counted.where("not inside").join(known, ["host", "inside", "run"], "left_semi").select(*place, "inside", "run")
    if wanted.limit(1).count():
        again = durable(big.groupBy(*place).cogroup(elsewhere.unionByName(wanted).groupBy(*place)).applyInArrow(_counter(True), COUNTED))
        articles = groups.groupBy("host").agg(F.sum("pages").alias("articles")).where(F.col("articles") >= ARTICLES)
        often = again.groupBy("host", "inside", "run").agg(F.sum("pages").alias("pages")).join(articles, "host").where(2 * F.col("pages") > F.col("articles"))
        known = known.unionByName(again.join(often, ["host", "inside", "run"], "left_semi").select(*place, "inside", "run"))
    known = durable(known)
    free(spark)
    return small.unionByName(big.groupBy(*place).cogroup(known.groupBy(*place)).applyInArrow(_settle_known, schema))
