"""Near-duplicate components from SetSketch registers, banded, estimated by likelihood, then verified.

Each text is the set of its distinct word shingles.  A register is the smallest of the set's hashed
exponentials, cut to a whole step of a geometric scale, so registers merge by maximum and agree more
often the more alike two sets are.  Texts that share a band of registers are candidates; a joint
likelihood over the registers and the known set sizes drops candidates that cannot plausibly reach
the threshold, and the rest are compared on their full sets.

Copies (equal sets) become one node first.  Within a bucket, members are compared with a hub, not
with each other, and those that this leaves outside the hub's component are compared with the rest
in blocks, so no link between different texts is lost to a bucket's size and no bucket's pairs are
listed.  A hub's members are dealt to slices of bounded size, each of which gets the hub's set once.

Cases: a text without words, empty or null, has an empty set, is linked with nothing and is its own
component; a text of fewer words than a shingle is one shingle; rows with the same id stay separate
rows of one document, and equal rows are one node however many there are; rows with a null id take part
like others, but their id is ignored where other ids give the smallest, and a component without any id
has a null one, whose rows are all kept; an empty table gives none; columns besides the id and the text
are not looked at; a very long text is held whole by one worker, with some 30 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import grouped
from tessera.llm.hashing import Joined, Slices, mix
from tessera.llm.shared import durable, narrow

SHINGLE = 5
#: Registers: BANDS bands of ROWS; at a similarity of 0.85 a pair shares no band with a probability of about 1e-5.
BANDS, ROWS = 24, 6
#: That probability at most; below 0.85 bands have fewer rows and are more (28 of 5 at 0.80).
MISSED = 2e-5
#: Scale of the registers: base, rate and the largest value.
BASE, RATE, TOP = 1.02, 20.0, 65_000
#: Log-likelihood by which a similarity below the threshold must win for a candidate to be dropped (6 standard deviations).
DOUBT = 18.0
SLICE_BYTES = 1 << 20
#: Bits of the filter that keeps texts without candidates from being cut into shingles again; bounds what is broadcast to 8 MB.
FILTER_BITS = 1 << 26
_rng = np.random.default_rng(715517)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (one more at the end)."""
    j = Joined(texts, lower=True)
    words = j.word_hashes()
    n = j.n_words
    last = np.repeat(j.first[1:], n)
    at = np.arange(len(words))
    short = np.repeat(n < k, n)
    start = at[(at + k <= last) | (short & (at == np.repeat(j.first[:-1], n)))]
    end = np.minimum(start + k, last[start])
    doc = j.doc_of_word()[start]
    key = Slices(words).hash(start, end)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_ids(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per set, whatever the order."""
    sums = np.zeros(len(keys) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(keys, 21), out=sums[1:])
        return mix(sums[at[1:]] - sums[at[:-1]], 22).astype(np.int64)


def registers(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sets × registers; every set must have a member."""
    small = keys.astype(np.uint32)
    starts = at[:-1]
    out = np.empty((len(starts), BANDS * ROWS), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for r in range(BANDS * ROWS):
            out[:, r] = np.minimum.reduceat(small * _A[r] + _B[r], starts)
    exponential = -np.log1p(-(out + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def rows_for(percent: int) -> int:
    """The most rows of a band with which a pair at ``percent`` shares no band as rarely as ``MISSED``."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (BANDS * ROWS // r) <= MISSED), 1)


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = regs.shape[1] // rows
    banded = regs[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), banded.shape[:2])
    for r in range(rows):
        key = mix(key, 31) ^ banded[:, :, r]
    return mix(key, 32).astype(np.int64)


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 201)


def doubtful(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the likelihood of the registers leaves a similarity of ``percent`` or more plausible.

    Of each pair it counts registers where one set's is larger, smaller or equal; the sets' sizes
    are known, so the similarity is all that is left to estimate.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    most = np.minimum(u / v, v / u)
    j = _GRID[None, :] * most[:, None]
    p, q = _step(np.maximum(u[:, None] - v[:, None] * j, 1e-12)), _step(np.maximum(v[:, None] - u[:, None] * j, 1e-12))
    fit = more[:, None] * np.log(p) + less[:, None] * np.log(q) + same[:, None] * np.log(np.maximum(1 - p - q, 1e-12))
    able = j >= percent / 100 - 0.005
    best = np.where(able, fit, -np.inf).max(axis=1)
    return (fit.max(axis=1) - best <= DOUBT) & (np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b))


def _sketch(rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped(it, SLICE_BYTES):
            keys, at = shingle_sets(texts)
            n = np.diff(at)
            full = n > 0
            regs = registers(keys, at[np.append(full, True)]) if full.any() else np.empty((0, BANDS * ROWS), np.uint16)
            bands = band_keys(regs, rows)
            r, b, k = [None] * len(ids), [None] * len(ids), 0
            for i in np.flatnonzero(full).tolist():
                r[i], b[i] = regs[k].tobytes(), bands[k]
                k += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(set_ids(keys, at), pa.int64(), mask=~full), pa.array(r, pa.binary()), pa.array(b, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "regs", "bands"],
            )

    return run


def _filter_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(ids.astype(np.uint64), s) % np.uint64(bits)).astype(np.int64) for s in (41, 42)])


def _filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ids, from pieces of its size that reach the driver one by one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, dtype=bool)
        for b in it:
            have[_filter_bits(b.column("doc_id").drop_null().to_numpy(zero_copy_only=False), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(have).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in nodes.coalesce(32).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _sets_of(shared, bits: int):
    """Full sets, as sorted 48-bit fingerprints, of the texts whose id the filter knows or is null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8))

        def some() -> Iterator[pa.RecordBatch]:
            for b in it:
                ids = b.column("doc_id")
                at = _filter_bits(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
                yield b.filter(pa.array((known[at[0]] & known[at[1]]).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)))

        for _, texts in grouped(some(), SLICE_BYTES):
            keys, at = shingle_sets(texts)
            short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            node, first = np.unique(set_ids(keys, at), return_index=True)  # copies once
            full = at[first + 1] > at[first]
            blobs = [short[at[i] : at[i + 1]].tobytes() for i in first[full].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[full], pa.int64()), pa.array(blobs, pa.binary())], names=["node", "members"])

    return run


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _compared(percent: int):
    """Pairs of a hub and a member that the likelihood leaves open and the full sets confirm; rows come sorted, a slice's hub before its members."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for b in it:
            hubs, rows = [], []
            sides, nodes, sizes, regs = (b.column(c).to_pylist() for c in ("side", "node", "n", "regs"))
            for i, side in enumerate(sides):
                if side == 0:
                    hub = (nodes[i], sizes[i], regs[i], _wide(b.column("members")[i].as_py()))
                else:
                    hubs.append(hub)
                    rows.append(i)
            if not rows:
                continue
            of_hub, own = (np.frombuffer(b"".join(x), dtype=np.uint16).reshape(len(rows), -1) for x in ([h[2] for h in hubs], [regs[i] for i in rows]))
            open_ = doubtful(of_hub, own, np.array([h[1] for h in hubs]), np.array([sizes[i] for i in rows]), percent)
            a, linked = [], []
            for k in np.flatnonzero(open_).tolist():
                x, y = hubs[k][3], _wide(b.column("members")[rows[k]].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(hubs[k][0])
                    linked.append(nodes[rows[k]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(linked, pa.int64())], names=["hub", "node"])

    return run


def _block(percent: int):
    """A forest of the links between the two sides of one block, by full sets."""

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for node, label, side, blob in zip(*(table.column(c).to_pylist() for c in ("node", "label", "side", "members")), strict=True):
            rows[side, node] = (label, blob)
        left, right = ([(n, *v) for (s, n), v in rows.items() if s == k] for k in (1, 0))
        out = {"a": [], "b": []}
        if left and right:
            sets = [_wide(x[2]) for x in right]
            sizes = np.array([len(x) for x in sets])
            names, at = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            parent = {x[1]: x[1] for x in left + right}

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for node, label, blob in left:
                mine = _wide(blob)
                place = np.searchsorted(names, mine).clip(0, len(names) - 1)
                mark = np.zeros(len(names), dtype=np.int64)
                mark[place[names[place] == mine]] = 1
                both = np.add.reduceat(mark[at], starts)
                for j in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)).tolist():
                    a, b = find(label), find(right[j][1])
                    if a != b:
                        parent[b] = a
                        out["a"].append(node)
                        out["b"].append(right[j][0])
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, by rounds of smallest neighbours and pointer jumps."""
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        new = durable(own.join(jump, "best", "left").select("node", F.least("best", F.coalesce("far", "best")).alias("new"), "label"))
        moved = new.where("new != label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Texts are linked where 100 * intersection >= percent * union of their sets; ``component_id`` is
    the smallest id reachable, ``kept`` whether it is the row's own.
    """
    spark, rows = docs.sparkSession, narrow(docs, id_col, text_col)
    sketches = durable(rows.mapInArrow(_sketch(rows_for(percent)), "doc_id long, n_shingles long, node long, regs binary, bands array<long>"))
    nodes = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = durable(banded.join(crowded, "key"))
    meta = durable(nodes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"))
    n_nodes = meta.count()
    if n_nodes:
        bits = min(FILTER_BITS, 1 << max(10, (16 * n_nodes - 1).bit_length()))
        shared = spark.sparkContext.broadcast(_filter(meta.select("doc_id"), bits).tobytes())
        sets = durable(rows.mapInArrow(_sets_of(shared, bits), "node long, members binary").dropDuplicates(["node"]))
        labels = _resolve(members, meta, sets, percent)
        smallest = meta.join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
        linked = labels.join(smallest, "label").select("node", "component_id")
        firsts = nodes.select("node", F.col("doc_id").alias("first_id")).join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    else:
        firsts = nodes.select("node", F.col("doc_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "node").join(firsts, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


#: Bytes of sets on each side of a block, and rows of a hub's slice.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 500
#: Hubs of more than one slice that are broadcast, at most: some megabytes.
LARGE_HUBS = 200_000


def _resolve(members: DataFrame, meta: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Component labels of all linked nodes: ``node, label``.

    First each bucket's members are compared with the hub, the member that meets most others.  The
    members that this leaves outside the hub's component are then compared, in blocks of bounded
    size, with all members of the hub's buckets; a block gives a forest of its links at most, and
    buckets inside one component have no blocks.
    """
    rank = members.groupBy("node").agg(F.sum("size").alias("rank"))
    hubs = members.join(rank, "node").groupBy("key").agg(F.max(F.struct("rank", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    pairs = durable(members.join(hubs, "key").select("hub", "node").distinct())
    own = meta.select("node", "n", "regs").join(sets, "node")
    slices = F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") * 6) / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int")
    sliced = durable(pairs.where("node != hub").join(meta.select("node", "n"), "node").groupBy("hub").agg(slices.alias("slices")))
    columns = ["hub", "slice", "side", "node", "n", "regs", "members"]
    large = sliced.where("slices > 1")
    if large.limit(LARGE_HUBS + 1).count() <= LARGE_HUBS:  # beyond that many they are joined, and AQE splits a large one
        large = F.broadcast(large)
    some = pairs.where("node != hub").join(large, "hub", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("node"), "slices").cast("int"), F.lit(0))).drop("slices").withColumn("side", F.lit(1)).join(own, "node")
    every = sliced.select("hub", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"), F.col("hub").alias("node")).join(own, "node")
    met = every.select(columns).unionByName(some.select(columns)).repartition("hub", "slice").sortWithinPartitions("hub", "slice", "side", "node")
    links = durable(met.mapInArrow(_compared(percent), "hub long, node long")).toDF("a", "b")
    labels = components(links)
    marked = pairs.join(labels, "node", "left").join(meta.select("node", "n"), "node").withColumn("label", F.coalesce("label", "node"))
    home = marked.where("node = hub").select("hub", F.col("label").alias("home"))
    marked = durable(marked.join(home, "hub").withColumn("apart", F.col("label") != F.col("home")))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") * 6) / BLOCK_BYTES)).cast("int")
    outside = F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("apart"), F.col("n") * 6)) / BLOCK_BYTES)).cast("int")
    counts = marked.groupBy("hub").agg(blocks.alias("across"), outside.alias("down"), F.count_if("apart").alias("left")).where("left > 0").drop("left")
    dealt = marked.join(counts, "hub").withColumn("h", F.xxhash64("node"))
    every = dealt.select("hub", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod("h", "across").cast("int").alias("j"), "node", "label", F.lit(0).alias("side"))
    some = dealt.where("apart").select("hub", F.pmod("h", "down").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), "node", "label", F.lit(1).alias("side"))
    more = durable(every.union(some).join(sets, "node").groupBy("hub", "i", "j").applyInArrow(_block(percent), "a long, b long"))
    if not more.limit(1).count():
        return labels
    return components(links.union(more))
