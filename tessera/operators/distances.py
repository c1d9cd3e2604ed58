"""Distance operators over all pairs: exact neighbours, sums by label and extremes by pair of labels.

Points are dealt to ``g`` groups by a hash of their id and pairs of groups are cells, so each point
travels 2 ``g`` times at most and a cell holds two groups of ``ROWS`` points or fewer.  A cell works with
one matrix product; what decides an order or an extreme is computed again from the differences.  Nothing
goes through the driver but the number of points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a group, at most about.
ROWS = 20_000
#: Rows of a cell that are compared at once.
SLICE = 1024


def _groups(spark, n: int) -> int:
    """So many that groups are small enough and that all cores have cells, but not for a handful of points."""
    return max(1, math.ceil(n / ROWS), min(math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)), math.ceil(n / 512)))


def _cells(left: DataFrame, right: DataFrame, g: int, half: bool = False):
    """Both sides at their cells; with ``half`` only cells on and above the diagonal."""
    part = F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    others = F.sequence(F.lit(0), F.lit(g - 1))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # attributes of its own, where both sides are one frame
    a = left.withColumn("a", part).withColumn("b", F.explode(others))
    b = right.withColumn("b", part).withColumn("a", F.explode(others))
    if half:
        a, b = a.where("a <= b"), b.where("a <= b")
    n = g * g
    return a.repartition(n, "a", "b").groupBy("a", "b").cogroup(b.repartition(n, "a", "b").groupBy("a", "b"))


def _matrix(table: pa.Table | pa.RecordBatch, column: str = "v") -> np.ndarray:
    got = table.column(column)
    got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
    return got.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def _squares(x: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + yy - 2 * x @ y.T, 0)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row distances from the differences."""
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def knn(queries: DataFrame, points: DataFrame, k: int, id_col: str = "id", vector: str = "v", keep_self: bool = False, n: int | None = None) -> DataFrame:
    """``id, neighbor, distance, rank``: the ``k`` nearest other points of each query, ties by id."""
    spark = points.sparkSession
    left = queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    right = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, names, x, y = a.column("id").to_numpy(), b.column("id").to_numpy(), _matrix(a), _matrix(b)
        out: list[tuple] = []
        yy = (y**2).sum(axis=1) if len(y) else np.zeros(0)
        for at in range(0, len(x) if len(y) else 0, SLICE):
            some, mine = x[at : at + SLICE], ids[at : at + SLICE]
            d = _squares(some, y, yy)
            if not keep_self:
                d[mine[:, None] == names[None, :]] = np.inf
            take = min(k, len(y))
            bound = np.partition(d, take - 1, axis=1)[:, take - 1]
            slack = 1e-9 * ((some**2).sum(axis=1) + yy.max(initial=0)) + 1e-12
            rows, columns = np.nonzero(d <= np.where(np.isfinite(bound), bound + slack, np.finfo(float).max)[:, None])
            exact = _exact(some[rows], y[columns])
            order = np.lexsort((names[columns], exact, rows))
            rows, columns, exact = rows[order], columns[order], exact[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best = place < k
            out.append((mine[rows[best]], names[columns[best]], exact[best]))
        merged = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        begin = np.flatnonzero(np.append(True, merged[0][1:] != merged[0][:-1])) if len(merged[0]) else np.zeros(0, np.int64)
        structs = pa.StructArray.from_arrays([pa.array(merged[2], pa.float64()), pa.array(merged[1], pa.int64())], names=["distance", "neighbor"])
        return pa.table({"id": pa.array(merged[0][begin], pa.int64()), "near": pa.ListArray.from_arrays(pa.array(np.append(begin, len(merged[0])), pa.int32()), structs)})

    g = _groups(spark, points.count() if n is None else n)
    parts = _cells(left, right, g).applyInArrow(near, "id long, near array<struct<distance double, neighbor long>>")
    best = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")) if g > 1 else parts
    return best.select("id", F.posexplode("near").alias("rank", "x")).select("id", "x.neighbor", "x.distance", (F.col("rank") + 1).alias("rank"))


def label_sums(points: DataFrame, id_col: str = "id", vector: str = "v", label: str = "label") -> DataFrame:
    """``id, own, label, n, sum_d`` of each point's distances to the other points of each label."""
    rows = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).cast("int").alias("label"))

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, own, x = a.column("id").to_numpy(), a.column("label").to_numpy(), _matrix(a)
        order = np.argsort(b.column("label").to_numpy(), kind="stable")
        labels, y = b.column("label").to_numpy()[order], _matrix(b)[order] if b.num_rows else _matrix(b)
        names = b.column("id").to_numpy()[order]
        begin = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else np.zeros(0, np.int64)
        count, out = np.diff(np.append(begin, len(labels))), []
        yy = (y**2).sum(axis=1) if len(y) else np.zeros(0)
        for at in range(0, len(x) if len(y) else 0, SLICE):
            some, mine = x[at : at + SLICE], ids[at : at + SLICE]
            d, n = _squares(some, y, yy), np.tile(count, (len(some), 1))
            rows, columns = np.nonzero(mine[:, None] == names[None, :])
            d[rows, columns] = 0
            n[rows, np.searchsorted(begin, columns, side="right") - 1] -= 1
            total = np.add.reduceat(np.sqrt(d), begin, axis=1)
            r, c = np.nonzero(n > 0)
            out.append((mine[r], own[at + r], labels[begin][c], n[r, c], total[r, c]))
        merged = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("id", "own", "label", "n", "sum_d"), merged, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)})

    g = _groups(points.sparkSession, rows.count())
    parts = _cells(rows, rows, g).applyInArrow(sums, "id long, own int, label int, n long, sum_d double")
    return parts.groupBy("id", "own", "label").agg(F.sum("n").alias("n"), F.sum("sum_d").alias("sum_d")) if g > 1 else parts


def extremes(points: DataFrame, id_col: str = "id", vector: str = "v", label: str = "label") -> DataFrame:
    """``a, b, min_d, max_d``: the smallest and largest distance between different points of labels ``a <= b``."""
    rows = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).cast("int").alias("label"))

    def ends(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = []
        for t in (a, b):
            order = np.argsort(t.column("label").to_numpy(), kind="stable")
            sides.append((t.column("id").to_numpy()[order], t.column("label").to_numpy()[order], _matrix(t)[order] if t.num_rows else _matrix(t)))
        (ids, own, x), (names, labels, y) = sides
        found: dict[tuple[int, int], list[float]] = {}
        if len(x) and len(y):
            yy = (y**2).sum(axis=1)
            cuts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
            for start in np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist():
                stop = int(np.searchsorted(own, own[start], side="right"))
                for at in range(start, stop, SLICE):
                    some = x[at : min(at + SLICE, stop)]
                    d = _squares(some, y, yy)
                    r, c = np.nonzero(ids[at : at + len(some)][:, None] == names[None, :])
                    low = d
                    if len(r):
                        low = d.copy()
                        low[r, c] = np.inf
                        d[r, c] = -np.inf
                    for from_, to in zip(cuts.tolist(), [*cuts[1:].tolist(), len(labels)], strict=True):
                        key = tuple(sorted((int(own[start]), int(labels[from_]))))
                        for which, values, pick in ((0, low[:, from_:to], np.argmin), (1, d[:, from_:to], np.argmax)):
                            i, j = np.unravel_index(pick(values), values.shape)
                            if np.isfinite(values[i, j]):
                                best = float(_exact(some[i], y[from_ + j]))
                                old = found.setdefault(key, [np.inf, -np.inf])
                                old[which] = min(old[0], best) if which == 0 else max(old[1], best)
        got = [(*k, *v) for k, v in found.items() if np.isfinite(v[0])]
        cols = list(zip(*got, strict=True)) if got else [(), (), (), ()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("a", "b", "min_d", "max_d"), cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)})

    g = _groups(points.sparkSession, rows.count())
    parts = _cells(rows, rows, g, half=True).applyInArrow(ends, "a int, b int, min_d double, max_d double")
    return parts.groupBy("a", "b").agg(F.min("min_d").alias("min_d"), F.max("max_d").alias("max_d"))


def ranks(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, neighbor, rank``: how many other points are nearer to ``id`` than ``neighbor`` is, ties by id, and one."""
    rows = points.select("id", "v")
    other = points.select(F.col("id").alias("neighbor"), F.col("v").alias("w"))
    distance = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    left = pairs.select("id", "neighbor").join(rows, "id").join(other, "neighbor").groupBy("id").agg(F.first("v").alias("v"), F.collect_list(F.struct(distance.alias("d"), "neighbor")).alias("targets"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, names, x, y = a.column("id").to_numpy(), b.column("id").to_numpy(), _matrix(a), _matrix(b)
        out: dict[str, list] = {"id": [], "neighbor": [], "nearer": []}
        for i, targets in enumerate(a.column("targets").to_pylist() if len(y) else ()):
            d = _exact(x[i][None, :], y)
            for t in targets:
                nearer = (d < t["d"]) | ((d == t["d"]) & (names < t["neighbor"]))
                out["id"].append(int(ids[i]))
                out["neighbor"].append(t["neighbor"])
                out["nearer"].append(int((nearer & (names != ids[i]) & (names != t["neighbor"])).sum()))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    parts = _cells(left, rows, _groups(points.sparkSession, rows.count())).applyInArrow(count, "id long, neighbor long, nearer long")
    return parts.groupBy("id", "neighbor").agg((F.sum("nearer") + 1).alias("rank"))


def lsh_buckets(points: DataFrame, d: int, length: float, tables: int, hashes: int, seed: int = 42) -> DataFrame:
    """``id, v, table, bucket``: random projections cut to steps of ``length``, ``hashes`` of them to a bucket; one product for each Arrow batch."""
    rng = np.random.default_rng(seed)
    directions, offsets = rng.normal(size=(d, tables * hashes)), rng.uniform(0, length, tables * hashes)
    odd = rng.integers(1, 1 << 62, hashes) | 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            steps = np.floor((_matrix(b) @ directions + offsets) / length).astype(np.int64).reshape(b.num_rows, tables, hashes) if b.num_rows else np.zeros((0, tables, hashes), np.int64)
            bucket = (steps * odd).sum(axis=2)
            rows = pa.array(np.repeat(np.arange(b.num_rows), tables))
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("v").take(rows), pa.array(np.tile(np.arange(tables), b.num_rows), pa.int32()), pa.array(bucket.ravel(), pa.int64())], names=["id", "v", "table", "bucket"])

    return points.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, v array<double>, table int, bucket long")


def knn_lsh(queries: DataFrame, points: DataFrame, k: int, d: int, length: float, tables: int = 8, hashes: int = 3, seed: int = 42) -> DataFrame:
    """Approximate ``knn``: only points that share a bucket with a query in some table are compared.

    Buckets are dealt to parts; the points of a crowded one are dealt to slices, and its queries go to all of them.
    """
    left, right = (lsh_buckets(x, d, length, tables, hashes, seed) for x in (queries, points))
    sizes = right.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("slices"))
    parts = max(2 * points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() * tables / ROWS))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, names, x, y = a.column("id").to_numpy(), b.column("id").to_numpy(), _matrix(a), _matrix(b)
        keys, other = (np.stack([t.column("table").to_numpy(), t.column("bucket").to_numpy()], axis=1) if t.num_rows else np.zeros((0, 2), np.int64) for t in (a, b))
        order = np.lexsort((other[:, 1], other[:, 0]))
        cuts = np.flatnonzero(np.append(True, (np.diff(other[order], axis=0) != 0).any(axis=1))) if len(order) else np.zeros(0, np.int64)
        members = {tuple(other[order[i]].tolist()): order[i:j] for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)} if len(order) else {}
        out: list[tuple[list, list, list]] = []
        for i, key in enumerate(map(tuple, keys.tolist())):
            some = members.get(key, order[:0])
            some = some[names[some] != ids[i]]
            if len(some):
                dist = _exact(x[i][None, :], y[some])
                top = np.lexsort((names[some], dist))[:k]
                out.append(([int(ids[i])] * len(top), names[some[top]].tolist(), dist[top].tolist()))
        cols = [[v for o in out for v in o[c]] for c in range(3)]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("id", "neighbor", "distance"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    part = F.pmod(F.col("bucket"), F.lit(parts)).alias("part")
    left = left.join(sizes, ["table", "bucket"]).select("id", "v", "table", "bucket", part, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = right.join(sizes, ["table", "bucket"]).select("id", "v", "table", "bucket", part, F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # attributes of its own, where both sides are one frame
    got = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(near, "id long, neighbor long, distance double").distinct()
    best = got.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))), 1, k).alias("near"))
    return best.select("id", F.posexplode("near").alias("rank", "x")).select("id", "x.neighbor", "x.distance", (F.col("rank") + 1).alias("rank"))
