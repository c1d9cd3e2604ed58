"""Fits over all rows: each pass over blocks of rows sums what many fits need, the driver holds only parameters.

Rows lie in persisted blocks of at most ``BLOCK``.  A fit sees all rows, a part drawn without
replacement, or uniform reference rows; parts and reference rows are drawn by seed and block, so each
pass sees the same.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Rows of a block; two blocks' distances to each other fit a task.
BLOCK = 2_000
#: Partitions whose partial sums go to the driver without being merged on the way.
FLAT = 64

ALL = ("all", 0, 0)


class Fit(NamedTuple):
    k: int
    seed: int
    #: ("all", 0, 0), ("part", seed, side) or ("box", seed, 0)
    view: tuple = ALL
    c: Any = None


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


class Rows:
    """The blocks of ``id, v`` rows, numbered from 0."""

    def __init__(self, points: DataFrame):
        spark = points.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, -(-points.count() // BLOCK))

        def pack(it):
            for pdf in it:
                for at in range(0, len(pdf), BLOCK):
                    some = pdf.iloc[at : at + BLOCK]
                    yield pd.DataFrame({"n": [len(some)], "v": [np.array(some["v"].tolist(), dtype="<f8").tobytes()]})

        def unpack(part: int, it):
            some = list(it)
            if some:
                x = np.concatenate([np.frombuffer(r["v"], dtype="<f8").reshape(r["n"], -1) for r in some])
                for k, at in enumerate(range(0, len(x), BLOCK)):
                    yield (part << 32) + k, x[at : at + BLOCK]

        packed = points.select("id", "v").repartition(parts).coalesce(parts).mapInPandas(pack, "n long, v binary")
        self.blocks = packed.rdd.mapPartitionsWithIndex(unpack).persist(StorageLevel.MEMORY_AND_DISK)
        self.sizes = dict(sorted(self.blocks.map(lambda b: (b[0], len(b[1]))).collect()))
        self.n, self.parts, self.taken = sum(self.sizes.values()), parts, {}
        self.low = self.high = None

    def done(self) -> None:
        self.blocks.unpersist()

    def part(self, seed: int, size: int) -> int:
        """Register a part of ``size`` rows drawn without replacement; each block's share is drawn first."""
        rng = np.random.default_rng((seed, 1))
        self.taken[seed] = dict(zip(self.sizes, rng.multivariate_hypergeometric(list(self.sizes.values()), size, method="marginals").tolist(), strict=True))
        return seed

    def fold(self, fits: dict, task: Callable, join: Callable = added) -> dict:
        """Per fit what ``task(rows, block number, fit)`` gives for each block, joined over all blocks."""
        order = sorted(fits.items(), key=lambda f: f[1].view)
        seeds = {f.view[1] for f in fits.values() if f.view[0] == "part"}
        taken, low, high = {s: self.taken[s] for s in seeds}, self.low, self.high

        def part(it):
            out: dict = {}
            for number, x in it:
                last, rows = None, x
                for name, f in order:
                    if f.view != last:
                        last, rows = f.view, seen(x, number, f.view, taken, low, high)
                    if len(rows):
                        got = task(rows, number, f)
                        out[name] = join(out[name], got) if name in out else got
            yield out

        def merge(a: dict, b: dict) -> dict:
            return {k: join(a[k], b[k]) if k in a and k in b else a[k] if k in a else b[k] for k in {**a, **b}}

        return self.blocks.mapPartitions(part).treeReduce(merge, 1 if self.parts <= FLAT else 2)


def members(n: int, number: int, seed: int, taken: dict) -> np.ndarray:
    """Which rows of a block the part holds."""
    out = np.zeros(n, dtype=bool)
    out[np.random.default_rng((seed, 2, number)).permutation(n)[: taken[seed][number]]] = True
    return out


def seen(x: np.ndarray, number: int, view: tuple, taken: dict, low, high) -> np.ndarray:
    kind, seed, side = view
    if kind == "part":
        return x[members(len(x), number, seed, taken) != bool(side)]
    if kind == "box":
        return np.random.default_rng((seed, 3, number)).uniform(low, high, x.shape)
    return x


def box(rows: Rows) -> None:
    """Measure the box that reference rows are drawn from."""
    low, high = rows.fold({0: Fit(1, 0)}, lambda x, number, f: (x.min(axis=0), x.max(axis=0)), lambda a, b: (np.minimum(a[0], b[0]), np.maximum(a[1], b[1])))[0]
    rows.low, rows.high = low, np.where(high > low, high, low + 1e-9)


def _draw(x: np.ndarray, number: int, f: Fit) -> tuple:
    """The row that wins a draw weighted by squared distance; a row of weight zero wins only where all are."""
    w = np.ones(len(x)) if f.c is None else squared(x, f.c).min(axis=1)
    key = np.random.default_rng((f.seed, 4, 0 if f.c is None else len(f.c), number)).exponential(size=len(x))
    none = not (w > 0).any()
    key = key if none else np.where(w > 0, key / np.where(w > 0, w, 1), np.inf)
    i = int(key.argmin())
    return none, float(key[i]), number, x[i]


def labelled(x: np.ndarray, number: int, f: Fit) -> tuple:
    """Per cluster the number and the sum of its rows."""
    one = np.eye(len(f.c))[nearest(x, f.c)]
    return one.sum(axis=0), one.T @ x


def _inertia(x: np.ndarray, number: int, f: Fit) -> tuple:
    return (float(((x - f.c[nearest(x, f.c)]) ** 2).sum()),)


def kmeans(rows: Rows, fits: dict, starts: int = 4, rounds: int = 100) -> dict:
    """Per fit (centres, inertia), best of several k-means++ starts; all fits share each pass."""
    todo = {(name, s): f._replace(seed=f.seed * 1000 + s) for name, f in fits.items() for s in range(starts)}
    for t in range(max((f.k for f in fits.values()), default=0)):
        won = rows.fold({n: f for n, f in todo.items() if f.k > t}, _draw, lambda a, b: min(a, b, key=lambda x: x[:3]))
        todo |= {n: todo[n]._replace(c=g[3][None] if t == 0 else np.vstack([todo[n].c, g[3]])) for n, g in won.items()}
    active = set(todo)
    for _ in range(rounds):
        if not active:
            break
        for n, (size, sums) in rows.fold({n: todo[n] for n in active}, labelled).items():
            old = todo[n].c
            new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], old)
            todo[n] = todo[n]._replace(c=new)
            if np.allclose(new, old, rtol=1e-10, atol=1e-12):
                active.discard(n)
    best: dict = {}
    for (name, s), (inertia,) in sorted(rows.fold(todo, _inertia).items(), key=lambda x: x[0][1]):
        if name not in best or inertia < best[name][1]:
            best[name] = (todo[name, s].c, inertia)
    return best


def spread(rows: Rows, fits: dict) -> dict:
    """Per fit (sizes, means, summed distances to the own mean, within sum of squares) of the clusters that have rows."""
    means = {n: (size, sums) for n, (size, sums) in rows.fold(fits, labelled).items()}
    mid = {n: f._replace(seed=0, c=(f.c, means[n][1] / np.maximum(means[n][0], 1)[:, None])) for n, f in fits.items()}

    def task(x: np.ndarray, number: int, f: Fit) -> tuple:
        label = nearest(x, f.c[0])
        d = ((x - f.c[1][label]) ** 2).sum(axis=1)
        return np.bincount(label, np.sqrt(d), len(f.c[0])), float(d.sum())

    got = rows.fold(mid, task)
    return {n: (means[n][0][has], mid[n].c[1][has], got[n][0][has], got[n][1]) for n in fits if (has := means[n][0] > 0) is not None}


# all pairs


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += (a**2).sum(1)[:, None]
    d += (b**2).sum(1)
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def over_pairs(rows: Rows, task: Callable, join: Callable) -> dict:
    """Per key what ``task(number, x, other number, other)`` yields as (key, value) for each ordered pair of blocks, joined."""

    def part(it):
        out: dict = {}
        for (i, x), (j, y) in it:
            for key, value in task(i, x, j, y):
                out[key] = join(out[key], value) if key in out else value
        yield from out.items()

    return rows.blocks.cartesian(rows.blocks).coalesce(rows.parts).mapPartitions(part).reduceByKey(join, rows.parts)


def core_distances(rows: Rows, most: int) -> dict[int, np.ndarray]:
    """Per block its rows' ``most`` smallest distances to any row, themselves among them."""
    few = lambda d: np.sort(np.partition(d, most - 1, axis=1)[:, :most], axis=1) if d.shape[1] > most else np.sort(d, axis=1)
    return dict(over_pairs(rows, lambda i, x, j, y: [(i, few(distances(x, y)))], lambda a, b: few(np.hstack([a, b]))).collect())


def prim(d: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (weight, a, b) of a spanning tree of mutual reachability."""
    n = len(d)
    left, best, source = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
    w, a, b, j = np.empty(n - 1), np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), 0
    for t in range(n - 1):
        left[j] = np.inf
        reach = np.maximum(d[j], core)
        np.maximum(reach, core[j], out=reach)
        closer = reach < best
        best[closer], source[closer] = reach[closer], j
        j = int((best + left).argmin())
        w[t], a[t], b[t] = best[j], source[j], j
    return w, a, b


def forest(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning forest of some edges, ties by ends, by Borůvka's rounds."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, w))
    w, a, b = w[order], a[order], b[order]
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, kept = ends[: len(a)], ends[len(a) :], np.zeros(len(a), dtype=bool)
    label, alive = np.arange(len(names)), np.arange(len(a))
    while len(alive):
        p, q = label[x[alive]], label[y[alive]]
        p, q, alive = p[p != q], q[p != q], alive[p != q]
        best = np.full(len(names), len(alive))
        np.minimum.at(best, p, np.arange(len(alive)))
        np.minimum.at(best, q, np.arange(len(alive)))
        nodes = np.flatnonzero(best < len(alive))
        edge, up = best[nodes], np.arange(len(names))
        kept[alive[edge]] = True
        up[nodes] = p[edge] + q[edge] - nodes
        two = nodes[(up[up[nodes]] == nodes) & (nodes < up[nodes])]
        up[two] = two
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return w[kept], a[kept], b[kept]


def spanning_trees(rows: Rows, samples: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per min_samples the minimum spanning tree of all rows' mutual reachability.

    An edge of the whole tree is in the tree of any two blocks that hold its ends, so the trees of
    all pairs of blocks hold the whole tree.
    """
    near = core_distances(rows, max(samples))
    core = {m: {i: d[:, min(m, d.shape[1]) - 1] for i, d in near.items()} for m in samples}
    starts = dict(zip(rows.sizes, np.cumsum([0, *rows.sizes.values()]).tolist(), strict=False))
    shared = rows.blocks.ctx.broadcast((core, starts))
    alone = len(rows.sizes) == 1

    def task(i, x, j, y):
        if i > j or (i == j and not alone):
            return
        core, starts = shared.value
        both = x if alone else np.vstack([x, y])
        d = distances(both, both)
        at = starts[i] + np.arange(len(x)) if alone else np.concatenate([starts[i] + np.arange(len(x)), starts[j] + np.arange(len(y))])
        for m in samples:
            w, a, b = prim(d, core[m][i] if alone else np.concatenate([core[m][i], core[m][j]]))
            yield m, (w, at[a], at[b])

    join = lambda a, b: forest(*(np.concatenate(z) for z in zip(a, b, strict=True)))
    return dict(over_pairs(rows, task, join).collect())


def silhouettes(rows: Rows, labels: dict) -> dict:
    """Per name (sum of silhouettes, rows) of the labelled rows; negative labels are left out.

    ``labels`` hold each block's labels, numbered from 0; sums go to the driver, never distances.
    """
    shared = rows.blocks.ctx.broadcast(labels)
    sizes = {name: np.bincount(np.concatenate([v[v >= 0] for v in of.values()])) for name, of in labels.items()}

    def task(i, x, j, y):
        d = distances(x, y)
        for name, of in shared.value.items():
            if (of[i] >= 0).any():
                one = np.zeros((len(y), len(sizes[name])))
                inside = np.flatnonzero(of[j] >= 0)
                one[inside, of[j][inside]] = 1
                yield (name, i), d[of[i] >= 0] @ one

    def score(item):
        (name, i), sums = item
        size, label = sizes[name], shared.value[name][i]
        label, at = label[label >= 0], np.arange(len(sums))
        a, m = sums[at, label] / np.maximum(size[label] - 1, 1), sums / size
        m[at, label] = np.inf
        b = m.min(axis=1)
        s = np.where(size[label] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
        return name, (float(s.sum()), len(s))

    return dict(over_pairs(rows, task, np.add).map(score).reduceByKey(added).collect())
