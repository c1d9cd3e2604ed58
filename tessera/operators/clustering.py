"""Grid clustering: each cell of a parameter grid is one row, fitted on all rows in passes over blocks.

Only silhouettes of k-means and mixtures are taken on a bounded sample, as by the reference; the final
assignment of all rows goes through ``validity.nearest_centroid``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import passes
from tessera.operators.passes import Fit, Rows

#: Rows that k-means silhouettes and soft silhouettes of mixtures are taken on, at most (the reference: 2,000 for both).
MOST, SOFT_MOST = 20_000, 2_000


def sample(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` points, those whose id hashes lowest."""
    return points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("id", "v")


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 4, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia), best of several k-means++ starts."""
    rng, best = np.random.default_rng(seed), None
    sq = (x**2).sum(axis=1)
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = np.maximum((sq[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)).min(axis=1), 0)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        label = None
        for _ in range(rounds):
            d = sq[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)
            new = d.argmin(axis=1)
            if label is not None and (new == label).all():
                break
            label = new
            for j in range(k):
                if (label == j).any():
                    c[j] = x[label == j].mean(axis=0)
        inertia = float(((x - c[label]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = (label, c, inertia)
    return best


def kmeans_grid(points: DataFrame, ks: list[int], seed: int = 42, most: int = MOST) -> DataFrame:
    """One row per k: inertia, the three scores and BIC over all rows, silhouettes of a sample of ``most`` rows."""
    rows = Rows(points)
    fits = passes.kmeans(rows, {int(k): Fit(int(k), seed + int(k)) for k in ks})
    found = {k: Fit(k, 0, c=c) for k, (c, _) in fits.items()}
    some = rows if rows.n <= most else Rows(sample(points, most))
    labels = dict(some.blocks.map(lambda b: (b[0], {k: passes.nearest(b[1], f.c) for k, f in found.items()})).collect())
    shared = {}
    for k in found:
        names = np.unique(np.concatenate([of[k] for of in labels.values()]))
        if len(names) > 1:
            shared[k] = {i: np.searchsorted(names, of[k]) for i, of in labels.items()}
    silhouettes = passes.silhouettes(some, shared) if shared else {}
    out, nan = [], float("nan")
    for k, (size, mean, away, within) in passes.spread(rows, found).items():
        n, d, has, inertia = rows.n, mean.shape[1], len(size), fits[k][1]
        ch = db = nan
        if has > 1:
            between = float((size * ((mean - size @ mean / n) ** 2).sum(axis=1)).sum())
            ch = between * (n - has) / (within * (has - 1)) if within else 1.0
            gap = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(-1))
            np.fill_diagonal(gap, np.inf)
            s = away / size
            db = float(((s[:, None] + s[None]) / gap).max(axis=1).mean())
        total, count = silhouettes.get(k, (nan, 1))
        out.append((k, inertia, total / count, ch, db, float(n * np.log(inertia / n + 1e-12) + k * d * np.log(n))))
    for r in {id(rows): rows, id(some): some}.values():
        r.done()
    return points.sparkSession.createDataFrame(out, "k long, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, bic double")


def knee(x: list[float], y: list[float], sensitivity: float = 3.0) -> float | None:
    """The knee of a convex decreasing curve, or nothing."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 3 or np.ptp(y) == 0:
        return None
    u, v = (x - x.min()) / np.ptp(x), (y.max() - y) / np.ptp(y)
    curve = v - u
    peaks = [i for i in range(1, len(curve) - 1) if curve[i] >= curve[i - 1] and curve[i] > curve[i + 1]]
    for at, i in enumerate(peaks):
        bound = curve[i] - sensitivity * np.diff(u).mean()
        until = peaks[at + 1] if at + 1 < len(peaks) else len(curve)
        if (curve[i + 1 : until] < bound).any():
            return float(x[i])
    return None


def vote(rows: pd.DataFrame) -> dict:
    """One vote each for the knee, silhouette, Calinski–Harabasz, Davies–Bouldin and BIC; a tie goes to the higher silhouette."""
    rows = rows.sort_values("k")
    picks = {"knee": knee(rows["k"].tolist(), rows["inertia"].tolist())}
    for name, best in (("silhouette", "idxmax"), ("calinski_harabasz", "idxmax"), ("davies_bouldin", "idxmin"), ("bic", "idxmin")):
        picks[name] = int(rows.loc[getattr(rows[name], best)(), "k"])
    votes = pd.Series([v for v in picks.values() if v is not None]).value_counts()
    tied = rows[rows["k"].isin(votes[votes == votes.max()].index)]
    return picks | {"selected": int(tied.loc[tied["silhouette"].idxmax(), "k"]), "votes": int(votes.max())}


def gap_statistic(points: DataFrame, ks: list[int], references: int = 10, seed: int = 42) -> DataFrame:
    """``k, log_inertia, gap, gap_sk``; references have as many uniform rows as there are points."""
    rows = Rows(points)
    passes.box(rows)
    view = lambda k, b: ("box", seed + 1_000_000 + 10_000 * k + b, 0) if b else passes.ALL
    fits = passes.kmeans(rows, {(int(k), b): Fit(int(k), seed + int(k), view(int(k), b)) for k in ks for b in range(references + 1)})
    rows.done()
    w = points.sparkSession.createDataFrame([(k, b, float(np.log(inertia + 1e-12))) for (k, b), (_, inertia) in fits.items()], "k long, b long, w double")
    own, ref = F.max(F.when(F.col("b") == 0, F.col("w"))), F.when(F.col("b") > 0, F.col("w"))
    return w.groupBy("k").agg(own.alias("log_inertia"), (F.avg(ref) - own).alias("gap"), (F.sqrt(F.lit(1 + 1 / references)) * F.stddev_samp(ref)).alias("gap_sk"))


def prediction_strength(points: DataFrame, ks: list[int], repeats: int = 5, seed: int = 42) -> DataFrame:
    """``k, strength``: the weakest test cluster's share of pairs that the training centres keep together, averaged over halves."""
    rows = Rows(points)
    half = rows.n // 2
    fits = {}
    for k, r in ((int(k), r) for k in ks for r in range(repeats) if half > int(k)):
        part = rows.part(seed + 2_000_000 + 10_000 * k + r, half)
        fits |= {(k, r, side): Fit(k, seed + k, ("part", part, side)) for side in (0, 1)}
    centres = {n: c for n, (c, _) in passes.kmeans(rows, fits).items()} if fits else {}

    def together(x: np.ndarray, number: int, f: Fit) -> tuple:
        t = np.zeros((f.k, f.k))
        np.add.at(t, (passes.nearest(x, f.c[1]), passes.nearest(x, f.c[0])), 1)
        return (t,)

    tests = {n[:2]: f._replace(c=(centres[(*n[:2], 0)], centres[n])) for n, f in fits.items() if n[2]}
    out = [(int(k), float("nan")) for k in ks]
    for (k, _), (t,) in (rows.fold(tests, together) if tests else {}).items():
        n = t.sum(axis=1)
        shares = ((t * (t - 1)).sum(axis=1) / np.maximum(n * (n - 1), 1))[n >= 2]
        out.append((k, float(shares.min()) if len(shares) else float("nan")))
    rows.done()
    s = points.sparkSession.createDataFrame(out, "k long, s double")
    return s.groupBy("k").agg(F.avg(F.when(~F.isnan("s"), F.col("s"))).alias("strength"))


def _rand(t: np.ndarray) -> float:
    two = lambda n: (n * (n - 1) / 2).sum()
    s, sa, sb, n = two(t), two(t.sum(1)), two(t.sum(0)), t.sum()
    e = sa * sb / (n * (n - 1) / 2)
    return 1.0 if (sa + sb) / 2 == e else float((s - e) / ((sa + sb) / 2 - e))


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    return _rand(t)


def bootstrap_ari(points: DataFrame, k: int, runs: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """One row ``mean_ari, std_ari, pairs`` over all pairs of refitted subsamples."""
    rows = Rows(points)
    fits = passes.kmeans(rows, {r: Fit(k, seed + r, ("part", rows.part(seed + r, int(share * rows.n)), 0)) for r in range(runs)})
    taken = rows.taken

    def both(x: np.ndarray, number: int, f: Fit) -> tuple:
        t = np.zeros((k, k))
        some = np.logical_and(*(passes.members(len(x), number, seed + r, taken) for r in f.seed))
        np.add.at(t, tuple(passes.nearest(x[some], fits[r][0]) for r in f.seed), 1)
        return (t,)

    tables = rows.fold({(a, b): Fit(k, (a, b)) for a in range(runs) for b in range(a)}, both)
    rows.done()
    pairs = points.sparkSession.createDataFrame([(_rand(t),) for (t,) in tables.values()], "ari double")
    return pairs.agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.count(F.lit(1)).alias("pairs"))


def hdbscan(x: np.ndarray, smallest: int, min_samples: int) -> np.ndarray:
    """Labels by excess of mass over the condensed tree of mutual reachability; noise is -1."""
    d = passes.distances(x, x)
    m = min(min_samples, len(x)) - 1
    return condensed(len(x), passes.prim(d, np.partition(d, m, axis=1)[:, m]), smallest)


def condensed(n: int, tree: tuple[np.ndarray, np.ndarray, np.ndarray], smallest: int) -> np.ndarray:
    """Labels by excess of mass from a spanning tree's edges: single linkage by ascending edges, then the condensed tree."""
    edges = list(zip(*(z.tolist() for z in tree), strict=True))
    parent, node, size, kids = list(range(n)), list(range(n)), [1] * n, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    height = {}
    for w, a, b in sorted(edges):
        a, b = find(a), find(b)
        new = len(size)
        kids[new], height[new] = (node[a], node[b]), w
        size.append(size[node[a]] + size[node[b]])
        parent[b] = a
        node[a] = new

    def leaves(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack.extend(kids[j])
        return out

    # walk down: a split counts where both sides are large enough
    clusters, stack = {}, [(len(size) - 1, 0.0, None)]
    while stack:
        top, birth, above = stack.pop()
        name, at, mass = len(clusters), top, 0.0
        clusters[name] = {"top": top, "parent": above, "kids": []}
        if above is not None:
            clusters[above]["kids"].append(name)
        while at >= n:
            level = 1 / max(height[at], 1e-12)
            a, b = kids[at]
            big = [c for c in (a, b) if size[c] >= smallest]
            if len(big) == 2:
                mass += size[at] * (level - birth)
                stack += [(a, level, name), (b, level, name)]
                break
            mass += (size[at] - (size[big[0]] if big else 0)) * (level - birth)
            if not big:
                break
            at = big[0]
        clusters[name]["mass"] = mass
    chosen = {}
    for name in sorted(clusters, reverse=True):
        c = clusters[name]
        below = sum(chosen[k][0] for k in c["kids"])
        chosen[name] = (below, [y for k in c["kids"] for y in chosen[k][1]]) if c["kids"] and (below > c["mass"] or c["parent"] is None) else (c["mass"], [name])
    label = np.full(n, -1)
    for i, name in enumerate([y for y in chosen[0][1] if clusters[y]["parent"] is not None]):
        label[leaves(clusters[name]["top"])] = i
    return label


def hdbscan_grid(points: DataFrame, sizes: list[int], samples: list[int]) -> DataFrame:
    """One row per cell: clusters, noise, clustered share and silhouette of the clustered points, over all rows."""
    rows = Rows(points)
    trees = passes.spanning_trees(rows, [int(m) for m in samples])
    ends = np.cumsum(list(rows.sizes.values()))
    labels = {(int(s), int(m)): condensed(rows.n, trees[int(m)], int(s)) for s in sizes for m in samples}
    scored = {c: dict(zip(rows.sizes, np.split(label, ends[:-1]), strict=True)) for c, label in labels.items() if label.max() >= 1 and (label >= 0).sum() > label.max() + 1}
    silhouettes = passes.silhouettes(rows, scored) if scored else {}
    rows.done()
    out = []
    for (s, m), label in labels.items():
        total, count = silhouettes.get((s, m), (float("nan"), 1))
        out.append((s, m, int(label.max()) + 1, int((label < 0).sum()), float((label >= 0).mean()), total / count))
    return points.sparkSession.createDataFrame(out, "min_cluster_size long, min_samples long, clusters long, noise long, clustered double, silhouette double")


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _digamma(v: np.ndarray) -> np.ndarray:
    return (_lgamma(v + 1e-5) - _lgamma(np.maximum(v - 1e-5, 1e-9))) / 2e-5


def _sums(r: np.ndarray, x: np.ndarray) -> tuple:
    return r.sum(axis=0), r.T @ x, r.T @ x**2


def _components(sums: tuple, prior: float, floor: float) -> tuple:
    """(means, variances, what each component adds to a row's fit) from summed responsibilities."""
    size = sums[0] + 1e-10
    mean = sums[1] / size[:, None]
    var = sums[2] / size[:, None] - mean**2 + floor
    rest = size[::-1].cumsum()[::-1] - size
    a, b = 1 + size, prior + rest
    stick = _digamma(a) - _digamma(a + b)
    left = np.concatenate([[0], np.cumsum((_digamma(b) - _digamma(a + b))[:-1])])
    return mean, var, stick + left - 0.5 * (np.log(2 * np.pi * var).sum(-1) + mean.shape[1] / size)


def _responsible(x: np.ndarray, mean: np.ndarray, var: np.ndarray, more: np.ndarray) -> np.ndarray:
    fit = -0.5 * np.stack([((x - m) ** 2 / v).sum(-1) for m, v in zip(mean, var, strict=True)], axis=1) + more
    fit -= fit.max(axis=1, keepdims=True)
    r = np.exp(fit)
    return r / r.sum(axis=1, keepdims=True)


def _floor(n: int, x: np.ndarray, xx: np.ndarray) -> float:
    return max(1e-3 * float((xx / n - (x / n) ** 2).mean()), 1e-6)


def mixture(x: np.ndarray, cap: int, prior: float, seed: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities, weights) of a variational stick-breaking mixture with diagonal Gaussians."""
    r = np.eye(cap)[kmeans(x, min(cap, len(x)), seed, starts=1)[0]] * 0.9 + 0.1 / cap
    floor = _floor(len(x), x.sum(axis=0), (x**2).sum(axis=0))
    for _ in range(rounds):
        r = _responsible(x, *_components(_sums(r, x), prior, floor))
    return r, r.mean(axis=0)


def mixture_grid(points: DataFrame, caps: list[int], priors: list[float], seed: int = 42, rounds: int = 60) -> DataFrame:
    """One row per cell: active components and clusters over all rows, the confidence-weighted silhouette of a sample."""
    rows = Rows(points)
    floor = _floor(rows.n, *rows.fold({0: Fit(1, 0)}, lambda x, number, f: (x.sum(axis=0), (x**2).sum(axis=0)))[0])
    begin = passes.kmeans(rows, {int(cap): Fit(min(int(cap), rows.n), seed) for cap in caps}, starts=1)
    cells = {(int(c), float(p)): Fit(int(c), 0, c=begin[int(c)][0]) for c in caps for p in priors}
    sums = rows.fold(cells, lambda x, number, f: _sums(np.eye(f.k)[passes.nearest(x, f.c)] * 0.9 + 0.1 / f.k, x))
    for _ in range(rounds):
        cells = {(c, p): f._replace(c=_components(sums[c, p], p, floor)) for (c, p), f in cells.items()}
        sums = rows.fold(cells, lambda x, number, f: _sums(_responsible(x, *f.c), x))
    counts = rows.fold(cells, lambda x, number, f: (np.bincount(_responsible(x, *f.c).argmax(axis=1), minlength=f.k),))
    rows.done()
    x = np.array(sample(points, SOFT_MOST).toPandas().sort_values("id")["v"].tolist(), dtype=float)
    d, out = passes.distances(x, x), []
    for (cap, prior), f in cells.items():
        r = _responsible(x, *f.c)
        label, sure = np.unique(r.argmax(axis=1), return_inverse=True)[1], r.max(axis=1)
        soft = -1.0
        if label.max() > 0:
            one = np.eye(label.max() + 1)[label]
            size, near = one.sum(0), d @ one
            a = near[np.arange(len(x)), label] / np.maximum(size[label] - 1, 1)
            m = near / size
            m[np.arange(len(x)), label] = np.inf
            s = np.where(size[label] == 1, 0, (m.min(1) - a) / np.maximum(np.maximum(a, m.min(1)), 1e-300))
            soft = float((sure * s).sum() / sure.sum())
        out.append((cap, prior, int((sums[cap, prior][0] / rows.n > 0.002).sum()), int((counts[cap, prior][0] > 0).sum()), soft))
    return points.sparkSession.createDataFrame(out, "cap long, prior double, active long, clusters long, soft_silhouette double")
