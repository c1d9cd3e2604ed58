"""Cluster validity from labelled points: ``id, v (array<double>), label``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V
from tessera.operators.distances import extremes, knn, label_sums, ranks


def centroids(points: DataFrame) -> DataFrame:
    """``label, centroid, n`` by position-wise means."""
    flat = points.select("label", F.posexplode("v").alias("pos", "x"))
    means = flat.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def centroid_distances(points: DataFrame) -> DataFrame:
    """Each point's distance to the centroid of its own label."""
    return points.join(centroids(points), "label").select("id", "label", V.distance(F.col("v"), F.col("centroid")).alias("distance"))


#: Centroids that are broadcast, at most; more of them are blocks of a join.
CENTROIDS = 10_000


def nearest_centroid(points: DataFrame, centers: DataFrame, most: int = CENTROIDS) -> DataFrame:
    """Arg-min over the centroids, ties by label: they are broadcast if there are few, else it is a block join."""
    if centers.limit(most + 1).count() > most:
        near = knn(points, centers.select(F.col("label").alias("id"), F.col("centroid").alias("v")), 1, keep_self=True)
        return near.select("id", F.col("neighbor").alias("label"), "distance")
    packed = centers.select("label", "centroid").agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    scored = points.select("id", "v").join(F.broadcast(packed)).select("id", F.array_min(F.transform("all", lambda c: F.struct(V.distance(F.col("v"), c["centroid"]).alias("d"), c["label"].alias("label")))).alias("best"))
    return scored.select("id", F.col("best.label").alias("label"), F.col("best.d").alias("distance"))


def silhouette(points: DataFrame) -> DataFrame:
    """``id, label, silhouette`` with Euclidean distances; a cluster of one scores 0."""
    s = label_sums(points).withColumn("m", F.col("sum_d") / F.col("n"))
    own = F.max(F.when(F.col("own") == F.col("label"), F.col("m")))
    other = F.min(F.when(F.col("own") != F.col("label"), F.col("m")))
    ab = s.groupBy("id", F.col("own").alias("label")).agg(own.alias("a"), other.alias("b"))
    return ab.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def dispersion(points: DataFrame) -> DataFrame:
    """One row ``n, k, between, within`` of sums of squares."""
    centers = centroids(points)
    mean = points.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    between = centers.join(F.broadcast(mean)).agg(F.sum(F.col("n") * F.pow(V.distance(F.col("centroid"), F.col("mean")), F.lit(2.0))).alias("between"), F.count(F.lit(1)).alias("k"))
    within = centroid_distances(points).agg(F.sum(F.col("distance") * F.col("distance")).alias("within"), F.count(F.lit(1)).alias("n"))
    return between.join(F.broadcast(within)).select("n", "k", "between", "within")


def calinski_harabasz(points: DataFrame) -> DataFrame:
    ch = F.when(F.col("within") == 0, 1.0).otherwise(F.col("between") * (F.col("n") - F.col("k")) / (F.col("within") * (F.col("k") - 1)))
    return dispersion(points).select(ch.alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    spread = centroid_distances(points).groupBy("label").agg(F.avg("distance").alias("s")).join(centroids(points), "label")
    a = spread.select(F.col("label").alias("i"), F.col("s").alias("si"), F.col("centroid").alias("ci"))
    b = spread.select(F.col("label").alias("j"), F.col("s").alias("sj"), F.col("centroid").alias("cj"))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / V.distance(F.col("ci"), F.col("cj"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def dunn(points: DataFrame) -> DataFrame:
    """Smallest distance between clusters over the largest within one; label -1 is noise.

    Null with fewer than two clusters, fewer points than twice the clusters, or an extreme that is not positive.
    """
    inliers = points.where("label != -1")
    size = inliers.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k"))
    ends = extremes(inliers).agg(F.min(F.when(F.col("a") != F.col("b"), F.col("min_d"))).alias("gap"), F.max(F.when(F.col("a") == F.col("b"), F.col("max_d"))).alias("diameter"))
    ok = (F.col("k") >= 2) & (F.col("n") >= 2 * F.col("k")) & (F.col("diameter") > 0) & (F.col("gap") > 0)
    return ends.join(F.broadcast(size)).select(F.when(ok, F.col("gap") / F.col("diameter")).alias("dunn"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` from two label columns."""
    two = lambda n: n * (n - 1) / 2.0
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    sa = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    sb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    e = F.col("sa") * F.col("sb") / two(F.col("t"))
    top = (F.col("sa") + F.col("sb")) / 2
    return s.join(sa).join(sb).select(F.when(top == e, 1.0).otherwise((F.col("s") - e) / (top - e)).alias("ari"))


def lof(points: DataFrame, k: int = 20) -> DataFrame:
    """``id, lof`` from k-distances, reachability and local densities."""
    near = knn(points, points, k)
    kd = near.groupBy("id").agg(F.max("distance").alias("kd"))
    reach = near.join(kd.select(F.col("id").alias("neighbor"), "kd"), "neighbor").withColumn("reach", F.greatest("kd", "distance"))
    lrd = reach.groupBy("id").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    around = near.join(lrd.select(F.col("id").alias("neighbor"), F.col("lrd").alias("other")), "neighbor").groupBy("id").agg(F.avg("other").alias("other"))
    return around.join(lrd, "id").select("id", (F.col("other") / F.col("lrd")).alias("lof"))


def lof_inliers(points: DataFrame, k: int = 20, contamination: float = 0.05, least: int = 10) -> DataFrame:
    """``id, inlier``: the rows whose factor is among the largest ``contamination`` are out; all stay if that leaves fewer than ``least``."""
    scores = lof(points, k)
    bound = scores.agg(F.percentile(-F.col("lof"), contamination).alias("bound"))
    marked = scores.join(F.broadcast(bound)).select("id", (-F.col("lof") >= F.col("bound")).alias("inlier"))
    few = marked.agg((F.count_if("inlier") < least).alias("few"))
    return marked.join(F.broadcast(few)).select("id", (F.col("inlier") | F.col("few")).alias("inlier"))


def trustworthiness(high: DataFrame, low: DataFrame, k: int = 10) -> DataFrame:
    """One row; ``high`` and ``low`` hold the same ids with their vectors in either space; ``k`` is clamped to ``2 .. n // 2 - 1``."""
    n = high.count()
    k = max(2, min(k, n // 2 - 1))
    far = ranks(high, knn(low, low, k, n=n)).where(F.col("rank") > k)
    return far.agg((1 - 2.0 / (n * k * (2.0 * n - 3 * k - 1)) * F.coalesce(F.sum(F.col("rank") - k), F.lit(0))).alias("trustworthiness"))


def noise_reassigned(points: DataFrame, noise: int = -1) -> DataFrame:
    """``id, label, new_label, confidence, outlier_score``: noise goes to the nearest centroid of the clusters.

    Confidence is 1 for clustered points, else ``1 - d / p95`` between 0 and 1, where p95 is that of all
    clustered points' distances to their centroid; without clusters nothing changes.
    """
    clustered = points.where(F.col("label") != noise)
    centers = centroids(clustered)
    p95 = centroid_distances(clustered).agg(F.percentile("distance", 0.95).alias("p95"))
    near = nearest_centroid(points.where(F.col("label") == noise), centers).select("id", F.col("label").alias("nearest"), "distance")
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / (F.col("p95") + 1e-12)))
    out = points.select("id", "label").join(near, "id", "left").join(F.broadcast(p95))
    out = out.select("id", "label", F.coalesce("nearest", "label").alias("new_label"), F.when(F.col("label") != noise, 1.0).when(F.col("nearest").isNull(), 0.0).otherwise(trust).alias("confidence"))
    return out.withColumn("outlier_score", 1 - F.col("confidence"))


def soft_silhouette(points: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: silhouettes weighted by ``weights`` (``id, weight``); a single label or no weight at all is -1."""
    s = silhouette(points).join(weights, "id")
    got = s.agg(F.count_distinct("label").alias("k"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("silhouette")).alias("ws"))
    return got.select(F.when((F.col("k") > 1) & (F.col("w") > 0), F.col("ws") / F.col("w")).otherwise(-1.0).alias("soft_silhouette"))


def memberships(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``id, p``: shares of the centers by label order, from a softmax of minus the distance; the centers must fit a broadcast."""
    if centers.limit(CENTROIDS + 1).count() > CENTROIDS:
        raise ValueError(f"more than {CENTROIDS} components")
    packed = centers.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("all"))
    e = points.select("id", "v").join(F.broadcast(packed)).select("id", F.transform("all", lambda c: F.exp(-V.distance(F.col("v"), c["centroid"]))).alias("e"))
    total = V.total(F.col("e"))
    return e.select("id", F.transform("e", lambda x: x / total).alias("p"))


def entropy(shares: DataFrame) -> DataFrame:
    """``id, confidence, entropy``: the largest share, and the entropy of all of them."""
    h = -V.total(F.transform("p", lambda x: x * F.log(F.greatest(x, F.lit(1e-12)))))
    return shares.select("id", F.array_max("p").alias("confidence"), h.alias("entropy"))


def profile(points: DataFrame) -> DataFrame:
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("cluster_size"))
    return sizes.withColumn("ratio", F.col("cluster_size") / F.sum("cluster_size").over(Window.partitionBy()))
