"""Registered queries of vectors, neighbours, validity and recommendations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import distances, linear, validity
from tessera.plans.registry import query, table, vectors

_E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_F = _E + ", f AS (SELECT id, label, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM e)"
_KNN = _E + ", q AS (SELECT a.id, b.id AS neighbor, a.label AS own, b.label AS other, list_distance(a.v,b.v) AS d FROM e a, e b WHERE a.id<>b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rank FROM q)"
_C = _F + ", p AS (SELECT label, pos, avg(x) AS m FROM f GROUP BY label, pos), c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM p GROUP BY label)"

# rows and columns


@query("SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 > 2")
def finite_rows(spark, sf):
    """Vectors with a NaN, an infinity or a null go; fewer than three rows are an error."""
    k = F.col("id") % 5
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(0.0)
    rows = vectors(spark, sf).withColumn("v", F.transform("v", lambda x, i: F.when(i == 3, x + odd).otherwise(x)))
    ok = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = rows.where(ok).agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.when(F.col("n") < 3, F.raise_error(F.lit("fewer than three rows"))).otherwise(F.col("n")).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_tax, round(l_quantity + l_extendedprice, 4) AS total FROM lineitem WHERE l_linenumber = 1")
def metadata_split(spark, sf):
    """Columns that are not metadata are features."""
    rows = table(spark, sf, "lineitem").where("l_linenumber = 1")
    features = [c for c in rows.columns if c in ("l_quantity", "l_extendedprice")]
    return rows.select("l_orderkey", "l_linenumber", "l_tax", F.round(sum((F.col(c) for c in features), F.lit(0.0)), 4).alias("total"))


@query("SELECT id, v[1] AS x_0001, v[2] AS x_0002, v[64] AS x_0064 FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def wide_columns(spark, sf):
    return vectors(spark, sf).select("id", *(F.get("v", F.lit(i - 1)).alias(f"x_{i:04d}") for i in (1, 2, 64)))


# vectors


@query(_E + ", n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x*x))) AS s FROM e) SELECT id, list_transform(v, lambda x: round(x / s, 6)) AS u FROM n")
def l2_normalize(spark, sf):
    return vectors(spark, sf).select("id", V.rounded(V.l2_normalize(F.col("v")), 6).alias("u"))


@query(_F + ", m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM f GROUP BY pos) SELECT id, CAST(f.pos AS INTEGER) AS pos, round((x - mean) / std, 6) AS z FROM f JOIN m ON f.pos = m.pos")
def standard_scale(spark, sf):
    return linear.standardized(vectors(spark, sf)).select("id", F.posexplode("v").alias("pos", "z")).select("id", "pos", F.round("z", 6).alias("z"))


@query(_F + ", m AS (SELECT pos, min(x) AS low, CASE WHEN max(x) > min(x) THEN max(x) ELSE min(x) + 1e-9::DOUBLE END AS high, var_pop(x) AS var FROM f GROUP BY pos) SELECT CAST(pos AS INTEGER) AS pos, round(low, 6) AS low, round(high, 6) AS high FROM m")
def bounding_box(spark, sf):
    return linear.moments(vectors(spark, sf)).select("pos", F.round("low", 6).alias("low"), F.round(F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1e-9), 6).alias("high"))


@query(_F + " SELECT round(greatest(0.001::DOUBLE * avg(var), 0.000001::DOUBLE), 9) AS floor FROM (SELECT pos, var_pop(x) AS var FROM f GROUP BY pos)")
def variance_floor(spark, sf):
    return linear.moments(vectors(spark, sf)).agg(F.round(F.greatest(F.lit(1e-3) * F.avg("var"), F.lit(1e-6)), 9).alias("floor"))


@query(_F + ", d AS (SELECT id, pos, x - lag(x) OVER (PARTITION BY id ORDER BY pos) AS dx FROM f) SELECT id, count(dx) AS n, round(sqrt(sum(dx * dx)), 6) AS flux FROM d GROUP BY id")
def flux_first_difference(spark, sf):
    d = V.flux(F.col("v"))
    return vectors(spark, sf).select("id", F.size(d).cast("long").alias("n"), F.round(V.norm(d), 6).alias("flux"))


@query(_E + " SELECT id, round(len(list_filter(v, lambda x: x < list_avg(v)))::DOUBLE / len(v), 6) AS share FROM e")
def low_energy_rate(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.low_share(F.col("v")), 6).alias("share"))


@query(_F + ", a AS (SELECT id, arg_max(pos, x * 1e6::DOUBLE - pos * 1e-9::DOUBLE) AS p, max(x) AS one FROM f GROUP BY id) SELECT a.id, round(one, 6) AS first, round(max(CASE WHEN abs(pos - p) <= 5 THEN 0.0::DOUBLE ELSE x END), 6) AS second FROM a JOIN f ON a.id = f.id GROUP BY a.id, one")
def two_peaks_suppressed(spark, sf):
    return vectors(spark, sf).select("id", F.round(F.array_max("v"), 6).alias("first"), F.round(V.second_peak(F.col("v")), 6).alias("second"))


@query(_E + ", t AS (SELECT id, list_transform(v, lambda x: x * 5) AS w FROM e), m AS (SELECT id, w, list_max(list_transform(w, lambda x: abs(x))) AS top, power(10, -0.05::DOUBLE) AS most FROM t) SELECT id, list_transform(w, lambda x: round(CASE WHEN top > most THEN x * (most / top) ELSE x END, 6)) AS w FROM m")
def peak_cap(spark, sf):
    w = F.transform("v", lambda x: x * 5)
    return vectors(spark, sf).select("id", V.rounded(V.peak_cap(w), 6).alias("w"))


@query(_E + " SELECT id, CASE WHEN n >= 20 THEN len(list_slice(w, (len(w) - 29) // 2 + 1, (len(w) - 29) // 2 + 29)) END AS n, round(list_slice(w, (len(w) - 29) // 2 + 1, (len(w) - 29) // 2 + 29)[1], 6) AS first FROM (SELECT id, len(v) - id % 7 AS n, v[1:len(v) - id % 7] AS w FROM e)")
def center_crop(spark, sf):
    w = F.slice("v", F.lit(1), (F.size("v") - F.col("id") % 7).cast("int"))
    rows = vectors(spark, sf).select("id", V.center_crop(w, 29).alias("c"))
    return rows.select("id", F.size("c").cast("long").alias("n"), F.round(F.get("c", F.lit(0)), 6).alias("first"))


@query(_E + ", s AS (SELECT id, v[1:16] AS a, v[17:64] AS b FROM e), n AS (SELECT id, a, b, sqrt(list_sum(list_transform(a, lambda x: x*x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x*x))) AS nb FROM s) SELECT id, list_concat(list_transform(a, lambda x: round(x / na, 6)), list_transform(b, lambda x: round(x / nb, 6))) AS fused FROM n")
def fuse_normalized(spark, sf):
    return vectors(spark, sf).select("id", V.fuse(F.slice("v", 1, 16), F.slice("v", 17, 48), digits=6).alias("fused"))


@query("SELECT user_id, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(value AS DOUBLE)), 6) AS std FROM events GROUP BY user_id")
def frame_stats(spark, sf):
    """Mean and population deviation of a song's frames."""
    x = F.col("value")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))


@query(_F + ", m AS (SELECT pos, avg(x) AS mean, var_pop(x) AS var FROM f GROUP BY pos) SELECT count(*) AS d, round(sum(var), 6) AS variance FROM m")
def pca_total_variance(spark, sf):
    """The components' variances add up to the columns' own."""
    x = vectors(spark, sf)
    _, axes, shares = linear.components(x)
    total = linear.moments(x).agg(F.sum("var")).first()[0]
    return spark.createDataFrame([(len(axes), round(float(shares.sum()) * total, 6))], "d long, variance double")


@query()
def pca_variance_choice(spark, sf):
    """How many components of the standardised points reach 99 % of their variance."""
    _, _, shares = linear.components(linear.standardized(vectors(spark, sf)))
    k = linear.choose(shares)
    return spark.createDataFrame([(k, round(float(shares[:k].sum()), 6))], "k long, share double")


@query()
def pca_project_2d(spark, sf):
    x = linear.standardized(vectors(spark, sf))
    mean, axes, _ = linear.components(x, 2)
    return linear.projected(x, mean, axes).select("id", F.round(F.get("v", F.lit(0)), 6).alias("x"), F.round(F.get("v", F.lit(1)), 6).alias("y"))


@query()
def knn_approx_lsh(spark, sf):
    """Approximate neighbours by random projections of unit vectors."""
    x = vectors(spark, sf).select("id", V.l2_normalize(F.col("v")).alias("v"))
    return distances.knn_lsh(x, x, 5, 64, length=1.0, tables=12, hashes=3).select("id", "neighbor", F.round("distance", 6).alias("distance"), "rank")


# validity


@query(_KNN + " SELECT own AS a, other AS b, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d FROM q WHERE own <= other GROUP BY ALL")
def pairwise_distance_minmax(spark, sf):
    return distances.extremes(vectors(spark, sf)).select("a", "b", F.round("min_d", 6).alias("min_d"), F.round("max_d", 6).alias("max_d"))


_LOF = _KNN + ", k20 AS (SELECT id, neighbor, d FROM k WHERE rank<=20), kd AS (SELECT id, max(d) AS kd FROM k20 GROUP BY id), lrd AS (SELECT k20.id, 1/(avg(greatest(kd.kd,k20.d))+1e-10) AS lrd FROM k20 JOIN kd ON k20.neighbor=kd.id GROUP BY k20.id), l AS (SELECT k20.id, avg(o.lrd)/any_value(m.lrd) AS lof FROM k20 JOIN lrd o ON k20.neighbor=o.id JOIN lrd m ON k20.id=m.id GROUP BY k20.id)"


@query(_LOF + " SELECT id, -lof >= (SELECT quantile_cont(-lof, 0.05) FROM l) AS inlier FROM l")
def lof_inliers(spark, sf):
    return validity.lof_inliers(vectors(spark, sf))


_NOISE = _E.replace("label FROM embeddings", "CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM embeddings") + ", f AS (SELECT label, unnest(v) AS x, unnest(generate_series(0, 63)) AS pos FROM e WHERE label <> -1), p AS (SELECT label, pos, avg(x) AS m FROM f GROUP BY label, pos), c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM p GROUP BY label), d AS (SELECT quantile_cont(list_distance(v, centroid), 0.95) AS p95 FROM e JOIN c ON e.label = c.label), n AS (SELECT id, c.label AS nearest, list_distance(v, centroid) AS dist, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, centroid), c.label) AS r FROM e, c WHERE e.label = -1)"


@query(_NOISE + " SELECT e.id, e.label, CASE WHEN e.label = -1 THEN nearest ELSE e.label END AS new_label, round(CASE WHEN e.label <> -1 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - dist / (p95 + 1e-12::DOUBLE))) END, 6) AS confidence FROM e LEFT JOIN n ON e.id = n.id AND r = 1, d")
def noise_reassign_confidence(spark, sf):
    x = vectors(spark, sf).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return validity.noise_reassigned(x).select("id", "label", "new_label", F.round("confidence", 6).alias("confidence"))


_P = _C + ", x AS (SELECT id, c.label, exp(-list_distance(v, centroid)) AS w FROM e, c), s AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS p FROM x)"


def _shares(spark, sf) -> DataFrame:
    x = vectors(spark, sf)
    return validity.memberships(x, validity.centroids(x))


@query(_P + " SELECT id, round(max(p), 6) AS confidence, round(-sum(p * ln(greatest(p, 1e-12::DOUBLE))), 6) AS entropy FROM s GROUP BY id")
def membership_entropy(spark, sf):
    return validity.entropy(_shares(spark, sf)).select("id", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"))


@query(_P + ", q AS (SELECT a.id, a.label AS own, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL), z AS (SELECT id, max(CASE WHEN own=other THEN m END) AS a, min(CASE WHEN own<>other THEN m END) AS b FROM q GROUP BY id), w AS (SELECT id, max(p) AS w FROM s GROUP BY id) SELECT round(sum(w * CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) / sum(w), 6) AS soft_silhouette FROM z JOIN w ON z.id = w.id")
def soft_silhouette(spark, sf):
    weights = _shares(spark, sf).select("id", F.array_max("p").alias("weight"))
    return validity.soft_silhouette(vectors(spark, sf), weights).select(F.round("soft_silhouette", 6).alias("soft_silhouette"))


_RANKS = "row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.{0}, b.{0}), b.id)"


@query(f"WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding AS DOUBLE[])[1:8] AS u FROM embeddings), r AS (SELECT a.id, {_RANKS.format('v')} AS high, {_RANKS.format('u')} AS low FROM e a JOIN e b ON a.id <> b.id), n AS (SELECT count(*) AS n FROM e) SELECT round(1 - 2.0::DOUBLE / (n * 10 * (2 * n - 31)) * sum(CASE WHEN low <= 10 THEN greatest(high - 10, 0) ELSE 0 END), 6) AS trustworthiness FROM r, n GROUP BY n")
def trustworthiness(spark, sf):
    x = vectors(spark, sf)
    low = x.select("id", F.slice("v", 1, 8).alias("v"))
    return validity.trustworthiness(x, low).select(F.round("trustworthiness", 6).alias("trustworthiness"))


# recommendations

#: Labels of several algorithms for each point, the first of which is the active one; -1 of the third is noise.
ALGORITHMS = ["kmeans", "gmm", "hdbscan"]


def _labelled(spark, sf) -> DataFrame:
    rows = vectors(spark, sf)
    noise = F.when(F.col("id") % 9 == 0, -1).otherwise((F.col("id") % 4).cast("int"))
    return linear.standardized(rows).select("id", "v", F.array("label", F.floor(F.col("label") / 2).cast("int"), noise).alias("labels"))


def agreement(own, other):
    """How many algorithms give both points one cluster; noise of the third is none."""
    both = F.zip_with(own, other, lambda a, b: a == b)
    return F.size(F.filter(F.transform(both, lambda same, i: same & ((i != 2) | (F.get(own, i) != -1))), lambda x: x))


def recommend(points: DataFrame, k: int = 5) -> DataFrame:
    """``id, neighbor, distance, agreement, same, place`` from the nearest ``max(20 k, 60)`` points, the point itself counted.

    Those of the active algorithm's cluster come first, by distance, agreement and id; then the others, by
    agreement, distance and id.
    """
    near = distances.knn(points, points, max(20 * k, 60) - 1)
    own = points.select("id", F.col("labels").alias("own"))
    other = points.select(F.col("id").alias("neighbor"), F.col("labels").alias("other"))
    near = near.join(own, "id").join(other, "neighbor")
    agree = agreement(F.col("own"), F.col("other"))
    same = F.get("own", F.lit(0)) == F.get("other", F.lit(0))
    d = F.round("distance", 9)
    order = F.when(same, F.struct(F.lit(0).alias("tier"), d.alias("a"), (-agree).cast("double").alias("b"))).otherwise(F.struct(F.lit(1).alias("tier"), (-agree).cast("double").alias("a"), d.alias("b")))
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("neighbor"), F.col("distance"), agree.alias("agreement"), same.alias("same")))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("place", "b")).select("id", "b.neighbor", "b.distance", "b.agreement", "b.same", (F.col("place") + 1).alias("place"))


_RECOMMEND = (
    _F + ", m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM f GROUP BY pos), z AS (SELECT id, list((x - mean) / std ORDER BY f.pos) AS v FROM f JOIN m ON f.pos = m.pos GROUP BY id), "
    "l AS (SELECT z.id, z.v, label AS l1, label // 2 AS l2, CASE WHEN z.id % 9 = 0 THEN -1 ELSE z.id % 4 END AS l3 FROM z JOIN e ON z.id = e.id), "
    "q AS (SELECT a.id, b.id AS neighbor, list_distance(a.v, b.v) AS d, a.l1 = b.l1 AS same, (a.l1 = b.l1)::INT + (a.l2 = b.l2)::INT + (a.l3 = b.l3 AND a.l3 <> -1)::INT AS agreement FROM l a, l b WHERE a.id <> b.id), "
    "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS r FROM q) WHERE r <= 99), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN round(d, 9) ELSE -agreement END, CASE WHEN same THEN -agreement ELSE round(d, 9) END, neighbor) AS place FROM n)"
)


@query(_RECOMMEND + " SELECT id, neighbor, agreement, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5")
def recommend_topk(spark, sf):
    return recommend(_labelled(spark, sf)).select("id", "neighbor", "agreement", "place")


@query(_RECOMMEND + " SELECT id, neighbor, CASE WHEN same THEN 'same KMEANS cluster, ' ELSE '' END || CASE agreement WHEN 0 THEN '' WHEN 1 THEN '1 clustering algorithm agree, ' ELSE CAST(agreement AS VARCHAR) || ' clustering algorithms agree, ' END || 'close in feature space' AS reason FROM o WHERE place <= 5 AND id % 10 = 3")
def recommend_reasons(spark, sf):
    """The reasons of the recommendations of some anchors, as a service asks for them."""
    x = _labelled(spark, sf)
    got = recommend(x).where("id % 10 = 3")
    return got.select("id", "neighbor", T.reason(F.when(F.col("same"), F.lit(ALGORITHMS[0])), F.col("agreement")).alias("reason"))


@query("SELECT vec_id AS id, '{\"kmeans\":' || label || ',\"gmm\":' || label // 2 || '}' AS clusters FROM embeddings")
def nested_clusters(spark, sf):
    """One field for each algorithm, as JSON for a service."""
    return vectors(spark, sf).select("id", F.to_json(F.struct(F.col("label").alias("kmeans"), F.floor(F.col("label") / 2).cast("int").alias("gmm"))).alias("clusters"))


@query("SELECT e.vec_id AS id, e.label AS kmeans_label, g.label AS gmm_label, h.score AS hdbscan_score FROM embeddings e LEFT JOIN (SELECT vec_id, label // 2 AS label FROM embeddings WHERE vec_id % 3 <> 0) g ON g.vec_id = e.vec_id LEFT JOIN (SELECT vec_id, round(vec_id / 7.0::DOUBLE, 4) AS score FROM embeddings WHERE vec_id % 5 <> 0) h ON h.vec_id = e.vec_id")
def assignment_chain(spark, sf):
    """One left join for each algorithm's assignments, renamed by its prefix; all on one key, so one shuffle each at most."""
    base = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kmeans_label"))
    gmm = table(spark, sf, "embeddings").where("vec_id % 3 != 0").select(F.col("vec_id").alias("id"), F.floor(F.col("label") / 2).cast("int").alias("label"))
    hdbscan = table(spark, sf, "embeddings").where("vec_id % 5 != 0").select(F.col("vec_id").alias("id"), F.round(F.col("vec_id") / 7.0, 4).alias("score"))
    for name, frame in (("gmm", gmm), ("hdbscan", hdbscan)):
        base = base.join(frame.withColumnsRenamed({c: f"{name}_{c}" for c in frame.columns if c != "id"}), "id", "left")
    return base


@query("SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS ratio, (SELECT count(*) FROM embeddings WHERE label = 0) AS noise, (SELECT round(avg(c), 6) FROM (SELECT count(*) AS c FROM embeddings WHERE label <> 0 GROUP BY label)) AS mean_size, (SELECT median(c) FROM (SELECT count(*) AS c FROM embeddings WHERE label <> 0 GROUP BY label)) AS median_size FROM embeddings WHERE label <> 0 GROUP BY label")
def cluster_profile_full(spark, sf):
    """Sizes of the clusters, with the mean, the median and the noise beside each; counts first, so no window over rows."""
    sizes = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("noise"), F.round(F.avg(F.when(F.col("label") != 0, F.col("n"))), 6).alias("mean_size"), F.median(F.when(F.col("label") != 0, F.col("n"))).alias("median_size"))
    return sizes.where("label != 0").join(F.broadcast(whole)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"), "noise", "mean_size", "median_size")


