"""Registered queries of the catalogue, vector, validity, selection and state operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import clustering, distances, validity
from tessera.plans.registry import QUERIES, SQL, query, table, vectors
from tessera.streaming import state

# scans, projections, filters


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 25")
def scan_projection(spark, sf):
    return table(spark, sf, "part").where("p_size > 25").select("p_partkey", "p_name", "p_retailprice")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_quantity >= 45")
def prefix_projection(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity >= 45")
    keep = ["l_orderkey", "l_linenumber", *(c for c in rows.columns if c.startswith("l_ship"))]
    return rows.select(*keep)


# text


@query(r"SELECT page_id, regexp_extract(url,'/([0-9]+)',1) AS number FROM pages")
def id_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))


@query("SELECT o_orderkey, rtrim(rtrim(printf('%.6f', o_totalprice),'0'),'.') AS price FROM orders")
def format_scalar(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.format_scalar(F.col("o_totalprice")).alias("price"))


# joins


@query("SELECT r_regionkey, string_agg(n_name,'|' ORDER BY n_name) AS tags FROM region JOIN nation ON r_regionkey=n_regionkey GROUP BY r_regionkey")
def tag_multimap_join(spark, sf):
    tags = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(T.join_tags(F.array_sort(F.collect_list("n_name"))).alias("tags"))
    return table(spark, sf, "region").join(tags, "r_regionkey").select("r_regionkey", "tags")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id")
def left_join_metadata(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT d.doc_id, coalesce(nullif(CAST(l.toxic AS VARCHAR),''), d.source) AS tag FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id")
def coalesce_first_non_blank(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return got.select("doc_id", T.first_non_blank(F.col("toxic").cast("string"), F.col("source")).alias("tag"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def anti_resume(spark, sf):
    return state.resume(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def semi_resume(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n=1")
def last_wins_dedupe(spark, sf):
    return state.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n=1")
def first_wins_dedupe(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.select("event_id", "user_id")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def all_models_present(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type").distinct()
    kinds = e.agg(F.count_distinct("event_type").alias("k"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds)).where("n = k").select("user_id")


# aggregates, windows, sets


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity),6) AS mean_q, round(stddev_samp(l_quantity),6) AS std_q, min(l_quantity) AS min_q, max(l_quantity) AS max_q FROM lineitem GROUP BY l_returnflag")
def multi_stat_groupby(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(q), 6).alias("mean_q"), F.round(F.stddev_samp(q), 6).alias("std_q"), F.min(q).alias("min_q"), F.max(q).alias("max_q")
    )


@query("SELECT o_orderpriority, CAST(median(o_totalprice) AS BIGINT) AS middle FROM orders GROUP BY o_orderpriority")
def median_int(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.bround(F.median("o_totalprice")).cast("long").alias("middle"))


@query("SELECT round(quantile_cont(n,0.1),6) AS p10, round(quantile_cont(n,0.5),6) AS p50, round(quantile_cont(n,0.95),6) AS p95, count(*) FILTER (WHERE n<25) AS under_25 FROM (SELECT l_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY l_orderkey)")
def size_percentiles(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n"))
    ps = [F.round(F.percentile("n", p), 6).alias(a) for p, a in ((0.1, "p10"), (0.5, "p50"), (0.95, "p95"))]
    return n.agg(*ps, F.count_if(F.col("n") < 25).alias("under_25"))


@query("SELECT label, count(*) AS cluster_size, round(count(*)::DOUBLE/(SELECT count(*) FROM embeddings),6) AS ratio FROM embeddings GROUP BY label")
def cluster_profile(spark, sf):
    return validity.profile(vectors(spark, sf)).select("label", "cluster_size", F.round("ratio", 6).alias("ratio"))


@query("SELECT vec_id AS id, count(*) OVER (PARTITION BY label) AS cluster_size FROM embeddings")
def cluster_sizes_window(spark, sf):
    return vectors(spark, sf).select("id", F.count(F.lit(1)).over(Window.partitionBy("label")).alias("cluster_size"))


_GROUPS = "WITH g AS (SELECT l_returnflag AS src, l_linestatus AS algo, CAST(l_linenumber AS BIGINT) AS k, avg(l_extendedprice) AS score, avg(l_discount) AS cost FROM lineitem GROUP BY ALL)"


def _groups(spark, sf) -> DataFrame:
    keys = F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("algo"), F.col("l_linenumber").cast("long").alias("k")
    return table(spark, sf, "lineitem").groupBy(*keys).agg(F.avg("l_extendedprice").alias("score"), F.avg("l_discount").alias("cost"))


def _ranked(spark, sf) -> DataFrame:
    w = Window.partitionBy("src", "algo")
    return _groups(spark, sf).select(
        "src", "algo", "k", F.rank().over(w.orderBy(F.round("score", 6).desc_nulls_last())).cast("long").alias("r1"), F.rank().over(w.orderBy(F.round("cost", 9).asc_nulls_last())).cast("long").alias("r2")
    )


_RANKED = _GROUPS + ", r AS (SELECT src, algo, k, rank() OVER (PARTITION BY src, algo ORDER BY round(score,6) DESC NULLS LAST) AS r1, rank() OVER (PARTITION BY src, algo ORDER BY round(cost,9) ASC NULLS LAST) AS r2 FROM g)"


@query(_RANKED + " SELECT * FROM r")
def rank_within_group(spark, sf):
    return _ranked(spark, sf)


@query(_RANKED + " SELECT src, algo, k, (r1+r2)/2.0::DOUBLE AS overall FROM r")
def overall_rank(spark, sf):
    return _ranked(spark, sf).select("src", "algo", "k", ((F.col("r1") + F.col("r2")) / 2.0).alias("overall"))


@query(_RANKED + " SELECT src, algo, k FROM (SELECT *, row_number() OVER (PARTITION BY src, algo ORDER BY r1+r2, k) AS n FROM r) WHERE n=1")
def group_winner(spark, sf):
    best = F.min_by("k", F.struct((F.col("r1") + F.col("r2")).alias("s"), "k"))
    return _ranked(spark, sf).groupBy("src", "algo").agg(best.alias("k"))


_GAP = "WITH g AS (SELECT CAST(l_linenumber AS BIGINT) AS k, round(avg(l_extendedprice)/1000,6) AS gap, round(stddev_samp(l_extendedprice)/100000,6) AS sk FROM lineitem GROUP BY l_linenumber)"


def _gaps(spark, sf) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("k"))
    return g.agg(F.round(F.avg("l_extendedprice") / 1000, 6).alias("gap"), F.round(F.stddev_samp("l_extendedprice") / 100000, 6).alias("sk"))


@query(_GAP + ", n AS (SELECT *, lead(gap) OVER (ORDER BY k) AS g2, lead(sk) OVER (ORDER BY k) AS s2 FROM g) SELECT coalesce(min(k) FILTER (WHERE gap >= g2 - s2), (SELECT k FROM g ORDER BY gap DESC, k LIMIT 1)) AS k FROM n")
def gap_one_se_rule(spark, sf):
    w = Window.orderBy("k")
    n = _gaps(spark, sf).withColumn("g2", F.lead("gap").over(w)).withColumn("s2", F.lead("sk").over(w))
    return n.agg(F.coalesce(F.min(F.when(F.col("gap") >= F.col("g2") - F.col("s2"), F.col("k"))), F.max_by("k", F.struct("gap", -F.col("k")))).alias("k"))


@query(_GAP + " SELECT coalesce(max(k) FILTER (WHERE gap >= 38), (SELECT k FROM g ORDER BY gap DESC, k LIMIT 1)) AS k FROM g")
def threshold_or_best(spark, sf):
    return _gaps(spark, sf).agg(F.coalesce(F.max(F.when(F.col("gap") >= 38, F.col("k"))), F.max_by("k", F.struct("gap", -F.col("k")))).alias("k"))


@query("SELECT 'customer' AS tag, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def union_with_tag(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("tag"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("tag"), F.col("s_nationkey").alias("nation")))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS c FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("c")).subtract(rich)


@query("SELECT p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 12")
def casefold_sort_topk(spark, sf):
    return table(spark, sf, "part").orderBy(F.lower("p_name"), "p_partkey").limit(12).select("p_partkey")


@query("SELECT doc_id FROM documents ORDER BY md5(concat(CAST(doc_id AS VARCHAR),'|42')), doc_id LIMIT 100")
def hash_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|42")).cast("binary")), "doc_id").limit(100)


# vectors

_E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


@query(_E + " SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x*x))),6) AS norm FROM e")
def vector_norm(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query(_E + " SELECT id, round(list_avg(v),6) AS mean, round(sqrt(list_avg(list_transform(v, lambda x: x*x)) - list_avg(v)*list_avg(v)),6) AS std FROM e")
def series_mean_std(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.mean(F.col("v")), 6).alias("mean"), F.round(V.std_pop(F.col("v")), 6).alias("std"))


@query(_E + ", f AS (SELECT label, unnest(v) AS x, unnest(generate_series(0,63)) AS pos FROM e) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x),6) AS m FROM f GROUP BY label, pos")
def label_centroids(spark, sf):
    return validity.centroids(vectors(spark, sf)).select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"))


_C = _E + ", f AS (SELECT label, unnest(v) AS x, unnest(generate_series(0,63)) AS pos FROM e), p AS (SELECT label, pos, avg(x) AS m FROM f GROUP BY label, pos), c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM p GROUP BY label)"


@query(_C + " SELECT id, e.label, round(list_distance(v, centroid),6) AS distance FROM e JOIN c ON e.label=c.label")
def distance_to_centroid(spark, sf):
    return validity.centroid_distances(vectors(spark, sf)).select("id", "label", F.round("distance", 6).alias("distance"))


@query(_C + " SELECT id, label, distance FROM (SELECT id, c.label, round(list_distance(v, centroid),6) AS distance, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, centroid), c.label) AS n FROM e, c) WHERE n=1")
def nearest_centroid(spark, sf):
    x = vectors(spark, sf)
    return validity.nearest_centroid(x, validity.centroids(x)).select("id", "label", F.round("distance", 6).alias("distance"))


_KNN = _E + ", q AS (SELECT a.id, b.id AS neighbor, a.label AS own, b.label AS other, list_distance(a.v,b.v) AS d FROM e a, e b WHERE a.id<>b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rank FROM q)"


@query(_KNN + " SELECT id, neighbor, round(d,6) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank<=5")
def knn_exact(spark, sf):
    x = vectors(spark, sf)
    return distances.knn(x, x, 5).select("id", "neighbor", F.round("distance", 6).alias("distance"), "rank")


@query(_KNN + ", m AS (SELECT id, own, other, avg(d) AS m FROM q GROUP BY ALL), s AS (SELECT id, own AS label, max(CASE WHEN own=other THEN m END) AS a, min(CASE WHEN own<>other THEN m END) AS b FROM m GROUP BY id, own) SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END,6) AS silhouette FROM s")
def silhouette(spark, sf):
    return validity.silhouette(vectors(spark, sf)).select("id", "label", F.round("silhouette", 6).alias("silhouette"))


@query(_KNN + " SELECT round(min(CASE WHEN own<>other THEN d END)/max(CASE WHEN own=other THEN d END),6) AS dunn FROM q")
def dunn_index(spark, sf):
    return validity.dunn(vectors(spark, sf)).select(F.round("dunn", 6).alias("dunn"))


@query(_C + ", w AS (SELECT e.label, avg(list_distance(v,centroid)) AS s, any_value(centroid) AS c FROM e JOIN c ON e.label=c.label GROUP BY e.label) SELECT round(avg(r),6) AS davies_bouldin FROM (SELECT a.label, max((a.s+b.s)/list_distance(a.c,b.c)) AS r FROM w a JOIN w b ON a.label<>b.label GROUP BY a.label)")
def davies_bouldin(spark, sf):
    return validity.davies_bouldin(vectors(spark, sf)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(_C + ", g AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM f GROUP BY pos)), b AS (SELECT sum(n*power(list_distance(centroid,mean),2)) AS b, count(*) AS k FROM (SELECT label, count(*) AS n FROM e GROUP BY label) z JOIN c ON z.label=c.label, g), w AS (SELECT sum(power(list_distance(v,centroid),2)) AS w, count(*) AS n FROM e JOIN c ON e.label=c.label) SELECT round(b*(n-k)/(w*(k-1)),6) AS calinski_harabasz FROM b, w")
def calinski_harabasz(spark, sf):
    return validity.calinski_harabasz(vectors(spark, sf)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(_KNN + ", k20 AS (SELECT id, neighbor, d FROM k WHERE rank<=20), kd AS (SELECT id, max(d) AS kd FROM k20 GROUP BY id), lrd AS (SELECT k20.id, 1/(avg(greatest(kd.kd,k20.d))+1e-10) AS lrd FROM k20 JOIN kd ON k20.neighbor=kd.id GROUP BY k20.id) SELECT k20.id, round(avg(o.lrd)/any_value(m.lrd),6) AS lof FROM k20 JOIN lrd o ON k20.neighbor=o.id JOIN lrd m ON k20.id=m.id GROUP BY k20.id")
def lof_scores(spark, sf):
    return validity.lof(vectors(spark, sf)).select("id", F.round("lof", 6).alias("lof"))


@query("WITH c AS (SELECT label AS a, vec_id%7 AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n*(n-1)/2.0::DOUBLE) AS s, sum(n) AS t FROM c), x AS (SELECT sum(n*(n-1)/2.0::DOUBLE) AS sa FROM (SELECT a, sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n*(n-1)/2.0::DOUBLE) AS sb FROM (SELECT b, sum(n) AS n FROM c GROUP BY b)) SELECT round((s-sa*sb/(t*(t-1)/2.0::DOUBLE))/((sa+sb)/2-sa*sb/(t*(t-1)/2.0::DOUBLE)),6) AS ari FROM s, x, y")
def adjusted_rand(spark, sf):
    pairs = vectors(spark, sf).select("label", (F.col("id") % 7).alias("b"))
    return validity.adjusted_rand(pairs, "label", "b").select(F.round("ari", 6).alias("ari"))


# grids: rows only, tested against properties


@query()
def kmeans_grid(spark, sf):
    return clustering.kmeans_grid(vectors(spark, sf), list(range(2, 13)))


@query()
def gap_statistic(spark, sf):
    return clustering.gap_statistic(vectors(spark, sf), [2, 4, 6, 8, 10], references=4)


@query()
def prediction_strength(spark, sf):
    return clustering.prediction_strength(vectors(spark, sf), [2, 4, 6, 8, 10], repeats=3)


@query()
def bootstrap_ari(spark, sf):
    return clustering.bootstrap_ari(vectors(spark, sf), 5)


@query()
def hdbscan_grid(spark, sf):
    return clustering.hdbscan_grid(vectors(spark, sf), [10, 20], [3, 5])


@query()
def gmm_grid(spark, sf):
    return clustering.mixture_grid(vectors(spark, sf), [5, 10], [0.01, 1.0])


from tessera.plans import modelling, resolution, selection  # noqa: E402, F401  (they register their queries)

recommend_topk = modelling.recommend_topk

__all__ = ["QUERIES", "SQL", "recommend_topk"]
