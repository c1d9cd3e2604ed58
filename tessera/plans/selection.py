"""Registered queries that choose among fits, and of samples, grids and reports, each beside its SQL.

A frame of metrics by K stands for the grids' results: it is derived from line items, so SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import query, table

_M = """WITH m AS (SELECT CAST(l_linenumber + 1 AS BIGINT) AS k, CASE WHEN l_linenumber = 4 THEN 'failed' ELSE 'ok' END AS status, round(avg(l_extendedprice) / 1000, 6) AS gap, round(stddev_samp(l_extendedprice) / 100000, 6) AS sk,
round(avg(l_discount) * 16, 6) AS ps, round(avg(l_quantity) / 50, 6) AS sil, round(avg(l_extendedprice * l_discount), 6) AS ch, round(avg(l_tax), 9) AS db, round(avg(l_tax) * 18.8, 6) AS ari, count(*) // 40 AS smallest FROM lineitem GROUP BY l_linenumber)"""


def _metrics(spark, sf) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.avg("l_extendedprice") / 1000, 6).alias("gap"), F.round(F.stddev_samp("l_extendedprice") / 100000, 6).alias("sk"), F.round(F.avg("l_discount") * 16, 6).alias("ps"), F.round(F.avg("l_quantity") / 50, 6).alias("sil"),
        F.round(F.avg(F.col("l_extendedprice") * F.col("l_discount")), 6).alias("ch"), F.round(F.avg("l_tax"), 9).alias("db"), F.round(F.avg("l_tax") * 18.8, 6).alias("ari"), F.floor(F.count(F.lit(1)) / 40).alias("smallest"),
    )
    status = F.when(F.col("l_linenumber") == 4, "failed").otherwise("ok")
    return g.select((F.col("l_linenumber") + 1).cast("long").alias("k"), status.alias("status"), "gap", "sk", "ps", "sil", "ch", "db", "ari", "smallest")


def decision(metrics: DataFrame, threshold: float = 0.80) -> DataFrame:
    """One row: the gap rule's K, prediction strength's K and rule, whether they support each other, and the best K of each score."""
    w = Window.orderBy("k")
    n = metrics.withColumn("g2", F.lead("gap").over(w)).withColumn("s2", F.lead("sk").over(w))
    k, first = F.col("k"), -F.col("k")
    finite = F.when(~F.isnan("ps"), F.col("ps"))
    out = n.agg(
        F.coalesce(F.min(F.when(F.col("gap") >= F.col("g2") - F.col("s2"), k)), F.max_by("k", F.struct("gap", first))).alias("gap_k"),
        F.max(F.when(finite >= threshold, k)).alias("reached"), F.max_by(F.when(finite.isNotNull(), k), F.when(finite.isNotNull(), F.struct(finite.alias("x"), first.alias("y")))).alias("best"),
        F.max_by("k", F.struct("sil", first)).alias("silhouette_k"), F.max_by("k", F.struct("ch", first)).alias("ch_k"), F.min_by("k", F.struct("db", "k")).alias("db_k"),
    )
    ps = F.coalesce("reached", "best")
    rule = F.when(F.col("reached").isNotNull(), f"largest_k_with_prediction_strength_ge_{threshold:.2f}").when(F.col("best").isNotNull(), "no_k_reached_threshold_using_best_prediction_strength").otherwise("prediction_strength_not_computed")
    support = F.when(ps.isNull(), "gap_selected_without_prediction_strength").when(F.abs(ps - F.col("gap_k")) <= 1, "gap_and_prediction_strength_agree_or_are_adjacent").otherwise("gap_and_prediction_strength_disagree")
    return out.select("gap_k", ps.alias("ps_k"), rule.alias("ps_rule"), support.alias("support"), (support == "gap_and_prediction_strength_disagree").alias("review"), "silhouette_k", "ch_k", "db_k")


_GAP = "coalesce((SELECT min(k) FROM n WHERE gap >= g2 - s2), (SELECT k FROM m ORDER BY gap DESC, k LIMIT 1))"


def _decision_sql(threshold: float) -> str:
    return (
        _M + ", n AS (SELECT *, lead(gap) OVER (ORDER BY k) AS g2, lead(sk) OVER (ORDER BY k) AS s2 FROM m), "
        f"d AS (SELECT {_GAP} AS gap_k, (SELECT max(k) FROM m WHERE ps >= {threshold}) AS reached, (SELECT k FROM m ORDER BY ps DESC, k LIMIT 1) AS best) "
        f"SELECT gap_k, coalesce(reached, best) AS ps_k, CASE WHEN reached IS NOT NULL THEN 'largest_k_with_prediction_strength_ge_{threshold:.2f}' ELSE 'no_k_reached_threshold_using_best_prediction_strength' END AS ps_rule, "
        "CASE WHEN abs(coalesce(reached, best) - gap_k) <= 1 THEN 'gap_and_prediction_strength_agree_or_are_adjacent' ELSE 'gap_and_prediction_strength_disagree' END AS support, abs(coalesce(reached, best) - gap_k) > 1 AS review, "
        "(SELECT k FROM m ORDER BY sil DESC, k LIMIT 1) AS silhouette_k, (SELECT k FROM m ORDER BY ch DESC, k LIMIT 1) AS ch_k, (SELECT k FROM m ORDER BY db, k LIMIT 1) AS db_k FROM d"
    )


@query(_decision_sql(0.8))
def decision_support(spark, sf):
    return decision(_metrics(spark, sf))


@query(_decision_sql(0.99).replace("SELECT gap_k, ", "SELECT ps_rule, support FROM (SELECT gap_k, ", 1) + ")")
def decision_without_threshold(spark, sf):
    """The same where no K reaches the threshold."""
    return decision(_metrics(spark, sf), 0.99).select("ps_rule", "support")


def recommended(summary: DataFrame, ari: float = 0.75, smallest: int = 50) -> DataFrame:
    """One row: the largest K that is stable and has no small cluster, else the best by average rank, the larger K on a tie."""
    rank = lambda c: F.rank().over(Window.orderBy(c))
    ranks = [rank(F.col("ari").desc_nulls_last()), rank(F.col("sil").desc_nulls_last()), rank(F.col("db").asc_nulls_last()), rank(F.col("smallest").desc_nulls_last())]
    ranked = summary.withColumn("overall", sum(ranks[1:], ranks[0]) / len(ranks))
    ok = (F.col("ari") >= ari) & (F.col("smallest") >= smallest)
    out = ranked.agg(F.max(F.when(ok, F.col("k"))).alias("eligible"), F.min_by("k", F.struct("overall", -F.col("k"))).alias("best"))
    rule = F.when(F.col("eligible").isNotNull(), f"largest_candidate_with_mean_ari_ge_{ari:.2f}_and_min_cluster_size_ge_{smallest}").otherwise("no_candidate_passed_thresholds_using_best_average_rank")
    return out.select(F.coalesce("eligible", "best").alias("k"), rule.alias("rule"))


def _recommended_sql(ari: float, smallest: int) -> str:
    return (
        _M + f", o AS (SELECT * FROM m WHERE status = 'ok'), r AS (SELECT k, (rank() OVER (ORDER BY ari DESC) + rank() OVER (ORDER BY sil DESC) + rank() OVER (ORDER BY db) + rank() OVER (ORDER BY smallest DESC)) / 4.0::DOUBLE AS overall FROM o), "
        f"e AS (SELECT max(k) AS k FROM o WHERE ari >= {ari} AND smallest >= {smallest}) SELECT coalesce(e.k, (SELECT k FROM r ORDER BY overall, k DESC LIMIT 1)) AS k, "
        f"CASE WHEN e.k IS NOT NULL THEN 'largest_candidate_with_mean_ari_ge_{ari:.2f}_and_min_cluster_size_ge_{smallest}' ELSE 'no_candidate_passed_thresholds_using_best_average_rank' END AS rule FROM e"
    )


@query(_recommended_sql(0.75, 50))
def largest_eligible(spark, sf):
    return recommended(_metrics(spark, sf).where("status = 'ok'"))


@query(_recommended_sql(0.99, 50))
def best_average_rank(spark, sf):
    return recommended(_metrics(spark, sf).where("status = 'ok'"), ari=0.99)


@query(_M + " SELECT coalesce(max(k) FILTER (WHERE ps >= 0.8), (SELECT k FROM m ORDER BY ps DESC, k LIMIT 1)) AS k FROM m")
def prediction_strength_pick(spark, sf):
    return decision(_metrics(spark, sf)).select(F.col("ps_k").alias("k"))


@query(_M + " SELECT k, rank() OVER (ORDER BY ari DESC NULLS LAST) AS by_ari, rank() OVER (ORDER BY db ASC NULLS LAST) AS by_db FROM m WHERE status = 'ok'")
def global_rank(spark, sf):
    """Ranks over all fits, of which there are few."""
    rank = lambda c: F.rank().over(Window.orderBy(c)).cast("long")
    return _metrics(spark, sf).where("status = 'ok'").select("k", rank(F.col("ari").desc_nulls_last()).alias("by_ari"), rank(F.col("db").asc_nulls_last()).alias("by_db"))


@query(_M + ", r AS (SELECT k, rank() OVER (ORDER BY sil DESC) AS a, rank() OVER (ORDER BY ch DESC) AS b FROM m) SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same, round(1 - 6.0::DOUBLE * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM r")
def rank_agreement(spark, sf):
    """How far two scores rank the fits alike."""
    rank = lambda c: F.rank().over(Window.orderBy(c))
    r = _metrics(spark, sf).select(rank(F.col("sil").desc()).alias("a"), rank(F.col("ch").desc()).alias("b"))
    n, d = F.count(F.lit(1)), F.col("a") - F.col("b")
    return r.agg(n.alias("n"), F.count_if(d == 0).alias("same"), F.round(1 - 6.0 * F.sum(d * d) / (n * (n * n - 1)), 6).alias("rho"))


@query(_M + " SELECT k, gap FROM m WHERE isfinite(CASE WHEN k % 3 = 0 THEN 'NaN'::DOUBLE ELSE gap END) AND status = 'ok'")
def finite_metric(spark, sf):
    x = F.when(F.col("k") % 3 == 0, float("nan")).otherwise(F.col("gap"))
    return _metrics(spark, sf).where((F.col("status") == "ok") & ~F.isnan(x)).select("k", "gap")


@query(_M + ", b AS (SELECT k, sil, status FROM m WHERE k % 2 = 0) SELECT m.k, m.gap, b.sil, coalesce(b.status, 'requires_review') AS note FROM m LEFT JOIN b ON m.k = b.k")
def metric_merge(spark, sf):
    """Metric frames side by side; what a second frame lacks is to be reviewed."""
    m = _metrics(spark, sf)
    b = m.where("k % 2 = 0").select("k", "sil", "status")
    return m.select("k", "gap").join(F.broadcast(b), "k", "left").select("k", "gap", "sil", F.coalesce("status", F.lit("requires_review")).alias("note"))


@query(_M + " SELECT k, sil FROM m WHERE k = (SELECT max(k) FROM m WHERE status = 'ok') AND status = 'ok'")
def metric_row_lookup(spark, sf):
    """The one row of a fit, by its parameters."""
    m = _metrics(spark, sf)
    chosen = m.where("status = 'ok'").agg(F.max("k").alias("k")).withColumn("status", F.lit("ok"))
    return m.join(F.broadcast(chosen), ["k", "status"], "left_semi").select("k", "sil").limit(1)


@query("SELECT l_returnflag AS src, count(*) FILTER (WHERE n < 25) AS under_25, count(*) FILTER (WHERE n < 50) AS under_50, count(*) FILTER (WHERE n < 100) AS under_100, min(n) AS smallest, max(n) AS largest FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def threshold_counts(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("src"), "l_suppkey").agg(F.sum("l_quantity").alias("n"))
    return n.groupBy("src").agg(*(F.count_if(F.col("n") < t).alias(f"under_{t}") for t in (25, 50, 100)), F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query("SELECT l_linenumber AS k, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS finite FROM (SELECT l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS x FROM lineitem) GROUP BY 1")
def repeat_mean_std(spark, sf):
    """Mean and population deviation of repeats, those that are NaN left out and the rest counted."""
    x = F.when(F.col("l_orderkey") % 3 == 0, float("nan")).otherwise(F.col("l_tax"))
    v = F.when(~F.isnan(x), x)
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.count(v).alias("finite"))


@query("SELECT l_linenumber AS k, round(avg(ln(l_extendedprice + 1e-12::DOUBLE)), 6) AS mean, round(sqrt(1 + 1 / 10.0::DOUBLE) * stddev_samp(ln(l_extendedprice + 1e-12::DOUBLE)), 6) AS sk FROM lineitem GROUP BY 1")
def reference_log_stats(spark, sf):
    w = F.log(F.col("l_extendedprice") + 1e-12)
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg(w), 6).alias("mean"), F.round(F.sqrt(F.lit(1 + 1 / 10)) * F.stddev_samp(w), 6).alias("sk"))


@query("SELECT count(DISTINCT l_returnflag) AS sources, count(DISTINCT l_linestatus) AS algorithms, count(DISTINCT l_linenumber) AS ks FROM lineitem")
def dimension_counts(spark, sf):
    """How many values each dimension has; distinct rows first, so one pass."""
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
    return d.agg(F.count_distinct("l_returnflag").alias("sources"), F.count_distinct("l_linestatus").alias("algorithms"), F.count_distinct("l_linenumber").alias("ks"))


@query("SELECT a, b, n, CAST(n * (n - 1) // 2 AS BIGINT) AS pairs FROM (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL)")
def contingency(spark, sf):
    cells = table(spark, sf, "embeddings").groupBy(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2))


@query("SELECT n, array_to_string(list_sort(list_distinct([greatest(2, least(60, n - 1)), 2])), ',') AS ks, array_to_string(list_sort(list_distinct(list_concat([10, 15, 20, 25, 30, 35, 40], [greatest(10, n // 200), greatest(10, n // 100), greatest(10, CAST(floor(sqrt(n) / 2) AS BIGINT))]))), ',') AS sizes FROM (SELECT count(*) AS n FROM embeddings UNION ALL SELECT count(*) FROM lineitem)")
def candidate_grids(spark, sf):
    """The bounds of a K grid, and the sizes of a density grid, by the number of rows."""
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).unionByName(table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n")))
    size = F.col("n")
    ks = F.array_sort(F.array_distinct(F.array(F.greatest(F.lit(2), F.least(F.lit(60), size - 1)), F.lit(2).cast("long"))))
    some = F.array(*(F.lit(x).cast("long") for x in range(10, 41, 5)), *(F.greatest(F.lit(10).cast("long"), x) for x in (F.floor(size / 200), F.floor(size / 100), F.floor(F.sqrt(size) / 2))))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return n.select("n", text(ks).alias("ks"), text(F.array_sort(F.array_distinct(some))).alias("sizes"))


@query("SELECT k, b, 42 + k AS fit_seed, 42 + 1000000 + 10000 * k + b AS reference_seed, 42 + 2000000 + 10000 * k + b AS split_seed FROM (SELECT unnest(generate_series(2, 12)) AS k), (SELECT unnest(generate_series(1, 5)) AS b)")
def cell_seeds(spark, sf):
    """Each cell's own seeds."""
    cells = spark.range(2, 13).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("b"))
    seed, k, b = F.lit(42).cast("long"), F.col("k"), F.col("b")
    return cells.select("k", "b", (seed + k).alias("fit_seed"), (seed + 1_000_000 + 10_000 * k + b).alias("reference_seed"), (seed + 2_000_000 + 10_000 * k + b).alias("split_seed"))


@query("SELECT half, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id) - 1) * 2 < (SELECT count(*) FROM documents) AS half FROM documents) GROUP BY half")
def half_split(spark, sf):
    """Two halves by a hash's order; the order is over the keys only."""
    from tessera.sources.io import numbered

    d = table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7")).cast("binary")).alias("h"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    marked = numbered(d, ["h", "doc_id"]).join(F.broadcast(n)).withColumn("half", F.col("i") * 2 < F.col("n"))
    return marked.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT {s} AS sample_id, {42 + s} AS seed, 20 AS sample_size, p_name AS file FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || '|{42 + s}'), p_partkey LIMIT 20)" for s in range(1, 4)))
def sample_manifest(spark, sf):
    """Several samples of names, each by its seed."""
    p, out = table(spark, sf, "part").select("p_partkey", "p_name"), None
    for s in range(1, 4):
        order = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(f"|{42 + s}")).cast("binary"))
        one = p.orderBy(order, "p_partkey").limit(20).select(F.lit(s).alias("sample_id"), F.lit(42 + s).alias("seed"), F.lit(20).alias("sample_size"), F.col("p_name").alias("file"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT '| ' || src || ' | ' || n || ' | ' || printf('%.2f', s) || ' |' AS line FROM (SELECT l_returnflag AS src, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1)")
def report_lines(spark, sf):
    """Rows of a Markdown table."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"))
    return g.select(F.concat(F.lit("| "), F.concat_ws(" | ", "src", F.col("n").cast("string"), F.format_string("%.2f", "s")), F.lit(" |")).alias("line"))
