"""Resumable state as streams: latest state by key, and counts over what is available now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip


def state_of(match: Column, download: Column) -> Column:
    """A finished download before a match that is none before any other status of either; no status is untouched."""
    m, d = (strip(F.coalesce(x, F.lit(""))) for x in (match, download))
    return F.when(d == "downloaded", "downloaded").when(m == "no_match", "no_match").when((m != "") | (d != ""), "retryable").otherwise("untouched")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log, by partial maxima before the shuffle."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def progress(log: DataFrame, match: str, download: str, index: str) -> DataFrame:
    """One row: rows by state, rows attempted and in all, and where the first untouched and the first unfinished row are (else the total)."""
    s = state_of(F.col(match), F.col(download))
    n = F.count(F.lit(1))
    named = [F.count_if(s == x).alias(x) for x in ("downloaded", "no_match", "retryable", "untouched")]
    untouched, unfinished = F.min(F.when(s == "untouched", F.col(index))), F.min(F.when(~s.isin("downloaded", "no_match"), F.col(index)))
    return log.agg(*named, F.count_if(s != "untouched").alias("attempted"), n.alias("total"), F.coalesce(untouched, n).alias("first_untouched"), F.coalesce(unfinished, n).alias("first_unfinished"))


def session_start(counts: DataFrame) -> Column:
    """Where a session begins: at the first untouched row, else at the first unfinished one."""
    return F.when(counts["first_untouched"] < counts["total"], counts["first_untouched"]).otherwise(counts["first_unfinished"])


def skip_reason(match: Column, download: Column, has_file: Column, retry: bool = False, again: bool = False) -> Column:
    """Why a row needs no work, or null."""
    out = F.when((strip(F.coalesce(download, F.lit(""))) == "downloaded") & has_file, "downloaded") if not again else F.when(F.lit(False), "downloaded")
    return out if retry else out.when(strip(F.coalesce(match, F.lit(""))) == "no_match", "no_match")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def available_now_counts(spark: SparkSession, path: str, schema: str, key: str, checkpoint: str, name: str) -> DataFrame:
    """Counts by key of all files there are, through a stream that ends when it has read them; its checkpoint makes it resumable."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def latest_stream(spark: SparkSession, path: str, schema: str, key: str, order: list[str], checkpoint: str, name: str) -> DataFrame:
    """The last row of each key of all files there are, kept as a stream's state; a second run reads new files only."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    rest = [c for c in stream.columns if c != key]
    best = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    query = best.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(key, "_r.*")
