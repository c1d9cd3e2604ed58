"""A corpus pipeline of five stages, each over all that the one before it kept.

Cases, in every stage: an empty table stays empty; other columns, whatever their names, come through as
they are; rows with a null or repeated id are rows like others; a null or empty text fails the quality
rules, and where a stage gets one all the same it has one empty line, no near-duplicates, no benchmark
words and no ids; of equal rows the near-duplicate stage keeps one; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, minhash, quality
from tessera.llm.queries import bpe_digests
from tessera.llm.shared import durable, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fitted trees go."""
    trees = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, trees)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the smallest id; documents stay, with their new text."""
    return lines.with_unique_lines(docs)


#: Similarity in percent from which the near-duplicate stage links texts.
NEAR = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: of the smallest id, a null id last.

    Rows are told apart by their place, not by id; the place is stable because ``docs`` is a durable
    result of the stage before.
    """
    placed = docs.withColumn("__row", F.monotonically_increasing_id())
    groups = minhash.near_duplicates(placed, id_col="__row", percent=NEAR).select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"].alias("__row")
    stay = groups.join(placed.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first)
    return placed.join(stay.select("__row"), "__row", "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and their decoding, as counts and digests."""
    return bpe_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Fitted trees, registers and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with workspace():
            docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
