"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html, lines, minhash, oracles, quality, repeats, suffixes, tokens, urls
from tessera.llm.shared import durable, workspace


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; every executor has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    joined = F.concat_ws(",", F.array_sort("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    with workspace():
        folder = tokens.new_folder(docs)
        tokens.write_shards(docs, tokenizer_path("word_bpe_49k.json"), folder)
        return durable(tokens.read_shards(spark, folder))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace():
        out = repeats.dedup_repeats(_table(spark, sf_dir, "documents"))
        return durable(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_on(docs, _table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace():
        out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
        return durable(out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"), pattern())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace():
        out = suffixes.dedup_suffixes(_table(spark, sf_dir, "documents"))
        return durable(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    some = [
        op1_minhash_near_dedup, op2_decontamination, op3_token_shards, op4_substring_dedup, op5_quality_rules, op6_line_dedup,
        op7_url_filter, op8_byte_bpe, op9_html_extraction, op10_suffix_dedup,
    ]
    return {f.__name__: f for f in some}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
