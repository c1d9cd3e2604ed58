"""The registry of queries and their SQL, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, beside its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), "label")


def variants(key: str, column: str, forms: list[tuple[str, str]]) -> tuple[Callable[[], Column], str]:
    """A text between one of several prefixes and suffixes, by the row's number; what gives the column, and SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def column_of() -> Column:
        some = F.array(*(F.concat(F.lit(a), F.col(column), F.lit(b)) for a, b in forms))
        return F.element_at(some, (F.col(key) % len(forms) + 1).cast("int"))

    sql = f"list_extract([{', '.join(f'{quote(a)} || {column} || {quote(b)}' for a, b in forms)}], CAST({key} % {len(forms)} AS INTEGER) + 1)"
    return column_of, sql
