"""The session settings that all queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tessera").config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
