"""Readers and writers: fixed-header CSV, tolerant JSON, keyed maps, binary arrays, staged writes."""

from __future__ import annotations

import atexit
import io
import json
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text on a fixed header: extra ones go, missing ones are empty, no file is no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    got = spark.read.option("header", True).csv(path)
    return got.select(*((F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in got.columns else F.lit("")).alias(c) for c in columns))


def keyed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; blank keys go."""
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return last.select(key, "_r.*").select(rows.columns)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a JSON object; a missing or broken file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``stem, name, values`` of each array in each .npz file; files that cannot be read are left out."""

    def load(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    z = np.load(io.BytesIO(content))
                    rows += [(file.rsplit("/", 1)[-1][:-4], k, z[k].ravel().astype(float).tolist()) for k in z.files]
                except (ValueError, OSError, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=["stem", "name", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(load, "stem string, name string, values array<double>")


def audio_files(spark: SparkSession, path: str, extensions: list[str] = ("mp3", "m4a", "flac", "wav")) -> DataFrame:
    """One file for each stem, by the order of extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    rank = F.array_position(F.array(*map(F.lit, extensions)), extension)
    rows = files.select("path", "length", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), rank.alias("rank")).where("rank > 0")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("stem").orderBy("rank", "path"))).where("_n = 1").drop("_n", "rank")


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and what makes paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the folder that all executors share; only a local master may do without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_versioned(df: DataFrame, path: str, kind: str = "parquet", **options) -> str:
    """Write a new version below ``path`` and then point to it, so that readers see the old rows or the new ones and nothing between.

    The pointer is a file written whole under another name and renamed onto a name of its own; the
    newest pointer counts.  Gives the version's path.
    """
    return write_together({"": df}, path, kind, **options)[""]


def write_together(frames: dict[str, DataFrame], path: str, kind: str = "parquet", **options) -> dict[str, str]:
    """Write several frames as one version: readers see all of them or none."""
    spark = next(iter(frames.values())).sparkSession
    fs, make = _fs(spark, path)
    version = f"{len(versions(spark, path)):08d}-{uuid.uuid4().hex}"
    places = {name: f"{path}/data/{version}/{name}".rstrip("/") for name in frames}
    for name, df in frames.items():
        df.write.mode("errorifexists").options(**options).format(kind).save(places[name])
    draft = make(f"{path}/.{version}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(places).encode()))
    out.close()
    fs.mkdirs(make(f"{path}/versions"))
    if not fs.rename(draft, make(f"{path}/versions/{version}")):
        raise OSError(f"{path} could not be published")
    return places


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions' names, oldest first."""
    fs, make = _fs(spark, path)
    folder = make(f"{path}/versions")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_version(spark: SparkSession, path: str, name: str = "", kind: str = "parquet") -> DataFrame:
    """A frame of the newest version."""
    newest = versions(spark, path)[-1]
    places = json.loads(spark.read.text(f"{path}/versions/{newest}", wholetext=True).first()[0])
    return spark.read.format(kind).load(places[name])


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Results below ``source=../reduction=../algorithm=..`` or the like, for ``read_partitioned``."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """JSON results of many runs with values parsed from their paths, the last folders first named last."""
    got = spark.read.option("multiLine", True).json(f"{path}/{pattern}").withColumn("_path", F.col("_metadata.file_path"))
    parts = F.split("_path", "/")
    return got.select("*", *(F.element_at(parts, -1 - len(names) + i).alias(n) for i, n in enumerate(names))).drop("_path")


def resolve_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table from a CSV file, a folder with ``feature_vectors.csv``, or a folder of .npz files (or with ``raw/``)."""
    fs, make = _fs(spark, path)
    if not fs.exists(make(path)):
        raise FileNotFoundError(path)
    if fs.getFileStatus(make(path)).isFile():
        return spark.read.option("header", True).csv(path)
    if fs.exists(make(f"{path}/feature_vectors.csv")):
        return spark.read.option("header", True).csv(f"{path}/feature_vectors.csv")
    folder = f"{path}/raw" if fs.exists(make(f"{path}/raw")) else path
    found = fs.globStatus(make(f"{folder}/*.npz"))
    if not found:
        raise FileNotFoundError(f"no features in {path}")
    return read_npz(spark, folder)


def inside(path: str, *roots: str) -> str:
    """The path, if it lies below one of the roots; else an error."""
    own = posixpath.normpath(path)
    if not any(own == (r := posixpath.normpath(root)) or own.startswith(r.rstrip("/") + "/") for root in roots):
        raise ValueError(f"{path} is outside {', '.join(roots)}")
    return own


def write_wide_csv(df: DataFrame, path: str, vector: str, prefix: str, key: str = "file") -> None:
    """One column per position of a vector, named ``prefix_0001`` and so on, sorted by key."""
    n = df.agg(F.max(F.size(vector))).first()[0] or 0
    wide = df.select(key, *(F.get(vector, F.lit(i)).alias(f"{prefix}_{i + 1:04d}") for i in range(n)))
    wide.orderBy(key).write.mode("overwrite").option("header", True).csv(path)


def write_json_map(rows: DataFrame, path: str, key: str, value: str) -> None:
    """A cache of ``key, value`` as JSON lines, replaced as a whole."""
    rows.select(F.to_json(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias("value")).write.mode("overwrite").text(path)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their number ``i`` in the order of ``by``, from 0: partitions are ranges, and what stands before each is summed from their sizes."""
    dealt = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    sizes = dealt.groupBy("_part").agg(F.max("_n").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))
    return dealt.join(F.broadcast(before), "_part").withColumn("i", F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_size", "_before")


def markdown(rows: DataFrame, most: int = 10_000) -> str:
    """A report's frame as a Markdown table; one of more rows than a report may have is an error, not cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got])
