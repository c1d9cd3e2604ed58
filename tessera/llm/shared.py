"""Session helpers shared by the operators: the shared folder and durable intermediates."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a local master, where the
    driver and the executors are one process.
    """
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir"):
        return base
    if base := spark.sparkContext.getCheckpointDir():
        return base.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage; a lost executor cannot lose it.

    Spark removes the files once nothing refers to them.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


_folders: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder, for ``release`` to remove."""
    _folders.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder or file, for Python workers; Spark's ``s3a`` and ``s3n`` are S3 here."""
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else uri)


def has_store(spark: SparkSession) -> bool:
    """Whether Python workers can reach the shared folder; where they cannot, what would be files travels in rows."""
    try:
        open_store(shared_dir(spark))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def drop_folder(folder: str) -> None:
    """Remove a folder of ``fresh_dir``, if it is there."""
    if folder in _folders:
        _folders.remove(folder)
    store, path = open_store(folder)
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


def release() -> None:
    """Remove the files that operators of this process wrote beside their results; what has not been computed yet cannot be any more."""
    while _folders:
        drop_folder(_folders[-1])


atexit.register(release)


@contextmanager
def workspace() -> Iterator[None]:
    """Removes, at its end, the files that operators wrote beside their results inside it; results kept longer must be durable by then."""
    before = len(_folders)
    try:
        yield
    finally:
        for folder in _folders[before:][::-1]:
            drop_folder(folder)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of rounds whose results are durable; it acts when the driver's JVM collects garbage.

    The scheduler's threads hold on to the last job that they saw, so a job of nothing goes first; and what
    one collection frees may hold on to more.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jsc.sc().range(0, 1, 1, 1).count()
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.3)  # the cleaner works beside


def parts_for(spark: SparkSession, n_bytes: int, part_bytes: int) -> int:
    """How many parts hold ``n_bytes`` with at most about ``part_bytes`` each; a few for each core at least."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-int(n_bytes) // part_bytes), 16)


#: Rows and bytes of an Arrow batch between Spark and Python; the default of 10,000 rows is far too much for long texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def size_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches for texts, so that Python workers stay small."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)


def trim() -> None:
    """Give memory that a finished partition has freed back to the system; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def column(docs: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and other odd characters included."""
    return docs["`" + name.replace("`", "``") + "`"]


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text (null: empty), whatever other columns there are."""
    size_batches(docs.sparkSession)
    return docs.select(
        column(docs, id_col).cast("long").alias("doc_id"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"),
    )
