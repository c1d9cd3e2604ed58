"""Standardising and principal components of ``id, v (array<double>)``.

What reaches the driver are sums over the columns: means, variances and one matrix of their products,
``d`` by ``d`` numbers whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(points: DataFrame) -> DataFrame:
    """``pos, mean, std, var, low, high`` per position, with population deviations."""
    flat = points.select(F.posexplode("v").alias("pos", "x"))
    return flat.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("var"), F.min("x").alias("low"), F.max("x").alias("high"))


def standardized(points: DataFrame) -> DataFrame:
    """Each position less its mean, over its population deviation (1 where that is 0)."""
    of = moments(points).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std")))).alias("of"))
    return points.join(F.broadcast(of)).withColumn("v", F.zip_with("v", "of", lambda x, m: (x - m["mean"]) / m["std"])).select(points.columns)


def _products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in it:
        if b.num_rows:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])


def components(points: DataFrame, most: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes by falling variance, shares of the total variance); each axis's largest weight is positive."""
    sums = None
    for row in points.select("v").mapInArrow(_products, "sums array<double>").toLocalIterator():  # one matrix of a task at a time
        own = np.array(row["sums"])
        sums = own if sums is None else sums + own
    if sums is None:
        raise ValueError("no points")
    d = int(round(len(sums) ** 0.5)) - 1
    sums = sums.reshape(d + 1, d + 1)
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    values, axes = np.linalg.eigh(sums[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1][: int(min(most, n - 1, d))]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, np.maximum(values[order], 0) / max(values.sum(), 1e-300)


def choose(shares: np.ndarray, target: float = 0.99) -> int:
    """How many components reach the target share: two at least, all at most."""
    return int(min(max(np.searchsorted(np.cumsum(shares), target) + 1, 2), len(shares)))


def projected(points: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """The points on the axes, by Arrow batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(mean)))
            y = (x - mean) @ axes.T
            out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(axes), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), out], names=["id", "v"])

    return points.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, v array<double>")
