"""n-dimensional arrays as coordinate frames (i0, i1, ..., v): shape changes, indexing, elementwise work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_vectors(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows of vectors -> coordinates (i0 = key, i1 = position, v)."""
    return frame.select(F.col(key).alias("i0"), F.posexplode(F.col(vector).cast("array<double>")).alias("i1", "v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")


def slice_axis(a: DataFrame, axis: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """start <= i < stop in steps; coordinates are renumbered from 0."""
    i = F.col(axis)
    return a.where((i >= start) & (i < stop) & ((i - start) % step == 0)).withColumn(axis, ((i - start) / step).cast("bigint"))


def index_axis(a: DataFrame, axis: str, at: int) -> DataFrame:
    return a.where(F.col(axis) == at).drop(axis)


def take(a: DataFrame, axis: str, indices: list[int]) -> DataFrame:
    """Gathers indices along an axis; they may repeat, their order becomes the new numbering. The list is the caller's
    literal, so it is small enough to broadcast."""
    chosen = a.sparkSession.createDataFrame(list(enumerate(indices)), "new_i bigint, old_i bigint")
    return a.join(F.broadcast(chosen), F.col(axis) == F.col("old_i")).drop(axis, "old_i").withColumnRenamed("new_i", axis)


def invert_axis(a: DataFrame, axis: str, length: int) -> DataFrame:
    return a.withColumn(axis, F.lit(length - 1) - F.col(axis))


def remove_index(a: DataFrame, axis: str, at: int) -> DataFrame:
    i = F.col(axis)
    return a.where(i != at).withColumn(axis, i - F.when(i > at, 1).otherwise(0))


def reshape(a: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    if old[0] * old[1] != new[0] * new[1]:
        raise ValueError("the shapes hold different numbers of elements")
    linear = F.col("i0") * old[1] + F.col("i1")
    return a.select(F.floor(linear / new[1]).cast("bigint").alias("i0"), (linear % new[1]).cast("bigint").alias("i1"), "v")


def flatten(a: DataFrame, columns: int, column_major: bool = False, rows: int | None = None) -> DataFrame:
    i = F.col("i1") * rows + F.col("i0") if column_major else F.col("i0") * columns + F.col("i1")
    return a.select(i.cast("bigint").alias("i"), "v")


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i0 = i1").select(F.col("i0").alias("i"), "v")


def triangle(a: DataFrame, k: int = 0, upper: bool = True) -> DataFrame:
    inside = F.col("i1") >= F.col("i0") + k if upper else F.col("i1") <= F.col("i0") + k
    return a.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def concatenate(parts: list[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """Appends frames along an axis; each comes with its length there."""
    moved, offset = [], 0
    for frame, length in parts:
        moved.append(frame.withColumn(axis, F.col(axis) + offset))
        offset += length
    return reduce(DataFrame.unionByName, moved)


def stack(parts: list[DataFrame], axis: str = "k") -> DataFrame:
    return reduce(DataFrame.unionByName, [p.withColumn(axis, F.lit(i).cast("bigint")) for i, p in enumerate(parts)])


def zip_arrays(a: DataFrame, b: DataFrame, on: list[str], result: Column) -> DataFrame:
    """Elementwise over two arrays of one shape; the values are ``va`` and ``vb``."""
    return a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), on).select(*on, result.alias("v"))


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * step).alias("v"))


def logspace(spark: SparkSession, base: float, low: float, high: float, n: int) -> DataFrame:
    return linspace(spark, low, high, n).withColumn("v", F.pow(F.lit(base), "v"))


def geomspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    import math

    if low == 0 or high == 0 or (low < 0) != (high < 0):
        raise ValueError("both ends must be non-zero and of one sign")
    sign = -1.0 if low < 0 else 1.0
    return linspace(spark, math.log(abs(low)), math.log(abs(high)), n).withColumn("v", sign * F.exp("v"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return indices(spark, n, n).withColumn("v", F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0))


def indices(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """All index pairs of a shape, from one range: no join."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("bigint").alias("i0"), (F.col("id") % columns).alias("i1"))
