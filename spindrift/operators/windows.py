"""Positional windows, chunks and scans along an ordered axis of a keyed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str], index: str):
    return Window.partitionBy(*by).orderBy(index)


def sliding(frame: DataFrame, by: list[str], index: str, v: str, size: int, stride: int = 1) -> DataFrame:
    """Whole windows of ``size`` following values, starting at every ``stride``-th position: start, total, low, high."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride are at least 1")
    w = _order(by, index).rowsBetween(0, size - 1)
    out = frame.select(*by, F.col(index).alias("start"), (F.row_number().over(_order(by, index)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"), F.sum(v).over(w).alias("total"), F.min(v).over(w).alias("low"), F.max(v).over(w).alias("high"))
    return out.where((F.col("n") == size) & (F.col("i") % stride == 0)).drop("n")


def chunks(frame: DataFrame, by: list[str], index: str, v: str, size: int, exact: bool = True) -> DataFrame:
    """Non-overlapping chunks of ``size``; ``exact`` drops a short tail."""
    i = F.row_number().over(_order(by, index)) - 1
    out = frame.withColumn("chunk", F.floor(i / size).cast("bigint")).groupBy(*by, "chunk").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(index).alias("start"))
    return out.where(F.col("n") == size) if exact else out


def running(frame: DataFrame, by: list[str], index: str, **columns: Column) -> DataFrame:
    """Running aggregates: each column is an aggregate over the rows up to and with the current one."""
    w = _order(by, index).rowsBetween(Window.unboundedPreceding, 0)
    return frame.select(*by, index, *[c.over(w).alias(name) for name, c in columns.items()])


def difference(frame: DataFrame, by: list[str], index: str, v: str, n: int = 1) -> DataFrame:
    """n-th forward difference; the first ``n`` positions of each series go."""
    out = frame.select(*by, index, F.col(v).alias("d"))
    for _ in range(n):
        out = out.withColumn("d", F.col("d") - F.lag("d").over(_order(by, index)))
    return out.where(F.col("d").isNotNull())
