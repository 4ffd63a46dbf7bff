"""Shifts between neighbouring time windows, and a drift detector with keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stripe(v: Column, edges: list[float]) -> Column:
    """Number of the first edge above the value."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(v < edges[i], i).otherwise(out)
    return out


def daily_shift(events: DataFrame, key: str, ts: str, value: str, edges: list[float]) -> DataFrame:
    """Batch twin of the windowed histograms: centre of mass per day and how it moved since the key's last day."""
    day = F.date_trunc("day", ts)
    hist = events.groupBy(key, day.alias("day")).agg(F.avg(stripe(F.col(value), edges)).alias("centre"), F.count("*").alias("total"))
    w = Window.partitionBy(key).orderBy("day")
    moved, grown = F.col("centre") - F.lag("centre").over(w), F.col("total") / F.lag("total").over(w) - 1
    label = F.when(F.col("moved").isNull(), "first").when(F.col("moved") > 0.1, "up").when(F.col("moved") < -0.1, "down").when(F.abs("grown") > 0.15, "volume").otherwise("stable")
    return hist.withColumn("moved", moved).withColumn("grown", grown).withColumn("shift", label)


def window_histogram(stream: DataFrame, key: str, ts: str, value: str, edges: list[float], size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window, key and stripe; works on streams (with a watermark) and on tables."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, size).alias("w"), F.col(key), stripe(F.col(value), edges).alias("stripe")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), key, "stripe", "n")


DRIFT_STATE = "n bigint, mean double, m2 double"
DRIFT_OUT = "key string, n bigint, value double, mean double, sigma double, alert boolean"


def observe(state: tuple[int, float, float], value: float, least: int = 10) -> tuple[tuple[int, float, float], bool]:
    """One Welford step; an alert where more than ``least`` values came before and the value is beyond 3 sigma."""
    n, mean, m2 = state
    sigma = math.sqrt(m2 / n) if n else 0.0
    alert = n > least and sigma > 0 and abs(value - mean) > 3 * sigma
    n += 1
    delta = value - mean
    mean += delta / n
    return (n, mean, m2 + delta * (value - mean)), alert


def _update(key, frames: Iterator[pd.DataFrame], state):
    now = tuple(state.get) if state.exists else (0, 0.0, 0.0)
    rows = []
    for frame in frames:
        for value in frame.sort_values(["ts", "value"])["value"]:
            now, alert = observe(now, float(value))
            rows.append((str(key[0]), now[0], float(value), now[1], math.sqrt(now[2] / now[0]), alert))
    state.update(now)
    yield pd.DataFrame(rows, columns=["key", "n", "value", "mean", "sigma", "alert"])


def detect(stream: DataFrame, key: str) -> DataFrame:
    """Drift alerts per key of a stream with columns ``key``, ts, value; state is three numbers a key."""
    picked = stream.select(F.col(key).cast("string").alias("key"), "ts", F.col("value").cast("double").alias("value"))
    return picked.groupBy("key").applyInPandasWithState(_update, DRIFT_OUT, DRIFT_STATE, "append", "NoTimeout")


def beliefs(stream: DataFrame, key: str, ts: str, value: str, threshold: float, late: str = "1 day") -> DataFrame:
    """Evidence per key as running sums: a streaming aggregate in update or complete mode, a plain one on tables."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    sums = rows.groupBy(key).agg(F.count_if(F.col(value) >= threshold).alias("positive"), F.count_if(F.col(value) < threshold).alias("negative"))
    w = F.col("positive") + F.col("negative")
    return sums.withColumn("f", F.col("positive") / w).withColumn("c", w / (w + 1))
