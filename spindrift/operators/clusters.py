"""Clusters, palettes and snapshots: local dimension, anomaly scores, nearest codes, merges and joins of several diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_dimension(distances: DataFrame, by: str, d: str, radius: float) -> DataFrame:
    """log2 of how many neighbours lie within the radius over how many within half of it; 0 where either count is 0."""
    counts = distances.groupBy(by).agg(F.count_if(F.col(d) <= radius).alias("outer"), F.count_if(F.col(d) <= radius / 2).alias("inner"))
    return counts.withColumn("lfd", F.when((F.col("inner") > 0) & (F.col("outer") > 0), F.log2(F.col("outer") / F.col("inner"))).otherwise(0.0))


def anomaly_scores(frame: DataFrame, value: str) -> DataFrame:
    """Values scaled to 0..1 by the column's own extremes (one row, found first), and a state by thirds."""
    ends = frame.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    score = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    out = frame.crossJoin(F.broadcast(ends)).withColumn("score", score).drop("_low", "_high")
    return out.withColumn("state", F.when(F.col("score") < 1 / 3, "normal").when(F.col("score") < 2 / 3, "uncertain").otherwise("anomalous"))


def index_percentiles(frame: DataFrame, by: list[str], v: str, percents: tuple[int, ...] = (25, 50, 75), last: bool = False) -> DataFrame:
    """Percentiles by rank with the group's size, extremes, mean and population deviation: the value at position
    n * q div 100 of each group's order, or (n - 1) * q div 100 with ``last``."""
    w = Window.partitionBy(*by)
    ranked = frame.select(*by, v, (F.row_number().over(w.orderBy(v)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("i") == F.floor((F.col("n") - int(last)) * q / 100), F.col(v))).alias(f"p{q}") for q in percents]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), *picks)


def nearest_code(distance_by_code: list[Column]) -> Column:
    """Number of the least of several distances, the first on ties."""
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distance_by_code)]))["i"]


def merge_snapshots(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of both; the left side wins."""
    return a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full").select(key, F.coalesce("_a", "_b").alias(value))


def merge_hits(paths: list[DataFrame], key: str, d: str, k: int) -> DataFrame:
    """Union of several searches' hits with each row's least distance, the nearest ``k`` of them."""
    return reduce(DataFrame.unionByName, paths).groupBy(key).agg(F.min(d).alias(d)).orderBy(d, key).limit(k)


def join_diffs(diffs: dict[str, DataFrame], on: list[str], value: str) -> DataFrame:
    """Several diffs side by side, 0 where one lacks a group: one union and one aggregate instead of outer joins."""
    rows = reduce(DataFrame.unionByName, [f.select(*on, F.lit(name).alias("_from"), value) for name, f in diffs.items()])
    return rows.groupBy(*on).agg(*[F.coalesce(F.sum(F.when(F.col("_from") == name, F.col(value))), F.lit(0.0)).alias(name) for name in diffs])


def greedy_trace(start: list[float], base: DataFrame, key: str, vector: str, distance, steps: int, limit: float) -> list[tuple]:
    """A chain of nearest neighbours: from each row on to the nearest other row that was not visited, until none is
    within ``limit``. One small top-1 job per step; the base stays where it is."""
    trace, at, seen = [], start, []
    for _ in range(steps):
        left = base.where(~F.col(key).isin(seen)) if seen else base
        hit = left.select(key, vector, distance(F.col(vector), at).alias("d")).where((F.col("d") > 0) & (F.col("d") <= limit)).orderBy("d", key).limit(1).collect()
        if not hit:
            break
        trace.append((len(trace), hit[0][key], hit[0]["d"]))
        at = hit[0][vector]
        seen.append(hit[0][key])
    return trace


def hash_tree(frame: DataFrame, group: Column, key: str, content: Column, branches: int = 8) -> DataFrame:
    """Digest per branch and of all branches together (branch -1): which parts of two tables differ shows by comparing.
    Leaves are folded with a commutative sum of their digests, so no group is gathered."""
    leaf = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key), content), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    leaves = frame.select((F.pmod(group, F.lit(branches))).cast("int").alias("branch"), leaf.alias("leaf"))
    by = leaves.groupBy("branch").agg(F.sum("leaf").cast("string").alias("digest"), F.count("*").alias("n"))
    root = leaves.agg(F.lit(-1).alias("branch"), F.sum("leaf").cast("string").alias("digest"), F.count("*").alias("n"))
    return by.unionByName(root)


def diff_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Branches of two hash trees (branch -1 is the root) and whether they differ; a branch that one lacks differs."""
    side = lambda t, d: t.select("branch", F.col("digest").alias(d))
    return side(a, "_a").join(side(b, "_b"), "branch", "full").select("branch", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("differs"))
