"""Many snapshots of one table merged in one pass: how often and how far each part moved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.truth import revise


def merged(snapshots: list[DataFrame], keys: list[str], vector: str) -> DataFrame:
    """keys, snapshot (its number), v, before (the vector in the last earlier snapshot that has the key), since (that one's
    number). All snapshots go through one sort by key, rather than through a join for each pair of them."""
    each = [s.select(*keys, F.lit(i).alias("snapshot"), F.col(vector).alias("v")) for i, s in enumerate(snapshots)]
    w = Window.partitionBy(*keys).orderBy("snapshot")
    every = reduce(DataFrame.unionByName, each)
    return every.withColumn("before", F.lag("v").over(w)).withColumn("since", F.lag("snapshot").over(w))


def moved(rows: DataFrame, distance, least: float) -> DataFrame:
    """Rows of :func:`merged` that have a predecessor, with ``d``, and ``shifted`` where it is above ``least``."""
    return rows.where("before is not null").withColumn("d", distance(F.col("v"), F.col("before"))).withColumn("shifted", F.col("d") > least)


def volatility(shifts: DataFrame, head: list[str]) -> DataFrame:
    """head, snapshots (in which it was compared), shifted (in how many it moved at all), mean and deviation of d over all
    rows, f and c: the snapshots' shares of moved rows as one truth, each with its number of rows as evidence."""
    per = shifts.groupBy(*head, "snapshot").agg(F.count("*").alias("n"), F.count_if("shifted").alias("k"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("s2"))
    truths = per.withColumn("f", F.col("k") / F.col("n")).withColumn("c", F.least(1 - 1 / (1 + F.col("n")), F.lit(0.99)))
    truth = revise(truths, head, "f", "c").drop("k")
    sums = per.groupBy(*head).agg(F.count("*").alias("snapshots"), F.count_if(F.col("k") > 0).alias("shifted"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))
    return sums.select(*head, "snapshots", "shifted", mean.alias("mean"), spread.alias("deviation")).join(truth, head)


def scaffold_by(shifts: DataFrame, block: str, part: str, above: dict, below: dict) -> DataFrame:
    """Blocks in which the share of moved rows is above the limit for each part of ``above`` and under it for each of
    ``below``; a part without rows has the share 0."""
    share = lambda p: F.coalesce(F.avg(F.when(F.col(part) == p, F.col("shifted").cast("int"))), F.lit(0.0))
    limits = [(p, t, True) for p, t in above.items()] + [(p, t, False) for p, t in below.items()]
    shares = shifts.groupBy(block).agg(*[share(p).alias(f"_p{i}") for i, (p, _, _) in enumerate(limits)])
    fits = [F.col(f"_p{i}") > t if over else F.col(f"_p{i}") < t for i, (_, t, over) in enumerate(limits)]
    return shares.where(reduce(Column.__and__, fits)).select(block)


def gate_scaffold(clusters: DataFrame, blocks: DataFrame, block: str) -> DataFrame:
    """Scaffold blocks with their gate's redundancy (redundant_pairs of total_pairs in ``clusters``; 0 without a gate), and
    whether routing dominates there: more than half of the pairs are redundant."""
    both = blocks.join(clusters.select(block, "redundant_pairs", "total_pairs"), block, "left")
    redundancy = F.when(F.col("total_pairs") > 0, F.col("redundant_pairs") / F.col("total_pairs")).otherwise(0.0)
    return both.select(block, (redundancy > 0.5).alias("routing"), redundancy.alias("redundancy"))
