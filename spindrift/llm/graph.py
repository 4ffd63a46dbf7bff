"""Connected components of a table of links, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(links: DataFrame) -> DataFrame:
    """links (a, b: bigint) -> one row per linked node: node, component (its smallest reachable node).

    Each round every node goes to that one of its neighbours and itself which comes first in an order drawn for the round,
    and links are carried on between the nodes gone to. A quarter of the nodes at least can be expected to go each time, and
    groups of many links become single nodes in the first rounds, so later rounds see few links. When none is left, the
    rounds are followed back. Each round's links are written to the shared folder, never to the driver.
    """
    links = stored(_once(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    rounds: list[DataFrame] = []
    low = None  # per node of this round the smallest node that has come to it
    while not links.isEmpty():
        rank = lambda x: F.struct(F.xxhash64(F.lit(len(rounds)), x).alias("rank"), F.col(x).alias("node"))
        ends = links.select(F.explode(F.array("u", "v")).alias("node"), F.least(rank("u"), rank("v")).alias("first"))
        to = ends.groupBy("node").agg(F.min("first").getField("node").alias("to"))
        if low is None:
            to = to.withColumn("low", F.col("node"))
        else:  # a node without links stays
            to = low.join(to.hint("shuffle_merge"), "node", "left").select("node", F.coalesce("to", "node").alias("to"), "low")
        to = stored(to, "round")
        rounds.append(to)
        low = to.groupBy(F.col("to").alias("node")).agg(F.min("low").alias("low"))
        for end in "uv":
            gone = to.select(F.col("node").alias(end), F.col("to").alias("x"))
            links = links.join(gone.hint("shuffle_merge"), end).drop(end).withColumnRenamed("x", end)
        links = stored(_once(links), "links")
    if low is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = low.withColumnRenamed("low", "component")
    for to in reversed(rounds):
        found = to.select("node", "to").join(found.withColumnRenamed("node", "to").hint("shuffle_merge"), "to").select("node", "component")
    return found


def _once(links: DataFrame) -> DataFrame:
    """The distinct links of different nodes, the smaller one first."""
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
