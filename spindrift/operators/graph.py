"""Connected components by propagating the smallest label with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component (the smallest node that it reaches), for the nodes that have links.

    A round takes the least label among a node's neighbours, then that label's own label; rounds grow with the
    logarithm of the longest path in practice and end when no label changes."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("low"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = low.join(jump, F.col("low") == F.col("via"), "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "before")
        after = cut(after)
        if after.where("label <> before").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
