"""Where iterative operators cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base or "file:///tmp/checkpoints/spindrift"


def cut(frame: DataFrame) -> DataFrame:
    """Writes a frame to the folder of spark.checkpoint.dir, which driver and executors share, and reads it from there.

    Where the setting is missing in local mode, as in tests, a folder under /tmp serves; on a cluster that is an error, for
    each executor would write to a disk of its own."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared(frame.sparkSession))
    return frame.checkpoint()


def kept(frame: DataFrame, *by: str) -> DataFrame:
    """As :func:`cut`, but as Parquet: later reads take only the columns and, where ``by`` names columns, only the parts
    that they ask for. A large part is written by several tasks."""
    spark = frame.sparkSession
    path = f"{_shared(spark).rstrip('/')}/{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"
    writer = (frame.hint("rebalance", *by) if by else frame).write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
