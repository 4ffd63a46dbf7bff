"""Queries that write files of codes and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spindrift.functions import palette
from spindrift.operators.lineage import _shared
from spindrift.sources import codes

from .palettes import _CODE
from .registry import query, table


def _folder(spark):
    return f"{_shared(spark).rstrip('/')}/{spark.sparkContext.applicationId}/codes-{uuid.uuid4().hex}"


def _coded(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", palette.project(F.col("embedding").cast("array<double>")).alias("code"))


@query(f"select 'label.' || label as tensor, case when label % 2 = 0 then 'attention' else 'norm' end as layer, 64 as n_cols, vec_id as row, {_CODE} as code from embeddings")
def code_container(spark, d):
    """Codes of all vectors, a tensor for each label, written as containers and read back in blocks."""
    rows = _coded(spark, d).select(F.concat(F.lit("label."), F.col("label")).alias("tensor"), F.when(F.col("label") % 2 == 0, "attention").otherwise("norm").alias("layer"), F.lit(64).alias("n_cols"), F.col("vec_id").alias("row"), "code")
    folder = _folder(spark)
    codes.write_codes(rows, folder)
    return codes.read_codes(spark, folder, block=100)


@query(f"select vec_id as row, {_CODE} as code from embeddings")
def code_cache(spark, d):
    """All codes as a plain cache."""
    folder = _folder(spark)
    codes.write_codes(_coded(spark, d).select(F.col("vec_id").alias("row"), "code"), folder, "cache")
    return codes.read_codes(spark, folder, "cache", block=100)
