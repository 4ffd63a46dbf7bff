"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

All stages take null texts as empty ones, keep rows that repeat a doc_id or have none as rows of their own (the Jaccard join
takes rows with equal doc_id and text as one), read very long texts whole, give no rows for an empty table, and return the
columns of documents, in the order and with the names that they have there; extra columns are dropped. Ties are broken by
doc_id and text hashes, so that results don't depend on the order of rows. Stored stages stay in the shared folder until
``drop_stored`` deletes them, for the returned frame reads the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import jaccard_join, line_dedup, packing, quality, secret_scan
from spindrift.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: also those without text, which have too few words."""
    return quality.judge(docs, rows=True).where("kept").select("source_row.*").select(*COLUMNS)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, but for two edits, go; documents of which no line is left go with them. A text
    without lines is left as it is."""
    kept = line_dedup.without_repeats(docs).where("not (n_removed > 0 and n_removed = n_lines)")
    return _measured(kept.select("source_row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest doc_id stays; see ``first_of_each``."""
    return jaccard_join.first_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, and n_chars is counted anew."""
    return _measured(secret_scan.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 tokens: one row per piece. An empty text is its separator alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, separator=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", pack),
]

#: SQL can't express the tokenizer and the packing; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}")
    return docs
