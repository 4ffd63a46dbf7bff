"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, hard_negatives, jaccard_join, license_scan, line_dedup, oracle, order_minhash, packing, quality, repeats, secret_scan, signature_join, token_files
from .common import read, shared_dir, text_of


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as flat token files and counts by scanning them: doc_id, n_tokens, file, ordinal, start."""
    folder, separator = shared_dir(spark, "tokens"), 50256
    manifest = token_files.write_token_files(read(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, separator)
    counts = token_files.token_counts(spark, folder, separator)
    return counts.join(manifest.hint("shuffle_merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, with a digest of what is left."""
    kept = line_dedup.without_repeats(read(spark, sf_dir))
    return kept.select("source_row.doc_id", "n_lines", "n_removed", F.sha2(text_of("source_row.text").cast("binary"), 256).alias("kept_sha256"))


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir))
    return judged.withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_labels(read(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=4096, separator=2)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(read(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir)).drop("kept")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(read(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_order_minhash": op2_order_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_divergence": op4_divergence,
    "op6_license_scan": op6_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_repeats": op10_repeats,
    "op11_fill_middle": op11_fill_middle,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_divergence": oracle.DIVERGENCE,
    "op7_jaccard_join": oracle.JACCARD,
    "op10_repeats": oracle.REPEATS,
    "op11_fill_middle": oracle.FILL_MIDDLE,
    "op12_minhash_dedup": oracle.MINHASH,
    "op13_hard_negatives": oracle.HARD_NEGATIVES,
}
