"""What the text operators share: reading tables, the shared folder, hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators split words at, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: ``spark.checkpoint.dir``, a folder per application.

    Where the setting is missing in local mode, as in tests, a folder under /tmp serves. On a cluster that is an error: each
    executor would write to a disk of its own, and readers would miss what the others wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/spindrift"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Deletes all that this application stored. Frames that the operators returned can't be read afterwards."""
    system, path = fs.FileSystem.from_uri(shared_dir(spark, "x").rsplit("/", 1)[0])
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: the lineage ends there, lost executors cost nothing.

    The collection afterwards lets Spark's cleaner drop the shuffle files behind the written table now, rather than at
    the driver's next full collection. The tables stay until :func:`drop_stored`, for returned frames read them."""
    spark = frame.sparkSession
    path = shared_dir(spark, name)
    frame.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(path)


#: A key with more than one of so many rows is dealt to several tasks.
SHARES = 1_000


def spread_join(frame: DataFrame, per_key: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``frame`` with the columns of ``per_key`` (stored; one row per key, ``n_rows``: about how many rows of ``frame`` it
    has); rows without one go. A key with many rows is dealt to several tasks by the columns ``spread``, each of which
    gets a copy of the key's one row. At most SHARES keys can be so frequent: these are broadcast."""
    share = max(1, (per_key.agg(F.sum("n_rows").alias("n")).first()["n"] or 0) // SHARES)
    hot = F.broadcast(per_key.where(F.col("n_rows") > share).select(*keys, F.ceil(F.col("n_rows") / share).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = frame.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    copies = per_key.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", "n_rows")
    return dealt.join(copies.hint("shuffle_merge"), [*keys, "_salt"]).drop("_salt")


def text_of(column: str = "text") -> Column:
    """The text as a string, the empty string for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters that are not white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``: a plain reference would be copied into every use."""
    return F.transform(F.array(value), body)[0]


def run_starts(ordered: Column, key=lambda x: x) -> Column:
    """The 0-based indices at which a sorted array begins a new value of ``key``."""
    n = F.size(ordered)
    return F.when(
        n > 0,
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1)))),
    ).otherwise(F.array().cast("array<int>"))


def texts_and_ids(batch: pa.RecordBatch) -> tuple[list, list[str]]:
    """The ids and texts of a batch with columns doc_id and text."""
    return batch.column(0).to_pylist(), [t if t is not None else "" for t in batch.column(1).to_pylist()]


_MULT = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mix64(h: ArrayLike) -> ArrayLike:
    """A bijection of 64-bit words that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MULT[0]
    h ^= h >> np.uint64(27)
    h *= _MULT[1]
    h ^= h >> np.uint64(31)
    return h


SKETCH_WORDS = 16


def sketch(hashes: ArrayLike) -> list[int]:
    """A set's hashes as 1,024 bits in 16 words: a bit of one set that another lacks stands for a member that it lacks."""
    bits = np.zeros(64 * SKETCH_WORDS, np.uint8)
    bits[hashes & np.uint64(64 * SKETCH_WORDS - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def sketch_lacks(a: str, b: str) -> Column:
    """How many bits of the sketch in columns ``a0``.. are missing in ``b0``..: at most the members missing."""
    parts = [F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}{i}")))) for i in range(SKETCH_WORDS)]
    return sum(parts[1:], parts[0])
