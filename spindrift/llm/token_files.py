"""Flat token files: writing them, and counting the documents in them by a separator scan.

A token file is a run of unsigned 16-bit little-endian ids without header or index; an end-of-document id follows each
document. The scan cuts files into blocks of equal size at any place, searches each block for the id with one vector
comparison, and stitches documents across blocks with a prefix scan over one small row per block: how many separators
came before, and where the last of them stood.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import stored, text_of, texts_and_ids

BLOCK_BYTES = 4 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, separator: int) -> DataFrame:
    """Writes one token file per partition to ``folder``, a URI that all executors reach, and returns what went where:
    file, ordinal (the document's place in its file), doc_id. Null and empty texts are a separator alone, also of a
    null doc_id; repeated rows are written as often as they occur; an empty table makes files without documents; very
    long texts are encoded whole; columns other than doc_id and text aren't read. Ids must fit 16 bits.

    Every attempt of a task writes a draft of its own, whose name goes into its rows. Only the drafts that the manifest
    names, those of the attempts that counted, become token files, so rows and files are of one attempt always.
    """
    top = max(load_ranks(path).values(), default=0)
    if max(top, separator) > 0xFFFF or separator < 0:
        raise ValueError(f"ids up to {max(top, separator)} don't fit 16 bits")

    def run(batches):
        encoding = _encoding(path, pattern)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        n = 0
        with system.open_output_stream(f"{base}/_{name}") as out:
            for batch in batches:
                keys, texts = texts_and_ids(batch)
                for text in texts:
                    out.write(np.asarray([*encoding.encode_ordinary(text), separator], "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(range(n, n + len(keys)), pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
                n += len(keys)

    def publish(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name in names:
                system, base = _open(folder)
                if system.get_file_info(f"{base}/_{name}").type == fs.FileType.File:  # else an earlier attempt did it
                    system.move(f"{base}/_{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    manifest = stored(frame.mapInArrow(run, "file string, ordinal bigint, doc_id bigint"), "token-manifest")
    manifest.select("file").distinct().mapInArrow(publish, "file string").count()
    return manifest


def scan_blocks(spark: SparkSession, folder: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, first (the block's first token in its file), n (its tokens), at (places of separators in the block)."""
    if block_bytes % 2:
        raise ValueError("a block holds whole 16-bit ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").where("length > 1")
    n_blocks = F.ceil(F.col("length") / block_bytes)
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)).alias("block"))

    def run(batches):
        for batch in batches:
            rows = []
            for path, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = _open(path)
                begin = block * block_bytes
                with system.open_input_file(place) as source:
                    raw = source.read_at(min(block_bytes, length // 2 * 2 - begin), begin)
                ids = np.frombuffer(raw, "<u2")
                rows.append((path.rsplit("/", 1)[1], block, begin // 2, len(ids), np.flatnonzero(ids == separator)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "first", "n", "at"])

    dealt = blocks.repartition("path", "block")
    return dealt.mapInArrow(run, "file string, block bigint, first bigint, n bigint, at array<bigint>")


def token_counts(spark: SparkSession, folder: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator), ended: one row per document of the folder's token files.

    Two separators in a row hold an empty document; tokens after the last separator are a document with ended = false; an
    empty file has no documents. The prefix scan sees three numbers per block; the places of its separators stay with it.
    """
    scanned = stored(scan_blocks(spark, folder, separator, block_bytes), "token-blocks")
    blocks = scanned.select("file", "block", "first", "n", F.size("at").alias("n_at"), F.element_at("at", -1).alias("last_at"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("last", F.when(F.col("n_at") > 0, F.col("first") + F.col("last_at")))
    blocks = blocks.withColumn("n_before", F.coalesce(F.sum("n_at").over(before), F.lit(0))).withColumn("open_from", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)
    blocks = blocks.withColumn("is_last", F.lead("block").over(order).isNull())
    blocks = blocks.join(scanned.select("file", "block", "at").hint("shuffle_merge"), ["file", "block"])
    tail_from = F.coalesce(F.col("last") + 1, F.col("open_from"))
    end = F.col("first") + F.col("n")
    found = F.transform(
        "at",
        lambda x, i: F.struct(
            (F.col("n_before") + i).cast("bigint").alias("ordinal"),
            F.when(i == 0, F.col("open_from")).otherwise(F.col("first") + F.get("at", i - 1) + 1).alias("start"),
            (F.col("first") + x).alias("end"),
            F.lit(True).alias("ended"),
        ),
    )
    tail = F.when(F.col("is_last") & (tail_from < end), F.array(F.struct((F.col("n_before") + F.size("at")).cast("bigint").alias("ordinal"), tail_from.alias("start"), end.alias("end"), F.lit(False).alias("ended"))))
    rows = blocks.select("file", F.explode(F.concat(found, F.coalesce(tail, F.array().cast("array<struct<ordinal:bigint,start:bigint,end:bigint,ended:boolean>>")))).alias("d"))
    return rows.select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.ended")
