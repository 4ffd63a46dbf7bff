"""Model-weight files as tables: the tensor directory of safetensors and GGUF files, tensors as rows, and writing.

Files are listed by Spark (no content is read for that); headers and byte ranges are read where the tasks run, so a file
of any size is read in blocks of rows by many tasks.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from numpy.typing import ArrayLike
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.halves import from_bf16

#: Element widths in bytes.
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "Q8_0": 34 / 32}
#: GGUF's numbers of tensor types and of the scalar types of its metadata: values fixed by the format.
_GGUF_TYPES = {0: "F32", 1: "F16", 8: "Q8_0", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64", 30: "BF16"}
_GGUF_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
DIRECTORY = "path string, name string, dtype string, shape array<bigint>, begin bigint, n_bytes bigint"


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def safetensors_header(source) -> list[tuple[str, str, list[int], int, int]]:
    n = struct.unpack("<Q", source.read_at(8, 0))[0]
    header = json.loads(source.read_at(n, 8))
    return [(name, t["dtype"], t["shape"], 8 + n + t["data_offsets"][0], t["data_offsets"][1] - t["data_offsets"][0]) for name, t in header.items() if name != "__metadata__"]


def gguf_header(source) -> list[tuple[str, str, list[int], int, int]]:
    source.seek(0)
    take = lambda kind: struct.unpack("<" + kind, source.read(struct.calcsize("<" + kind)))[0]
    if source.read(4) != b"GGUF":
        raise ValueError("not a GGUF file")
    take("I")
    n_tensors, n_values, align = take("Q"), take("Q"), 32
    string = lambda: source.read(take("Q")).decode()

    def value(kind: int):
        if kind == 8:
            return string()
        if kind == 9:
            inner, n = take("I"), take("Q")
            return [value(inner) for _ in range(n)]
        return take(_GGUF_SCALARS[kind])

    for _ in range(n_values):
        name = string()
        found = value(take("I"))
        if name == "general.alignment":
            align = found
    tensors = []
    for _ in range(n_tensors):
        name, dims = string(), take("I")
        shape = [take("Q") for _ in range(dims)][::-1]
        kind = _GGUF_TYPES.get(take("I"), "unknown")
        tensors.append((name, kind, shape, take("Q")))
    base = -(-source.tell() // align) * align
    return [(name, kind, shape, base + at, int(np.prod(shape) * WIDTHS.get(kind, 0))) for name, kind, shape, at in tensors]


def list_tensors(spark: SparkSession, path: str) -> DataFrame:
    """One row per tensor of the .safetensors and .gguf files under ``path``: path, name, dtype, shape, begin, n_bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                system, place = open_uri(uri)
                with system.open_input_file(place) as source:
                    rows += [(uri, *t) for t in (gguf_header(source) if uri.endswith(".gguf") else safetensors_header(source))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "name", "dtype", "shape", "begin", "n_bytes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(F.col("path").rlike(r"\.(safetensors|gguf)$")).mapInArrow(run, DIRECTORY)


def find_tensors(directory: DataFrame, part: str) -> DataFrame:
    return directory.where(F.col("name").contains(part))


def layer_type(name: str = "name"):
    """Kind of layer by the tensor's name."""
    c = F.lower(F.col(name))
    rules = [("embed", "embedding"), ("norm", "norm"), ("attn_q", "query"), ("q_proj", "query"), ("attn_k", "key"), ("k_proj", "key"), ("attn_v", "value"), ("v_proj", "value"), ("attn", "attention"), ("o_proj", "attention"), ("ffn", "feed_forward"), ("mlp", "feed_forward"), ("output", "output")]
    out = F.lit("other")
    for part, kind in reversed(rules):
        out = F.when(c.contains(part), kind).otherwise(out)
    return out


def _numbers(raw: bytes, dtype: str) -> ArrayLike:
    if dtype == "BF16":
        return from_bf16(np.frombuffer(raw, "<u2"))
    if dtype == "Q8_0":
        blocks = np.frombuffer(raw, np.dtype([("d", "<f2"), ("q", "i1", 32)]))
        return (blocks["d"].astype(np.float32)[:, None] * blocks["q"]).reshape(-1)
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1"}
    return np.frombuffer(raw, kinds[dtype])


def tensor_rows(directory: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """name, row, v (array<double>): rows are what the last axis spans. A task reads a block of whole rows."""
    width = F.when(F.size("shape") > 0, F.element_at("shape", -1)).otherwise(F.lit(1))
    rows = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x) / F.greatest(width, F.lit(1))
    frame = directory.where("n_bytes > 0").select("path", "name", "dtype", "begin", "n_bytes", width.alias("width"), rows.cast("bigint").alias("rows"))
    per = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(block_bytes) / (F.col("n_bytes") / F.col("rows"))))
    frame = frame.withColumn("per", per).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.col("per"))))

    def run(batches):
        for batch in batches:
            for path, name, dtype, begin, n_bytes, _, n_rows, per_block, first in zip(*(c.to_pylist() for c in batch.columns)):
                count, row_bytes = min(per_block, n_rows - first), n_bytes // n_rows
                system, place = open_uri(path)
                with system.open_input_file(place) as source:
                    v = _numbers(source.read_at(count * row_bytes, begin + first * row_bytes), dtype).astype(np.float64).reshape(count, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * count), pa.array(np.arange(first, first + count)), lists], ["name", "row", "v"])

    return frame.repartition("path", "name", "first").mapInArrow(run, "name string, row bigint, v array<double>")


def write_safetensors(rows: DataFrame, folder: str) -> None:
    """Writes (name, row, v) as one F32 file per tensor in ``folder``, a URI that all tasks reach; a tensor is one file
    and therefore one task's work."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("row")
        data = np.stack([np.asarray(v, "<f4") for v in frame["v"]])
        header = json.dumps({key[0]: {"dtype": "F32", "shape": list(data.shape), "data_offsets": [0, data.nbytes]}}).encode()
        header += b" " * (-len(header) % 8)
        system, base = open_uri(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{key[0].replace('/', '_')}.safetensors") as out:
            out.write(struct.pack("<Q", len(header)) + header + data.tobytes())
        return pd.DataFrame({"name": [key[0]], "n": [len(data)]})

    rows.groupBy("name").applyInPandas(run, "name string, n bigint").collect()
