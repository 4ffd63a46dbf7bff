"""Tagged binary trees: byte patterns of named tags, also over files in blocks, and the tree itself with a stack."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.tensors import open_uri

#: Fixed values of the format: the tags' numbers, and the bytes of the payloads of a fixed size.
TAGS = ("end", "byte", "short", "int", "long", "float", "double", "bytes", "string", "list", "compound", "ints", "longs")
SIZES = {1: 1, 2: 2, 3: 4, 4: 8, 5: 4, 6: 8}


def pattern(tag: int, name: str) -> bytes:
    raw = name.encode()
    return bytes([tag]) + struct.pack(">H", len(raw)) + raw


def find_all(data: bytes, patterns: list[bytes], first: int = 0) -> Iterator[tuple[int, int, int]]:
    """(pattern, offset, offset behind it) of every place of every pattern, also overlapping ones; offsets from ``first``."""
    for i, p in enumerate(patterns):
        at = data.find(p)
        while at >= 0:
            yield i, first + at, first + at + len(p)
            at = data.find(p, at + 1)


def scan(frame: DataFrame, key: str, data: str, schema: list[tuple[int, str]]) -> DataFrame:
    """key, entry (of the schema: tag number and name), tag_offset, payload_offset, for a column of bytes; a null has none."""
    patterns = [pattern(*s) for s in schema]
    kind = frame.schema[key].dataType

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, raw in zip(keys, batch.column(1).to_pylist()):
                rows += [(k, *f) for f in find_all(raw, patterns)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], [key, "entry", "tag_offset", "payload_offset"])

    return frame.where(F.col(data).isNotNull()).select(key, data).mapInArrow(run, f"{key} {kind.simpleString()}, entry int, tag_offset bigint, payload_offset bigint")


def scan_files(spark: SparkSession, folder: str, schema: list[tuple[int, str]], block: int = 64 << 20) -> DataFrame:
    """path, entry, tag_offset, payload_offset for the files of a folder. A task reads one block and as many bytes behind it
    as a pattern can reach over its border, so that no file is whole in one task and each place is found once."""
    patterns = [pattern(*s) for s in schema]
    reach = max(map(len, patterns), default=1) - 1
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block).cast("bigint"))).alias("first"))

    def run(batches):
        for batch in batches:
            rows = []
            for path, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = open_uri(path)
                with system.open_input_file(place) as source:
                    raw = source.read_at(min(block + reach, length - first), first)
                rows += [(path, *f) for f in find_all(raw, patterns, first) if f[1] < first + block]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["path", "entry", "tag_offset", "payload_offset"])

    return parts.repartition("path", "first").mapInArrow(run, "path string, entry int, tag_offset bigint, payload_offset bigint")


def walk(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(path, tag, payload_offset, depth) of every named tag of a tree and of the elements of its lists, in file order. What
    lies behind a payload that the data doesn't hold isn't reported."""
    stack: list[tuple[str, int, int]] = []  # a compound: (path, -1, 0); a list: (path, element's tag, elements left)
    at, path, tag, end = 0, "", 0, len(data)
    while at <= end:
        if not stack or stack[-1][1] < 0:
            if at >= end:
                return
            tag, at = data[at], at + 1
            if tag == 0:
                if not stack:
                    return
                stack.pop()
                continue
            if tag >= len(TAGS) or at + 2 > end:
                return
            n = struct.unpack_from(">H", data, at)[0]
            if at + 2 + n > end:
                return
            path = (stack[-1][0] + "/" if stack else "") + data[at + 2 : at + 2 + n].decode("utf-8", "replace")
            at += 2 + n
        else:
            base, tag, left = stack.pop()
            if left == 0:
                continue
            stack.append((base, tag, left - 1))
            path = f"{base}[]"
        if tag in SIZES:
            size = SIZES[tag]
        elif tag == 8:
            size = 2 + struct.unpack_from(">H", data, at)[0] if at + 2 <= end else end + 1
        elif tag in (7, 11, 12):
            size = 4 + {7: 1, 11: 4, 12: 8}[tag] * max(0, struct.unpack_from(">i", data, at)[0]) if at + 4 <= end else end + 1
        else:
            size = 0
        if at + size > end or tag == 9 and at + 5 > end:
            return
        yield path, tag, at, len(stack)
        if tag == 10:
            stack.append((path, -1, 0))
        elif tag == 9:
            inner, count = data[at], struct.unpack_from(">i", data, at + 1)[0]
            if inner >= len(TAGS):
                return
            stack.append((path, inner, max(0, count) if inner else 0))
            size = 5
        at += size


def tags(frame: DataFrame, key: str, data: str) -> DataFrame:
    """key, path, tag, payload_offset, depth of all tags of the trees in a column of bytes."""
    kind = frame.schema[key].dataType

    def run(batches):
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(k, *t) for t in walk(raw)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32())], [key, "path", "tag", "payload_offset", "depth"])

    return frame.where(F.col(data).isNotNull()).select(key, data).mapInArrow(run, f"{key} {kind.simpleString()}, path string, tag int, payload_offset bigint, depth int")


def _named(tag: int, name: str) -> Column:
    return F.unhex(F.lit(pattern(tag, name).hex()))


def string_tag(name: str, value: Column) -> Column:
    """A named string of fewer than 2^16 bytes."""
    raw = F.encode(value, "UTF-8")
    return F.concat(_named(8, name), F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("bigint")), 4, "0")), raw)


def long_tag(name: str, value: Column) -> Column:
    return F.concat(_named(4, name), F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0")))


def compound(name: str, *parts: Column) -> Column:
    return F.concat(_named(10, name), *parts, F.unhex(F.lit("00")))
