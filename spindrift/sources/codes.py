"""Files of 17-number codes as a Spark data source: containers of tensors, plain code caches, palettes and palette layers.

``spark.read.format("codes").option("kind", "container").load(folder)`` plans one task for each block of rows of each file,
whose small pieces share blocks; planning reads headers only. Writers put each task's rows into files of their own under ``_temporary`` and the driver
moves those of the attempts that count into place when all tasks are done, so a failed or repeated task leaves no file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spindrift.functions.palette import DIMENSIONS
from spindrift.sources.tensors import open_uri

#: Fixed values of the formats: magic words, and the numbers of a container's layer types.
CONTAINER, LAYERS = b"BGZ7", b"PAL8"
LAYER_TYPES = ("attention", "feed_forward", "conv2d", "norm", "embedding", "skip")
#: Bytes of a code, rows that a task reads at most, and bytes that planning reads at once.
WIDTH, BLOCK, BUFFER = 2 * DIMENSIONS, 262_144, 1 << 16
SCHEMAS = {"container": "tensor string, layer string, n_cols int, row bigint, code array<int>", "cache": "row bigint, code array<int>"}


@dataclass
class Block(InputPartition):
    """``count`` rows of a file in ``size`` bytes from ``offset`` on, which is in the first piece's codes: of that one the
    block has ``rows``, from row ``first`` on. Pieces that follow are read with their headers."""

    path: str
    offset: int
    size: int
    count: int
    first: int = 0
    rows: int = 0
    tensor: str | None = None
    layer: str | None = None
    n_cols: int = 0


@dataclass
class Piece:
    """Consecutive rows of a tensor; ``offset`` is that of their codes."""

    offset: int
    first: int
    n_rows: int
    tensor: str | None = None
    layer: str | None = None
    n_cols: int = 0


def _name(name: str) -> tuple[str, int]:
    """A tensor in several files is written in pieces, whose names end with # and their first row."""
    head, mark, first = name.rpartition("#")
    return (head, int(first)) if mark and first.isdigit() else (name, 0)


def _piece(take: Callable[[int, int], bytes], at: int) -> Piece:
    """The piece whose header is at an offset; ``take`` gives a number of bytes from an offset on."""
    length = struct.unpack("<I", take(4, at))[0]
    raw = take(length + 9, at + 4)
    (name, first), (kind, n_rows, n_cols) = _name(raw[:length].decode()), struct.unpack_from("<BII", raw, length)
    return Piece(at + 13 + length, first, n_rows, name, LAYER_TYPES[min(kind, 5)], n_cols)


def _buffered(source) -> Callable[[int, int], bytes]:
    """Reads of a few bytes, in order, out of larger ones."""
    start, held = 0, b""

    def take(n: int, at: int) -> bytes:
        nonlocal start, held
        if not start <= at <= at + n <= start + len(held):
            start, held = at, source.read_at(max(n, BUFFER), at)
        return held[at - start : at - start + n]

    return take


def _container_pieces(path: str, source) -> Iterator[Piece]:
    take = _buffered(source)
    if take(4, 0) != CONTAINER:
        raise ValueError(f"{path} is not a container of codes")
    n, at = struct.unpack("<I", take(4, 4))[0], 8
    for _ in range(n):
        piece = _piece(take, at)
        yield piece
        at = piece.offset + piece.n_rows * WIDTH


def _cache_pieces(path: str, source) -> Iterator[Piece]:
    n, width = struct.unpack("<II", source.read_at(8, 0))
    if width != DIMENSIONS:
        raise ValueError(f"{path} has codes of {width} numbers, not of {DIMENSIONS}")
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].rsplit("-", 1)[-1]
    yield Piece(8, int(stem) if stem.isdigit() else 0, n)


def _blocks(path: str, pieces: Iterator[Piece], most: int) -> Iterator[Block]:
    """Blocks of up to ``most`` rows: a large piece is cut, small ones that follow each other share a block."""
    block = None
    for p in pieces:
        done = 0
        while done < p.n_rows:
            if block is None:
                block = Block(path, p.offset + done * WIDTH, 0, 0, p.first + done, min(most, p.n_rows - done), p.tensor, p.layer, p.n_cols)
            n = min(most - block.count, p.n_rows - done)
            done += n
            block.count += n
            block.size = p.offset + done * WIDTH - block.offset
            if block.count == most:
                yield block
                block = None
    if block is not None:
        yield block


def _lists(raw: bytes) -> pa.Array:
    codes = np.frombuffer(raw, "<i2").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(codes) + 1, DIMENSIONS), pa.int32()), pa.array(codes))


class CodesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "container")
        self.block = int(options.get("block", BLOCK))

    def partitions(self) -> list[Block]:
        system, base = open_uri(self.path)
        info = system.get_file_info(base)
        every = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        out = []
        for x in sorted(every, key=lambda x: x.path):
            with system.open_input_file(x.path) as source:
                pieces = (_container_pieces if self.kind == "container" else _cache_pieces)(x.path, source)
                out += _blocks(x.path, pieces, self.block)
        return out or [Block("", 0, 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMAS[self.kind].split(", ")]
        raw = b""
        if partition.count:
            with open_uri(self.path)[0].open_input_file(partition.path) as source:
                raw = source.read_at(partition.size, partition.offset)
        take, left, codes = lambda n, at: raw[at : at + n], partition.count, []
        pieces = [Piece(0, partition.first, partition.rows, partition.tensor, partition.layer, partition.n_cols)]
        while True:
            last = pieces[-1]
            last.n_rows = min(last.n_rows, left)
            end = last.offset + last.n_rows * WIDTH
            codes.append(raw[last.offset : end])
            left -= last.n_rows
            if not left:
                break
            pieces.append(_piece(take, end))
        ns = [p.n_rows for p in pieces]
        columns = [pa.array(np.concatenate([np.arange(p.first, p.first + p.n_rows) for p in pieces])), _lists(b"".join(codes))]
        if self.kind == "container":
            each = lambda values, t: pa.array(np.repeat(np.asarray(values, object), ns), t)
            columns = [each([p.tensor for p in pieces], pa.string()), each([p.layer for p in pieces], pa.string()), each([p.n_cols for p in pieces], pa.int32()), *columns]
        yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CodesWriter(DataSourceWriter):
    """Rows come sorted by tensor and row (a cache's: by row); a task's consecutive rows are a piece."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite, self.run = options["path"], options.get("kind", "container"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        pieces, key, last = [], None, None  # a piece: (tensor, layer, n_cols, first row, codes)
        for r in rows:
            head = (r.tensor, r.layer, r.n_cols) if self.kind == "container" else ()
            if head != key or r.row != last + 1:
                pieces.append((*head, r.row, []))
                key = head
            pieces[-1][-1].append(np.asarray(r.code, "<i2").tobytes())
            last = r.row
        if not pieces:
            return Written([])
        system, base = open_uri(self.path)
        system.create_dir(f"{base}/_temporary/{self.run}", recursive=True)
        files = []
        if self.kind == "container":
            files.append((f"codes-{uuid.uuid4().hex}.bgz7", [CONTAINER, struct.pack("<I", len(pieces)), *(x for p in pieces for x in self._tensor(*p))]))
        else:
            files += [(f"codes-{first:015d}.b17", [struct.pack("<II", len(codes), DIMENSIONS), *codes]) for first, codes in pieces]
        done = []
        for name, parts in files:
            place = f"{base}/_temporary/{self.run}/{uuid.uuid4().hex}"
            with system.open_output_stream(place) as out:
                for part in parts:
                    out.write(part)
            done.append((place, f"{base}/{name}"))
        return Written(done)

    @staticmethod
    def _tensor(tensor: str, layer: str, n_cols: int, first: int, codes: list[bytes]) -> list[bytes]:
        name = (f"{tensor}#{first}" if first or _name(tensor)[0] != tensor else tensor).encode()
        kind = LAYER_TYPES.index(layer) if layer in LAYER_TYPES else 5
        return [struct.pack("<I", len(name)), name, struct.pack("<BII", kind, len(codes), n_cols), *codes]

    def commit(self, messages: list[Written]) -> None:
        system, base = open_uri(self.path)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(base)):
                if x.type == fs.FileType.File:
                    system.delete_file(x.path)
        for message in messages:
            for place, final in message.files if message else []:
                system.move(place, final)
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = open_uri(self.path)
        place = f"{base}/_temporary"
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class Codes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codes"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "container")]

    def reader(self, schema: StructType) -> CodesReader:
        return CodesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CodesWriter:
        return CodesWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Codes)


def write_codes(rows: DataFrame, folder: str, kind: str = "container", tasks: int = 8) -> None:
    """Writes rows (columns as in SCHEMAS) from ``tasks`` tasks; ranges of rows go to one task each, so that a large tensor
    is written by several."""
    register(rows.sparkSession)
    order = ["tensor", "row"] if kind == "container" else ["row"]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt.select(*[x.split()[0] for x in SCHEMAS[kind].split(", ")]).write.format("codes").option("kind", kind).mode("overwrite").save(folder)


def read_codes(spark: SparkSession, folder: str, kind: str = "container", block: int = BLOCK) -> DataFrame:
    register(spark)
    return spark.read.format("codes").option("kind", kind).option("block", str(block)).load(folder)


def palette_bytes(centroids: ArrayLike, assignments: ArrayLike) -> bytes:
    """A palette of at most 256 codes with each row's entry."""
    c, a = np.asarray(centroids, "<i2"), np.asarray(assignments, np.uint8)
    return struct.pack("<III", len(a), DIMENSIONS, len(c)) + c.tobytes() + a.tobytes()


def palette_of(raw: bytes) -> tuple[ArrayLike, ArrayLike, ArrayLike]:
    """Codes, assignments, and the table of L1 distances between the codes, within 16 bits."""
    n, width, k = struct.unpack_from("<III", raw)
    if width != DIMENSIONS or len(raw) != 12 + 2 * width * k + n:
        raise ValueError("not a palette")
    c = np.frombuffer(raw, "<i2", k * width, 12).reshape(k, width)
    gaps = np.abs(c[:, None].astype(np.int64) - c[None]).sum(2)
    return c, np.frombuffer(raw, np.uint8, n, 12 + 2 * width * k), np.minimum(gaps, 65535).astype(np.uint16)


def layers_bytes(layers: ArrayLike, style: int) -> bytes:
    """Eight layers of 64 x 64 bits (a word for each row) and a style number."""
    words = np.asarray(layers, "<u8")
    if words.shape != (8, 64):
        raise ValueError("eight layers of 64 rows")
    return LAYERS + bytes([style]) + words.tobytes()


def layers_of(raw: bytes) -> tuple[ArrayLike, int]:
    if raw[:4] != LAYERS or len(raw) != 5 + 8 * 64 * 8:
        raise ValueError("not palette layers")
    return np.frombuffer(raw, "<u8", 512, 5).reshape(8, 64), raw[4]


def index_tensors(spark: SparkSession, source: str, target: str, tasks: int = 8) -> DataFrame:
    """Projects every row of the tensors of a folder's model files to a code and writes containers; returns the tensors'
    name, n_rows, n_cols, and the bytes before (as 32-bit floats) and after.

    Rows are read in blocks at their offsets, by as many tasks as there are blocks: no tensor is ever whole in one task."""
    from spindrift.functions.palette import project
    from spindrift.sources import tensors

    directory = tensors.list_tensors(spark, source)
    kinds = directory.select(F.col("name").alias("tensor"), layer_of(F.col("name")).alias("layer"))
    rows = tensors.tensor_rows(directory).select(F.col("name").alias("tensor"), "row", F.size("v").alias("n_cols"), project(F.col("v")).alias("code"))
    write_codes(rows.join(kinds, "tensor"), target, tasks=tasks)
    found = read_codes(spark, target).groupBy("tensor", "layer", "n_cols").agg(F.count("*").alias("n_rows"))
    return found.select("tensor", "layer", "n_rows", "n_cols", (F.col("n_rows") * F.col("n_cols") * 4).alias("bytes_before"), (F.col("n_rows") * WIDTH).alias("bytes_after"))


def layer_of(name: Column) -> Column:
    """A tensor's layer type by its name."""
    low = F.lower(name)
    has = lambda *parts: low.rlike("|".join(parts))
    return F.when(has("norm", "ln_"), "norm").when(has("embd", "embed", "wte"), "embedding").when(has("attn", "attention", "[qkvo]_proj"), "attention").when(has("ffn", "mlp", "gate", "up_proj", "down_proj"), "feed_forward").when(has("conv"), "conv2d").otherwise("skip")
