"""Exact removal of long repeated passages from a whole corpus.

Every window of ``LENGTH`` bytes belongs to the smallest (by hash) of the ``GRAM``-byte strings in it, its anchor, so
equal windows have equal anchors at equal places. Windows in a row with one anchor form an entry.

1. Entries are dealt by anchor; an anchor that stands once holds no repeat. Equal entries are counted and collapsed before
   anything travels further: one that another repeats is covered as a whole, and an index need hold it once.
2. Entries that share an anchor but not all their bytes, the rims of repeated passages, go with their anchor into
   run-length indexes of a few megabytes, whose matching statistics tell which windows repeat. Anchors with too many
   different entries for one index are counted window by window in Spark instead.
3. A text of ``LENGTH`` bytes or more that occurs twice is covered by its copies; only one of a task's copies takes part
   in the steps above.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.typing import ArrayLike
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stored, text_of
from .run_length import RunLengthIndex

LENGTH, GRAM = 200, 72
WIDTH = LENGTH - GRAM + 1
#: Windows that are hashed at a time, bytes in one index, and entries of one anchor that an index may hold.
BLOCK, INDEX_BYTES, INDEX_ENTRIES = 1 << 20, 2 << 20, 20_000


@lru_cache(maxsize=1)
def _tables() -> tuple[ArrayLike, ArrayLike, ArrayLike]:
    base, size = 0xD6E8FEB86659FD93, BLOCK + LENGTH + 1
    rnd = np.random.default_rng(20)
    table = rnd.integers(0, 2**64, 256, np.uint64, endpoint=False)
    inverse = pow(base, -1, 1 << 64)
    powers = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64)
    return table, powers(base), powers(inverse)


def entries(data: ArrayLike) -> tuple[ArrayLike, ArrayLike, ArrayLike, ArrayLike]:
    """Anchor hash, content hash, first and last window start of the entries of one text of at most BLOCK windows."""
    table, power, inverse = _tables()
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power[:n], out=total[1:])
    gram = mix64((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    low, at = gram, np.arange(len(gram), dtype=np.int32)
    step = 1
    while step < WIDTH:
        shift = min(step, WIDTH - step)
        right = low[shift:] < low[:-shift]
        at = np.where(right, at[shift:], at[:-shift])
        low = np.where(right, low[shift:], low[:-shift])
        step += shift
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    anchor = at[first]
    whole = mix64((total[last + LENGTH] - total[first]) * inverse[first])
    shape = ((anchor - first).astype(np.uint64) << np.uint64(20)) | (last - first).astype(np.uint64)
    return gram[anchor], mix64(whole ^ mix64(shape + np.uint64(1))), first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, uid: rows are told apart by both, so two texts under one doc_id stay apart."""
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return frame.withColumn("uid", F.xxhash64("doc_id", "text"))


def _bytes_of(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def _distinct_entries(uid: int, a: ArrayLike, c: ArrayLike, first: ArrayLike, last: ArrayLike) -> list[ArrayLike]:
    """The columns of one text's rows. Entries that the text itself repeats, as periodic text does by the thousand, are
    one row of weight 2, and the stretches that they cover are rows of weight 0 under keys of their own."""
    _, back, times = np.unique(a ^ mix64(c), return_inverse=True, return_counts=True)
    many = times[back] > 1
    if not many.any():
        return [a.view(np.int64), c.view(np.int64), np.full(len(a), uid, np.int64), first << 8 | (last - first), np.ones(len(a), np.int64)]
    order = np.argsort(back, kind="stable")
    one = order[np.r_[True, back[order][1:] != back[order][:-1]]]
    low, high = first[many], last[many] + LENGTH
    fresh = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]])
    low, high = low[fresh], np.r_[np.maximum.accumulate(high)[fresh[1:] - 1], high.max()]
    own = mix64(np.arange(len(low), dtype=np.uint64) + np.uint64(uid & (2**64 - 1)))
    return [
        np.concatenate([a[one], own]).view(np.int64),
        np.concatenate([c[one].view(np.int64), high - low - LENGTH]),
        np.full(len(one) + len(low), uid, np.int64),
        np.concatenate([first[one] << 8 | (last[one] - first[one]), low << 8]),
        np.concatenate([np.where(many[one], 2, 1), np.zeros(len(low), np.int64)]),
    ]


def entry_rows(docs: DataFrame) -> DataFrame:
    """a (anchor), c (content), uid, at (first window << 8 | further windows), weight (times, 2 for more) of every distinct
    entry of a text; rows of weight 0 are stretches that the text repeats itself, with their further windows in ``c``."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list[list[ArrayLike]] = [[], [], [], [], []]
            for uid, raw in zip(batch.column(0).to_pylist(), _bytes_of(batch, 1)):
                if len(raw) < LENGTH or (key := xxhash.xxh3_64_intdigest(raw)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                data = np.frombuffer(raw, np.uint8)
                for begin in range(0, len(data) - LENGTH + 1, BLOCK):
                    a, c, first, last = entries(data[begin : begin + BLOCK + LENGTH - 1])
                    for column, values in zip(out, _distinct_entries(uid, a, c, first + begin, last + begin)):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "c", "uid", "at", "weight"])

    return _keyed(docs).select("uid", "text").mapInArrow(run, "a bigint, c bigint, uid bigint, at bigint, weight bigint")


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the asked entries (a, uid, at): a, uid, at, ctx."""

    def run(batches):
        for batch in batches:
            rows = []
            for uid, raw, wanted in zip(batch.column(0).to_pylist(), _bytes_of(batch, 1), batch.column(2).to_pylist()):
                for x in wanted:
                    first, more = x["at"] >> 8, x["at"] & 255
                    rows.append((x["a"], uid, x["at"], raw[first : first + more + LENGTH]))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "uid", "at", "ctx"])

    by_text = asked.groupBy("uid").agg(F.collect_set(F.struct("a", "at")).alias("wanted"))
    texts = _keyed(docs).select("uid", "text")
    found = texts.join(by_text.withColumnRenamed("uid", "of").hint("shuffle_merge"), F.col("uid") == F.col("of")).select("uid", "text", "wanted")
    return found.mapInArrow(run, "a bigint, uid bigint, at bigint, ctx binary")


def _indexed(contexts: DataFrame) -> DataFrame:
    """uid, low, high: the repeated stretches that run-length indexes find; each index holds whole anchors."""

    def spans(rows):
        index = RunLengthIndex([r[2] for r in rows])
        hit = index.repeated(LENGTH).astype(np.int8)
        edge = np.diff(np.r_[0, hit, 0])
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(index.starts, begin, side="right") - 1
        for i, lo, hi in zip(of.tolist(), (begin - index.starts[of]).tolist(), (end - index.starts[of]).tolist()):
            first = rows[i][1] >> 8
            yield rows[i][0], first + lo, first + hi - 1 + LENGTH

    def batch_of(found):
        columns = list(zip(*found)) if found else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "low", "high"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for a, uid, at, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                if size > INDEX_BYTES and a != last:
                    yield batch_of(list(spans(held)))
                    held, size = [], 0
                held.append((uid, at, ctx))
                size, last = size + len(ctx), a
        if held:
            yield batch_of(list(spans(held)))

    dealt = contexts.repartition("a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "uid bigint, low bigint, high bigint")


def _counted(contexts: DataFrame) -> DataFrame:
    """The same for anchors with too many entries: every window's digest, grouped."""

    def run(batches):
        for batch in batches:
            for a, uid, at, ctx in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ctx) - LENGTH + 1
                keys = [xxhash.xxh3_128_digest(ctx[i : i + LENGTH]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([uid] * n, pa.int64()), pa.array(range(at >> 8, (at >> 8) + n), pa.int64()), pa.array(keys, pa.binary())], ["uid", "low", "w"])

    windows = contexts.mapInArrow(run, "uid bigint, low bigint, w binary")
    often = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return windows.join(often, "w").select("uid", "low", (F.col("low") + LENGTH).alias("high"))


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """uid, stretches (array of struct<low, high>, bytes, may overlap) of the texts that have some."""
    rows = entry_rows(docs).repartition("a")
    by_anchor, by_content = Window.partitionBy("a"), Window.partitionBy("a", "c")
    met = rows.withColumn("same", F.sum("weight").over(by_content)).withColumn("all", F.sum("weight").over(by_anchor)).where("all > 1 or weight = 0")
    met = stored(met.select("a", "c", "uid", "at", "weight", "same"), "entries")
    further = F.when(F.col("weight") == 0, F.col("c")).otherwise(F.col("at").bitwiseAND(F.lit(255)))
    sure = met.where("same > 1 or weight = 0").select("uid", F.shiftright("at", 8).alias("low"), (F.shiftright("at", 8) + further + LENGTH).alias("high"))
    met = met.where("weight > 0")
    one = met.groupBy("a", "c").agg(F.min(F.struct("uid", "at")).alias("x"), F.first("same").alias("same"))
    one = one.withColumn("open", F.max((F.col("same") == 1).cast("int")).over(by_anchor)).withColumn("n", F.count("*").over(by_anchor))
    one = stored(one.where("open = 1").select("a", "x.uid", "x.at", "n"), "rims")
    found = sure.union(_indexed(_contexts(docs, one.where(F.col("n") <= INDEX_ENTRIES))))
    large = one.where(F.col("n") > INDEX_ENTRIES)
    if not large.isEmpty():
        found = found.union(_counted(_contexts(docs, large)))
    return stored(found.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("stretches")), "stretches")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left).

    Null and empty texts have no bytes; texts under 200 bytes lose none; rows that repeat a text lose all of it if it has
    200 bytes or more, whatever their doc_id, which may be null. Very long texts are hashed a block at a time; an empty table
    gives no rows; columns other than doc_id and text aren't read. Rows are told apart by 64 bits of doc_id and text.
    """
    size, text_key = F.octet_length("text"), [F.xxhash64("text").alias("t"), F.octet_length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")]
    keys = _keyed(docs).where(size >= LENGTH).select("uid", *text_key)
    often = keys.groupBy("t", "size", "crc").agg(F.count("*").alias("n")).where("n > 1")
    copied = keys.join(often, ["t", "size", "crc"], "left_semi").select("uid", F.array(F.struct(F.lit(0).cast("bigint").alias("low"), F.col("size").cast("bigint").alias("high"))).alias("stretches")).distinct()
    marks = repeated_stretches(docs).union(copied).groupBy("uid").agg(F.flatten(F.collect_list("stretches")).alias("stretches"))

    def run(batches):
        for batch in batches:
            n_bytes, removed, runs, digests, rests = [], [], [], [], []
            for raw, stretches in zip(_bytes_of(batch, 1), batch.column(2).to_pylist()):
                kept, at, gone, spans = [], 0, 0, 0
                for low, high in sorted((s["low"], s["high"]) for s in stretches or ()):
                    if low > at or spans == 0:
                        kept.append(raw[at:low])
                        spans += 1
                        gone += high - low
                        at = high
                    elif high > at:
                        gone += high - at
                        at = high
                rest = b"".join([*kept, raw[at:]])
                for column, value in zip((n_bytes, removed, runs, digests, rests), (len(raw), gone, spans, hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(value)
            longs = [pa.array(x, pa.int64()) for x in (n_bytes, removed, runs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(digests, pa.string()), pa.array(rests, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _keyed(docs).join(marks.withColumnRenamed("uid", "of").hint("shuffle_merge"), F.col("uid") == F.col("of"), "left").select("doc_id", "text", "stretches")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
