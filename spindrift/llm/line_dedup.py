"""Near-duplicate lines over a whole corpus: a segment-partition edit join.

A line is cut into ``tau + 1`` segments; within ``tau`` edits of another line, one segment at least survives unchanged
and not far from its place. Lines are indexed by (length, segment number, segment) and probe the indexes of all lengths
up to ``tau`` below their own with the substrings that can match. Every line is compared with the first line of one of
the index entries that it meets; lines of an entry that are not yet in one class are then compared with each other. Candidates are
verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SKETCH_WORDS, SPACE, let, sketch, sketch_lacks, spread_join, stored, text_of
from .graph import connected

TAU, MIN_CHARS = 2, 24


def _common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two strings is at most ``k``.

    Equal ends are dropped. Then bit ``t`` of a few integers stands for row ``j - k + t`` of column ``j``: only the band
    of ``2k + 1`` rows around the diagonal is kept, as vertical differences, and moves down a row with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    start = _common_start(a, b)
    a, b = a[start:], b[start:]
    end = _common_start(a[::-1], b[::-1])
    if end:
        a, b = a[:-end], b[:-end]
    m, n = len(a), len(b)
    if n == 0 or m <= k:
        return m <= k
    mask, top, diagonal = (1 << (2 * k + 1)) - 1, 1 << (2 * k), 1 << k
    up, down, score = mask & ~((diagonal << 1) - 1), 0, 0
    for j in range(1, n + 1):
        c, equal = b[j - 1], 0
        first = j - k - 1
        for t in range(max(0, -first), min(2 * k + 1, m - first)):
            if a[first + t] == c:
                equal |= 1 << t
        up, down = (up >> 1) | top, down >> 1
        same = ((((equal & up) + up) ^ up) | equal | down) & mask
        right = (down | ~(same | up)) & mask
        left = same & up
        if not same & diagonal:
            score += 1
            if score > k + m - n:
                return False
        grown = (right << 1) | 1
        up = ((left << 1) | ~(same | grown)) & mask
        down = grown & same & mask
    for t in range(k + 1, k + 1 + m - n):
        score += ((up >> t) & 1) - ((down >> t) & 1)
    return score <= k


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a line of ``length`` characters, the longer ones last."""
    size, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        here = size + (i > tau - longer)
        out.append((at, here))
        at += here
    return out


def signatures(line: str, tau: int) -> list[tuple[int, bool]]:
    """Keys of a line: its own segments (True), and the other substrings that can match one of a line as long or up to
    ``tau`` shorter. A key is a hash of length, segment number and substring."""
    return list(zip(keys(line, tau).tolist(), layout(len(line), tau)[1].tolist()))


@lru_cache(maxsize=4096)
def layout(n: int, tau: int) -> tuple[list[tuple[int, int, int]], ArrayLike]:
    """Start, end and seed of the substrings that give the keys of a line of ``n`` characters; which are its own segments."""
    out, own = [], []
    for delta in range(tau + 1):
        for i, (p, size) in enumerate(segments(n - delta, tau)):
            low = max(0, p - i, p + delta - (tau - i))
            high = min(n - size, p + i, p + delta + (tau - i))
            seed = (n - delta) * 64 + i
            for q in range(low, high + 1):
                out.append((q, q + size, seed))
                own.append(delta == 0 and q == p)
    return out, np.array(own, bool)


def keys(line: str, tau: int) -> ArrayLike:
    """The keys of ``signatures`` alone. A line is encoded once; where bytes are not characters, each substring is."""
    digest, raw = xxhash.xxh3_64_intdigest, line.encode("utf-8", "surrogatepass")
    if len(raw) == len(line):
        found = [digest(raw[p:q], seed) for p, q, seed in layout(len(line), tau)[0]]
    else:
        found = [digest(line[p:q].encode("utf-8", "surrogatepass"), seed) for p, q, seed in layout(len(line), tau)[0]]
    return np.array(found, np.uint64).view(np.int64)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that stand for a row: rows with equal doc_id and text count as one document."""
    return [F.xxhash64(doc_id, text).alias("u1"), F.xxhash64(F.lit(1), text, doc_id).alias("u2")]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, u1, u2 (the row's key), line_no, line, h: the lines that hold a word."""
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    frame = frame.select("*", *_row_key(F.col("doc_id"), F.col("text")))
    each = frame.select("doc_id", "u1", "u2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where(F.col("line").rlike(f"[^{SPACE}]")).withColumn("h", F.xxhash64("line"))


def _second(line: Column) -> Column:
    """64 more bits of a line: with ``h`` they tell all lines apart where lines are removed."""
    return F.xxhash64(F.lit(1), line)


def _keys(lines: DataFrame, tau: int, min_chars: int) -> DataFrame:
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            hs, found, own = [], [], []
            for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(h)
                hs.append(h)
                found.append(keys(line, tau))
                own.append(layout(len(line), tau)[1])
            times = [len(k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(np.repeat(np.array(hs, np.int64), times)), pa.array(np.concatenate(own) if own else np.zeros(0, bool))], ["key", "h", "own"])

    return lines.where(F.char_length("line") >= min_chars).select("h", "line").mapInArrow(run, "key bigint, h bigint, own boolean")


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, line of the wanted hashes."""
    once = lines.groupBy("h").agg(F.first("line").alias("line"))  # a task hands a line on once, however common
    return once.join(wanted.select(F.col("h").alias("of")).distinct().hint("shuffle_merge"), F.col("h") == F.col("of"), "left_semi")


def _sketches(texts: DataFrame) -> DataFrame:
    """h, 16 words of 64 bits: which trigrams a line holds, by hash; and 2 words: which characters stand in it an odd number
    of times, by code modulo 128."""

    def run(batches):
        for batch in batches:
            rows = []
            for line in batch.column(1).to_pylist():
                c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                g = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
                odd = np.bincount((c & np.uint64(127)).astype(np.int64), minlength=128) & 1
                rows.append(sketch((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) + np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist())
            columns = list(zip(*rows)) if rows else [[]] * (SKETCH_WORDS + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    names = ["h", *(f"w{i}" for i in range(SKETCH_WORDS + 2))]
    return texts.select("h", "line").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _verified(pairs: DataFrame, texts: DataFrame, tau: int, per_task: int = 64) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines are within ``tau`` edits. Line ``a`` travels to each of its tasks once."""
    pairs = pairs.withColumn("salts", F.ceil(F.count("*").over(Window.partitionBy("a")) / per_task))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    hub = pairs.select("a", "salts").distinct()
    hub = hub.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("of"), F.lit(0).alias("role"))
    asked = hub.union(pairs.select("a", "salt", F.col("b").alias("of"), F.lit(1).alias("role")))
    rows = texts.join(asked.hint("shuffle_merge"), F.col("h") == F.col("of")).select("a", "salt", "role", "of", "line")

    def run(batches):
        hub_of, hub_line = None, ""
        for batch in batches:
            left, right = [], []
            for a, salt, role, of, line in zip(*(c.to_pylist() for c in batch.columns)):
                if role == 0:
                    hub_of, hub_line = (a, salt), line
                elif hub_of == (a, salt) and within(hub_line, line, tau):
                    left.append(a)
                    right.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a bigint, b bigint")


def line_classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, h2 (a line's 128 bits), component: the lines that have a near copy with other characters; all others are alone.

    Candidates are drawn by ``h`` alone. Of lines that share it (chance 2^-64 a pair) one is compared; the others count as alone."""
    lines = _lines(docs)
    rows = _keys(lines, tau, min_chars).repartition("key").groupBy("key", "h").agg(F.max("own").alias("own"))
    by_key = Window.partitionBy("key")
    met = rows.withColumn("c", F.count("*").over(by_key)).withColumn("pivot", F.min(F.when(F.col("own"), F.col("h"))).over(by_key))
    met = stored(met.where("c > 1 and pivot is not null").select("key", "h", "own", "pivot"), "keys")
    texts = stored(_texts(lines, met), "line-texts")
    # One of its index entries' first lines serves each line here; what that leaves open is seen to below.
    first = met.where("h <> pivot").groupBy(F.col("h").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")
    links = stored(_verified(first, texts, tau), "near-lines")
    if links.isEmpty():
        found = docs.sparkSession.createDataFrame([], "node bigint, component bigint")  # no line has a near copy
    else:
        found = stored(connected(links), "line-components")
    label = met.join(found, F.col("h") == F.col("node"), "left").select("key", "h", "own", F.coalesce("component", "h").alias("component"))
    label = label.withColumn("lo", F.min("component").over(by_key)).withColumn("hi", F.max("component").over(by_key)).where("lo < hi")
    label = stored(label.drop("lo", "hi"), "open-lines")
    # An edit takes three trigrams of a line at most, and changes the parity of two characters: pairs whose sketches differ
    # by more aren't handed on.
    words = _sketches(texts.join(label.select(F.col("h").alias("of")).distinct(), F.col("h") == F.col("of"), "left_semi"))
    label = stored(label.join(words, "h"), "sketched-lines")
    side = lambda h, c, w: [F.col("h").alias(h), F.col("component").alias(c), *[F.col(f"w{i}").alias(f"{w}{i}") for i in range(SKETCH_WORDS + 2)]]
    left = label.where("own").select("key", *side("a", "ca", "x"))
    right = label.select("key", *side("b", "cb", "y"), F.col("own").alias("own_b"))
    odd = sum(F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in (SKETCH_WORDS, SKETCH_WORDS + 1))
    alike = (odd <= 2 * tau) & (sketch_lacks("x", "y") <= 3 * tau) & (sketch_lacks("y", "x") <= 3 * tau)
    rest = left.join(right.hint("shuffle_merge"), "key").where((F.col("ca") != F.col("cb")) & (~F.col("own_b") | (F.col("a") < F.col("b"))) & alike)
    rest = rest.select("a", "b").distinct().join(links.select(F.col("a"), F.col("b")), ["a", "b"], "left_anti")
    rest = stored(rest, "line-rest")
    if not rest.isEmpty():
        more = stored(_verified(rest, texts, tau), "near-lines")
        if not more.isEmpty():
            found = connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    second = texts.select("h", _second(F.col("line")).alias("h2"))
    return found.join(second.hint("shuffle_merge"), F.col("node") == F.col("h")).select("h", "h2", "component")


def repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """u1, u2, removed: the line numbers (from 0) of each document that are not the first of their class."""
    lines = _lines(docs).select("doc_id", "u1", "u2", "line_no", "h", _second(F.col("line")).alias("h2"))
    classes = stored(line_classes(docs, tau, min_chars), "line-classes").select(F.col("h").alias("of"), F.col("h2").alias("of2"), "component")
    joined = lines.join(classes, (F.col("h") == F.col("of")) & (F.col("h2") == F.col("of2")), "left")
    # A line with near copies goes by its component, any other by its own 128 bits.
    placed = joined.select("doc_id", "u1", "u2", "line_no", F.coalesce("component", "h").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2"), F.col("component").isNull().alias("alone"))
    names = ["c1", "c2", "alone"]
    firsts = placed.groupBy(*names).agg(F.min(F.struct("doc_id", "line_no", "u1", "u2")).alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1")
    later = spread_join(placed, stored(firsts, "first-lines"), names, ["u1", "line_no"])
    later = later.where(~((F.col("u1") == F.col("first.u1")) & (F.col("u2") == F.col("first.u2")) & (F.col("line_no") == F.col("first.line_no"))))
    return later.groupBy("u1", "u2").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without_repeats(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """source_row (a struct of all columns of ``docs``, its ``text`` less the repeated lines), n_lines, n_removed.

    Lines hold a word and end at newlines. Two lines are in one class if they are equal, or if both have ``min_chars``
    characters or more and up to ``tau`` edits lead from one to the other, directly or by way of other lines. The first
    line of a class (by doc_id, then line number) stays, the others go; lines without a word always stay. A null text
    stays null and has no lines; an empty table gives no rows; rows with equal doc_id and text count as one document and
    lose the same lines; very long texts cost time in proportion. Columns of any name pass through in the struct.
    """
    removed = stored(repeated_lines(docs, tau, min_chars), "removed-lines").select(F.col("u1").alias("r1"), F.col("u2").alias("r2"), "removed")
    row = F.struct(*[docs[c] for c in docs.columns])
    keyed = docs.select(row.alias("source_row"), docs["text"].cast("string").alias("text"), *_row_key(docs["doc_id"].cast("bigint"), F.coalesce(docs["text"].cast("string"), F.lit(""))))
    joined = keyed.join(removed.hint("shuffle_merge"), (F.col("u1") == F.col("r1")) & (F.col("u2") == F.col("r2")), "left")
    parts = F.split(F.col("text"), "\n")
    numbers = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed"))
    kept = let(parts, lambda x: F.array_join(F.transform(numbers(x), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(parts, lambda x: x.rlike(f"[^{SPACE}]"))))
    n_removed = F.coalesce(F.size("removed"), F.lit(0))
    return joined.select(F.col("source_row").withField("text", text).alias("source_row"), n_lines.cast("bigint").alias("n_lines"), F.greatest(n_removed, F.lit(0)).cast("bigint").alias("n_removed"))
