"""All pairs of two tables of equally long vectors, block by block: rows are packed to blocks of bytes, each block of the
base meets each of the queries, and numpy compares the two. What leaves a task is bounded by what is asked for, not by
the number of pairs, except where all pairs within a distance are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from numpy.typing import ArrayLike
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.lineage import kept
from spindrift.operators.search import pair_with

#: Rows of a block of the base and of the queries.
BASE_ROWS, QUERY_ROWS = 2_048, 512


def pack(frame: DataFrame, key: str, vector: str, dtype: str, rows: int) -> DataFrame:
    """ids, data, width: up to ``rows`` rows a block, all of one width; rows with a null vector or element stay out.
    ``dtype`` is numpy's, and must hold the vector's numbers."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            widths, values = np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy(zero_copy_only=False)
            starts, ids = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64), batch.column(0).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                for i in range(0, len(at), rows):
                    some = at[i : i + rows]
                    data = values[starts[some][:, None] + np.arange(width)].astype(dtype)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([int(width)], pa.int32())], ["ids", "data", "width"])

    whole = frame.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, "ids binary, data binary, width int")


def meet(base: DataFrame, queries: DataFrame, key: str, vector: str, dtype: str, visit: Callable[[Iterator], Iterator], schema: str, wider: int = 0) -> DataFrame:
    """What ``visit`` makes of a task's pairs of blocks: it gets an iterator of (ids, vectors, query ids, query vectors) and
    yields Arrow batches. ``queries`` have the columns query_id and q; rows of another width than theirs (and ``wider``) are
    passed over.

    The base's blocks are stored and dealt out evenly, so that a table in one file is no single task."""
    def run(batches):
        def pairs():
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, data, width, q_ids, q_data, q_width = (batch.column(c)[i].as_py() for c in range(6))
                    if width == q_width + wider:
                        x, q = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                        yield x, np.frombuffer(data, dtype).reshape(len(x), width), q, np.frombuffer(q_data, dtype).reshape(len(q), q_width)

        yield from visit(pairs())

    tasks = 4 * base.sparkSession.sparkContext.defaultParallelism
    blocks = kept(pack(base, key, vector, dtype, BASE_ROWS)).repartition(tasks)
    asked = kept(pack(queries, "query_id", "q", dtype, QUERY_ROWS).toDF("q_ids", "q_data", "q_width"))
    return pair_with(blocks, asked).select("ids", "data", "width", "q_ids", "q_data", "q_width").mapInArrow(run, schema)


class Best:
    """The ``k`` rows of least cost per query so far, ties by id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def cap(self, query: int) -> float:
        """The cost that a row must not exceed to be among them."""
        held = self.held.get(query)
        return held[0][-1] if held is not None and len(held[0]) == self.k else np.inf

    def add(self, query: int, costs: ArrayLike, ids: ArrayLike) -> None:
        held = self.held.get(query)
        if held is not None:
            costs, ids = np.concatenate([held[0], costs]), np.concatenate([held[1], ids])
        order = np.lexsort((ids, costs))[: self.k]
        self.held[query] = costs[order], ids[order]

    def batches(self, key: str, kind) -> Iterator:
        """query_id, key, cost of all that is held."""
        import pyarrow as pa

        queries = list(self.held)
        for i in range(0, len(queries), 1_000):
            some = queries[i : i + 1_000]
            costs, ids = (np.concatenate([self.held[q][j] for q in some]) for j in (0, 1))
            number = np.repeat(np.asarray(some, np.int64), [len(self.held[q][0]) for q in some])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids.astype(np.int64)), pa.array(costs, kind)], ["query_id", key, "cost"])


def differing_bits(x: ArrayLike, q: ArrayLike) -> ArrayLike:
    """Of rows of 64-bit words and one more of as many; ``x`` comes word by word: words x rows. numpy counts the bits of a
    signed number's magnitude, so words are taken as unsigned."""
    d = np.zeros(x.shape[1], np.int64 if len(x) > 500 else np.uint16)
    for word, w in zip(x.view(np.uint64), q.view(np.uint64)):
        d += np.bitwise_count(word ^ w)
    return d


def nearest_prints(base: DataFrame, queries: DataFrame, key: str, words: str, k: int) -> DataFrame:
    """query_id, key, cost: differing bits; of each task the ``k`` nearest rows per query (query_id, q: words)."""
    import pyarrow as pa

    def visit(pairs):
        best, seen, turned = Best(k), None, None
        for ids, x, q_ids, q in pairs:
            if seen is None or len(seen) != len(ids) or (seen != ids).any():
                seen, turned = ids, np.ascontiguousarray(x.T)
            for i, query in enumerate(q_ids.tolist()):
                d = differing_bits(turned, q[i])
                cap = best.cap(query)
                if len(d) > k and cap == np.inf:
                    cap = np.partition(d, k - 1)[k - 1]
                near = np.flatnonzero(d <= cap)
                if len(near):
                    best.add(query, d[near].astype(np.int64), ids[near])
        yield from best.batches(key, pa.int64())

    return meet(base, queries, key, words, "<i8", visit, f"query_id bigint, {key} bigint, cost bigint")


def nearest_cosines(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query_id, key, cost: the cosine, negated; of each task the ``k`` rows of the largest per query (query_id, q). A vector
    of zeros has the cosine 0. A matrix product finds candidates with a margin for its own error; what ranks them are sums
    in the order of the numbers, so that equal vectors tie."""
    import pyarrow as pa

    def norms(x):
        return np.sqrt((x * x).cumsum(1)[:, -1]) if x.shape[1] else np.zeros(len(x))

    def unit(x, n):
        return x / np.where(n > 0, n, 1.0)[:, None]

    def visit(pairs):
        best = Best(k)
        for ids, x, q_ids, q in pairs:
            nx, nq = norms(x), norms(q)
            about = unit(q, nq) @ unit(x, nx).T
            caps = np.asarray([best.cap(i) for i in q_ids.tolist()])
            if len(ids) > k:
                caps = np.minimum(caps, -np.partition(about, len(ids) - k, axis=1)[:, len(ids) - k] + 1e-9)
            for i in np.flatnonzero(-about.max(1) <= caps + 1e-9):
                near = np.flatnonzero(-about[i] <= caps[i] + 1e-9)
                n = nx[near] * nq[i]
                dots = (x[near] * q[i]).cumsum(1)[:, -1] if x.shape[1] else np.zeros(len(near))
                best.add(int(q_ids[i]), -np.where(n > 0, dots / np.where(n > 0, n, 1.0), 0.0), ids[near])
        yield from best.batches(key, pa.float64())

    return meet(base, queries, key, vector, "<f8", visit, f"query_id bigint, {key} bigint, cost double")


#: Of words of eight bytes, every other byte.
EVEN = np.uint64(0x00FF00FF00FF00FF)


def byte_work(x: ArrayLike, q: ArrayLike) -> ArrayLike:
    """Summed differences of rows of bytes from one more; ``x`` comes place by place, places x rows, and the rows' number is a
    multiple of eight."""
    out = np.zeros(x.shape[1], np.int64)
    for at in range(0, len(x), 256):  # sums of up to 256 differences fit a lane of 16 bits
        some, one = x[at : at + 256], q[at : at + 256, None]
        gaps = (np.maximum(some, one) - np.minimum(some, one)).view("<u8")
        out[0::2] += (gaps & EVEN).sum(0).view("<u2")
        out[1::2] += ((gaps >> np.uint64(8)) & EVEN).sum(0).view("<u2")
    return out


def within_work(base: DataFrame, queries: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """query_id, key, d: all pairs of arrays of bytes (0 to 255) whose summed differences are at most ``most``."""
    import pyarrow as pa

    def visit(pairs):
        for ids, x, q_ids, q in pairs:
            rows = np.zeros((x.shape[1], -(-len(x) // 8) * 8), np.uint8)
            rows[:, : len(x)] = x.T
            found = []
            for i in range(len(q_ids)):
                d = byte_work(rows, q[i])[: len(x)]
                near = np.flatnonzero(d <= most)
                if len(near):
                    found.append((np.full(len(near), q_ids[i]), ids[near], d[near]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", key, "d"])

    return meet(base, queries, key, vector, "u1", visit, f"query_id bigint, {key} bigint, d bigint")


def counted_pairs(base: DataFrame, queries: DataFrame, key: str, words: str, first: int) -> DataFrame:
    """a, b, n: how many pairs of rows of different keys differ in ``a`` bits of the first ``first`` words and in ``b`` of
    the others. There are as many rows as pairs of such numbers at most."""
    import pyarrow as pa

    def visit(pairs):
        counts, wide, seen, turned = None, 0, None, None
        for ids, x, q_ids, q in pairs:
            if seen is None or len(seen) != len(ids) or (seen != ids).any():
                seen, turned = ids, np.ascontiguousarray(x.T)
            if counts is None:
                wide = 64 * (x.shape[1] - first) + 1
                counts = np.zeros((64 * first + 1) * wide, np.int64)
            places = []
            for i in range(len(q_ids)):
                place = differing_bits(turned[:first], q[i, :first]).astype(np.int64) * wide + differing_bits(turned[first:], q[i, first:])
                places.append(place[ids != q_ids[i]])
            counts += np.bincount(np.concatenate(places), minlength=len(counts))
        if counts is not None:
            at = np.flatnonzero(counts)
            for i in range(0, len(at), 100_000):
                some = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some // wide), pa.array(some % wide), pa.array(counts[some])], ["a", "b", "n"])

    cells = meet(base, queries, key, words, "<i8", visit, "a bigint, b bigint, n bigint")
    return cells.groupBy("a", "b").agg(F.sum("n").alias("n"))


def nearest_by_codes(base: DataFrame, queries: DataFrame, key: str, coded: str, books: ArrayLike, k: int, shortlist: int) -> DataFrame:
    """query_id, key, cost: the squared distance; of each task the ``k`` nearest rows per query (query_id, q), exactly.

    ``coded`` has a row's code words' numbers, the distances of its parts from these words, and its numbers. A part adds
    the query's distance to the word less the row's at least. The ``shortlist`` rows of least distance by words give a first
    cap; rows whose parts must add more than the k-th distance so far are passed over."""
    import pyarrow as pa

    parts, n_words, width = books.shape

    def exact(x, q):
        return ((x - q) ** 2).cumsum(1)[:, -1]

    def visit(pairs):
        best = Best(k)
        for ids, row, q_ids, q in pairs:
            codes = row[:, :parts].astype(np.intp).T.copy()
            residuals, x = row[:, parts : 2 * parts].T.copy(), row[:, 2 * parts :]
            for i, query in enumerate(q_ids.tolist()):
                words = ((books - q[i, : parts * width].reshape(parts, 1, width)) ** 2).sum(2)
                cap = best.cap(query)
                if cap == np.inf and len(ids) > k:
                    by_words = sum(words[p][codes[p]] for p in range(parts))
                    some = np.argpartition(by_words, min(shortlist, len(ids)) - 1)[:shortlist]
                    if len(some) >= k:
                        cap = np.partition(exact(x[some], q[i]), k - 1)[k - 1]
                roots = np.sqrt(words)
                least = sum(np.maximum(roots[p][codes[p]] - residuals[p], 0.0) ** 2 for p in range(parts))
                near = np.flatnonzero(least * (1 - 1e-9) <= cap)
                if len(near):
                    d = exact(x[near], q[i])
                    best.add(query, d[d <= cap], ids[near[d <= cap]])
        yield from best.batches(key, pa.float64())

    return meet(base, queries, key, coded, "<f8", visit, f"query_id bigint, {key} bigint, cost double", 2 * parts)
