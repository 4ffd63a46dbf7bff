"""Similarity search: exact top-k, radius and nearest-neighbour joins, filter cascades, hashing and quantised codes.

Queries meet the base by :func:`pair_with`: a query set whose size is checked to be small is broadcast, a larger one is
dealt to blocks that each meet every base row once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

from spindrift.functions.vectors import hamming, squared_l2

#: Queries that may be broadcast, in rows and in bytes; larger sets go block by block.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


def _bytes(field: StructField) -> Column:
    """About the size of a column's value."""
    kind, at_least = field.dataType, lambda c: F.coalesce(F.greatest(c, F.lit(0)), F.lit(0)).cast("bigint")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
        return 8 * at_least(F.aggregate(field.name, F.lit(0), lambda n, x: n + F.coalesce(F.size(x), F.lit(0))))
    if isinstance(kind, ArrayType):
        return 8 * at_least(F.size(field.name))
    return at_least(F.octet_length(field.name)) if isinstance(kind, (StringType, BinaryType)) else F.lit(8).cast("bigint")


def pair_with(base: DataFrame, queries: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every base row with every query row. The count and the size of the queries decide: up to ``block_rows`` of them, of
    up to BROADCAST_BYTES, are broadcast; more are dealt to blocks of as many, each of which is broadcast to one pass over
    the base, so that a task holds a block of queries and its own share of the base at most."""
    size = sum((_bytes(f) for f in queries.schema.fields), F.lit(0).cast("bigint"))
    facts = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-facts["n"] // block_rows), -(-facts["bytes"] // BROADCAST_BYTES))
    if blocks <= 1:
        return base.crossJoin(F.broadcast(queries))
    number = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, [base.crossJoin(F.broadcast(queries.where(number == i))) for i in range(blocks)])


def close_pairs(frame: DataFrame, by: list[str], key: str, word: str, radius: int, bands: int = 6) -> DataFrame:
    """a, b (a < b): rows of one group ``by`` whose words differ in at most ``radius`` bits.

    By the pigeonhole principle one of ``bands`` bands of the words differs in radius / bands bits at most. Where
    that is one bit, each band is probed with each of its bits flipped, so that bands can be long and few unlike rows share
    one: with 6 bands and a radius of 10 one pair in 23 is compared. ``radius`` must be less than twice ``bands``."""
    if radius >= 2 * bands:
        raise ValueError("radius must be less than twice the number of bands")
    edges = [64 * i // bands for i in range(bands + 1)]
    band = lambda a, b: F.shiftrightunsigned(word, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    own = [F.struct(F.lit(i).alias("i"), band(a, b).alias("v")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    near = [F.struct(F.lit(i).alias("i"), band(a, b).bitwiseXOR(F.lit(flip)).alias("v")) for i, (a, b) in enumerate(zip(edges, edges[1:])) for flip in (0, *(1 << j for j in range(b - a)))]
    left = frame.select(*by, F.col(key).alias("a"), F.col(word).alias("wa"), F.explode(F.array(*own)).alias("band"))
    right = frame.select(*by, F.col(key).alias("b"), F.col(word).alias("wb"), F.explode(F.array(*near)).alias("band"))
    met = left.join(right, [*by, "band"]).where((F.col("a") < F.col("b")) & (hamming(F.col("wa"), F.col("wb")) <= radius))
    return met.select("a", "b").distinct()


def top_k(frame: DataFrame, distance: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of least distance, ties by key; k beyond the table gives all of it."""
    return frame.orderBy(distance, key).limit(k)


def top_k_per(frame: DataFrame, query: str, distance: str, key: str, k: int) -> DataFrame:
    """Per query; the window's limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(distance, key))
    return frame.withColumn("rank", rank).where(F.col("rank") <= k)


def hamming_top_k(base: DataFrame, query: int, k: int, key: str = "vec_id", word: str = "fp") -> DataFrame:
    return top_k(base.select(key, hamming(F.col(word), F.lit(query)).alias("d")), "d", key, k)


def band(distance: Column, threshold: Column | int) -> Column:
    """Quarters of the threshold: Foveal, Near, Good, Weak, then Reject."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    quarter = lambda i: F.floor(t * i / 4)
    return F.when(distance <= quarter(1), "Foveal").when(distance <= quarter(2), "Near").when(distance <= quarter(3), "Good").when(distance <= t, "Weak").otherwise("Reject")


def calibrate(distances: DataFrame, d: str = "d", sigmas: float = 3.0) -> DataFrame:
    """mean, deviation and threshold = mean + ``sigmas`` deviations, cut to an integer."""
    return distances.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("deviation")).withColumn("threshold", F.floor(F.col("mean") + sigmas * F.col("deviation")).cast("bigint"))


def cascade(base: DataFrame, query: Column, threshold: int, strokes: list[tuple[int, int]], statistical: bool = False, key: str = "vec_id", words: str = "words") -> DataFrame:
    """Hamming search on arrays of words in strokes (first word, words). Exactly, a row goes once its partial distance
    exceeds the threshold, a true lower bound. Statistically, once the partial distance scaled to the whole print exceeds
    the threshold by three of that estimate's standard deviations, which can lose a few rows."""
    whole = sum(n for _, n in strokes)
    frame, so_far, seen = base, F.lit(0).cast("bigint"), 0
    for first, n in strokes:
        part = F.aggregate(F.zip_with(F.slice(F.col(words), first + 1, n), F.slice(query, first + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
        seen += n
        frame = frame.withColumn("_d", so_far + part)
        if statistical and seen < whole:
            sigma = (64 * seen / 4) ** 0.5 * whole / seen
            frame = frame.where(F.col("_d") * whole / seen <= threshold + 3 * sigma)
        else:
            frame = frame.where(F.col("_d") <= threshold)
        so_far = F.col("_d")
    return frame.select(key, F.col("_d").alias("d"))


def kernel_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """conflict, energies, agreement of two words, the hot/mid/cold grade by conflict and the sigma level."""
    x, y = F.col(a), F.col(b)
    bits = lambda c: F.bit_count(c).cast("bigint")
    out = pairs.withColumn("conflict", bits(x.bitwiseXOR(y))).withColumn("energy_a", bits(x)).withColumn("energy_b", bits(y)).withColumn("agreement", bits(x.bitwiseAND(y)))
    z = (32 - F.col("conflict")) / 4.0
    return out.withColumn("grade", F.when(F.col("conflict") < 16, 3).when(F.col("conflict") < 24, 2).when(F.col("conflict") < 32, 1).otherwise(0)).withColumn("z", z)


def majority(prints: DataFrame, by: list[str], word: str = "fp", bits: int = 64) -> DataFrame:
    """Bitwise majority vote per group: a bit is set where more than half of the prints have it (ties don't)."""
    one = F.lit(1).cast("bigint")
    counts = prints.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(word, i).bitwiseAND(one)).alias(f"b{i}") for i in range(bits)])
    votes = [F.when(F.col(f"b{i}") > F.floor(F.col("n") / 2), F.call_function("shiftleft", one, F.lit(i))).otherwise(F.lit(0).cast("bigint")) for i in range(bits)]
    word_of = votes[0]
    for v in votes[1:]:
        word_of = word_of.bitwiseOR(v)
    return counts.select(*by, "n", word_of.alias("majority"))


@dataclass(frozen=True)
class Mask:
    """Bits that must be set, and fields (mask, value) that must match, and bits that must be clear."""

    require: int = 0
    value_mask: int = 0
    value: int = 0
    forbid: int = 0

    def test(self, state: Column) -> Column:
        wanted = self.require | self.value_mask
        return (state.bitwiseAND(F.lit(wanted)) == F.lit(self.require | self.value)) & (state.bitwiseAND(F.lit(self.forbid)) == 0)


def count_masks(states: DataFrame, state: str, masks: dict[str, Mask]) -> DataFrame:
    """All masks in one pass."""
    return states.agg(*[F.count_if(m.test(F.col(state))).alias(name) for name, m in masks.items()])


def hyperplanes(bits: int, dims: int, seed: int = 42) -> ArrayLike:
    return np.random.default_rng(seed).standard_normal((bits, dims))


def simhash(vectors: DataFrame, key: str, vector: str, bits: int = 1024, seed: int = 42) -> DataFrame:
    """Sign random projection to ``bits`` bits in words of 64: one matrix product per Arrow batch."""
    import pyarrow as pa

    dims_schema = "bigint"

    def run(batches):
        plane = None
        for batch in batches:
            rows = batch.column(1).to_pylist()
            if not rows:
                continue
            x = np.asarray(rows, np.float64)
            if plane is None or plane.shape[1] != x.shape[1]:
                plane = hyperplanes(bits, x.shape[1], seed)
            packed = np.packbits((x @ plane.T) > 0, axis=1, bitorder="little").view("<i8")
            flat = pa.array(packed.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, packed.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "words"])

    frame = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v"))
    return frame.mapInArrow(run, f"{key} {dims_schema}, words array<bigint>")


def lsh_candidates(prints: DataFrame, queries: DataFrame, band_words: int = 1, key: str = "vec_id", words: str = "words", band_bits: int = 16) -> DataFrame:
    """Distinct pairs that agree on a band of ``band_bits`` bits: an equi-join on (band number, bits)."""
    per = 64 // band_bits

    def bands(frame: DataFrame, name: str) -> DataFrame:
        each = F.flatten(F.transform(F.col(words), lambda w: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.call_function("shiftrightunsigned", w, i * band_bits).bitwiseAND(F.lit((1 << band_bits) - 1)))))
        return frame.select(F.col(key).alias(name), F.posexplode(each).alias("band", "bits"))

    return bands(queries, "query_id").join(bands(prints, key), ["band", "bits"]).select("query_id", key).distinct()


def train_codebooks(vectors: DataFrame, vector: str, parts: int = 6, k: int = 256, rounds: int = 8, sample_rows: int = 4096, seed: int = 7) -> ArrayLike:
    """Product-quantisation codebooks from a bounded sample (``sample_rows`` rows, lowest hashes): farthest-first seeds,
    then Lloyd rounds. Shape (parts, k, width); the tail that doesn't fill a part is not coded."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(vector, F.lit(seed)), "v").limit(sample_rows).collect()
    x = np.asarray([r["v"] for r in rows])
    width, k = x.shape[1] // parts, min(k, len(x))
    books = np.empty((parts, k, width))
    for p in range(parts):
        sub = x[:, p * width : (p + 1) * width]
        chosen, gap = [0], ((sub - sub[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((sub - sub[chosen[-1]]) ** 2).sum(1))
        c = sub[chosen].copy()
        for _ in range(rounds):
            near = ((sub[:, None] - c[None]) ** 2).sum(2).argmin(1)
            for j in np.unique(near):
                c[j] = sub[near == j].mean(0)
        books[p] = c
    return books


def pq_encode(vectors: DataFrame, key: str, vector: str, books: ArrayLike) -> DataFrame:
    """Nearest centroid per part, the first on ties: ``codes array<int>``."""
    import pyarrow as pa

    def run(batches):
        parts, _, width = books.shape
        for batch in batches:
            rows = batch.column(1).to_pylist()
            if not rows:
                continue
            x = np.asarray(rows)
            near = lambda y, p: ((y[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2).argmin(1)
            codes = np.concatenate([np.stack([near(x[i : i + 512], p) for p in range(parts)], 1) for i in range(0, len(x), 512)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int32()))], [key, "codes"])

    frame = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v"))
    return frame.mapInArrow(run, f"{key} bigint, codes array<int>")


def pq_decode(codes: DataFrame, key: str, column: str, books: ArrayLike) -> DataFrame:
    """The code words of every row, one after the other: ``v array<double>``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            found = [books[np.arange(len(r)), r].reshape(-1) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [key, "v"])

    return codes.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"{key} bigint, v array<double>")


def adc_top_k(codes: DataFrame, query: list[float], books: ArrayLike, k: int, key: str = "vec_id") -> DataFrame:
    """Asymmetric distances: one table lookup per part, summed in the JVM."""
    parts, _, width = books.shape
    q = np.asarray(query)
    tables = [((books[p] - q[p * width : (p + 1) * width]) ** 2).sum(1).tolist() for p in range(parts)]
    d = sum((F.get(F.array(*[F.lit(x) for x in tables[p]]), F.get("codes", p)) for p in range(1, parts)), F.get(F.array(*[F.lit(x) for x in tables[0]]), F.get("codes", 0)))
    return top_k(codes.select(key, d.alias("d")), "d", key, k)


def adc_tables(queries: DataFrame, key: str, vector: str, books: ArrayLike) -> DataFrame:
    """Each query's distances to every code word, per part: ``query_id`` and ``tables array<array<double>>``."""
    import pyarrow as pa

    def run(batches):
        parts, _, width = books.shape
        for batch in batches:
            tables = [[((books[p] - np.asarray(v)[p * width : (p + 1) * width]) ** 2).sum(1) for p in range(parts)] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.list_(pa.float64())))], ["query_id", "tables"])

    frame = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v"))
    return frame.mapInArrow(run, "query_id bigint, tables array<array<double>>")


def adc_knn(vectors: DataFrame, queries: DataFrame, vector: str, books: ArrayLike, k: int, shortlist: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest per query: the ``shortlist`` rows of least asymmetric distance, ranked again by exact squared distance."""
    codes = pq_encode(vectors, key, vector, books)
    parts = books.shape[0]
    pairs = pair_with(codes, adc_tables(queries, key, vector, books), block_rows=1_000)  # a query's tables have 12 KB
    d = reduce(lambda a, b: a + b, [F.get(F.get("tables", p), F.get("codes", p)) for p in range(parts)])
    short = top_k_per(pairs.select("query_id", key, d.alias("d")), "query_id", "d", key, shortlist).select("query_id", key)
    as_double = F.col(vector).cast("array<double>")
    asked = queries.select(F.col(key).alias("query_id"), as_double.alias("_q"))
    asked = F.broadcast(asked) if queries.count() <= BROADCAST_ROWS else asked
    short = short.join(vectors.select(key, as_double.alias("_v")), key).join(asked, "query_id")
    return top_k_per(short.select("query_id", key, squared_l2(F.col("_v"), F.col("_q")).alias("d")), "query_id", "d", key, k)


def pivot_radius(base: DataFrame, query: int, radius: int, pivots: list[int], key: str = "vec_id", word: str = "fp") -> DataFrame:
    """Exact radius search with triangle pruning: rows are tagged with their nearest pivot and the distance to it; a
    pivot's rows are compared only if |d(query, pivot) - d(row, pivot)| can be within the radius."""
    table = F.array(*[F.lit(p) for p in pivots])
    ds = F.transform(table, lambda p: hamming(F.col(word), p))
    near = F.array_min(F.zip_with(ds, F.sequence(F.lit(0), F.lit(len(pivots) - 1)), lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
    tagged = base.withColumn("_near", near)
    dq = F.get(F.array(*[F.lit(bin((p ^ query) & (2**64 - 1)).count("1")) for p in pivots]), F.col("_near.i"))
    kept = tagged.where(F.abs(dq - F.col("_near.d")) <= radius)
    return kept.select(key, hamming(F.col(word), F.lit(query)).alias("d")).where(F.col("d") <= radius)


def bounded_code_knn(vectors: DataFrame, queries: DataFrame, vector: str, books: ArrayLike, k: int, shortlist: int, key: str = "vec_id") -> DataFrame:
    """Exactly the ``k`` nearest per query by squared distance, by way of quantised codes; ties by key.

    A part of a row lies as far from its code word as its stored residual says, so the query's distance to the word less the
    residual is the least that the part can add. Rows whose parts must add more than a query's k-th distance leave before
    their numbers are compared; queries meet the rows block by block."""
    import pyarrow as pa

    from spindrift.operators import blockwise

    parts, _, width = books.shape

    def code(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            if not rows:
                continue
            x, out = np.asarray(rows), []
            for i in range(0, len(x), 512):
                y = x[i : i + 512, : parts * width].reshape(-1, parts, width)
                gaps = np.stack([((y[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)], 1)
                codes = gaps.argmin(2)
                out.append(np.concatenate([codes, np.sqrt(np.take_along_axis(gaps, codes[:, :, None], 2)[:, :, 0]), x[i : i + 512]], 1))
            flat = np.concatenate(out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "coded"])

    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    coded = v.mapInArrow(code, f"{key} bigint, coded array<double>")
    found = blockwise.nearest_by_codes(coded, q, key, "coded", books, k, shortlist)
    return top_k_per(found.withColumnRenamed("cost", "d"), "query_id", "d", key, k)
