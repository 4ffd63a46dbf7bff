"""Searches that a bound on rows shortens: by their norms, and by their numbers of set bits.

The base is kept in parts, one folder each, and a search takes the parts in the order of the best that they can hold. After
each part a query knows its k-th best row; once that is better than all that the next part can hold, the query is closed.
Parts that no open query needs aren't read. Answers are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import dot, doubles, hamming_words, total
from spindrift.operators.lineage import kept
from spindrift.operators.search import pair_with, top_k_per


def approx_norm(v: Column) -> Column:
    """The Euclidean norm of a vector whose numbers are rounded to 127ths of the largest one; 0 for an empty vector."""

    def of_top(d: Column, top: Column) -> Column:
        squares = total(F.transform(d, lambda x: F.pow(F.round(x / (top / 127)), F.lit(2.0))))
        return F.when(top > 0, F.sqrt(squares) * (top / 127)).otherwise(0.0)

    def body(d: Column) -> Column:
        top = F.coalesce(F.array_max(F.transform(d, F.abs)), F.lit(0.0))
        return F.transform(F.array(top), lambda t: of_top(d, t))[0]

    return F.when(v.isNotNull(), F.transform(F.array(doubles(v)), body)[0])


def top_by_norm(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, norm of the ``k`` rows of the largest approximate norms, ties by key."""
    return rows.where(F.col(vector).isNotNull()).select(key, approx_norm(F.col(vector)).alias("norm")).orderBy(F.desc("norm"), key).limit(k)


def order_statistic(frame: DataFrame, column: str, rank: int, buckets: int = 1024) -> float | None:
    """The value of a 0-based ``rank`` in the order of a column of doubles, nulls and NaN aside: its range is cut into
    ``buckets``, the counts tell which bucket has the rank, and that one is cut again until it holds one value."""
    x = frame.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("x"))
    facts = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    if not 0 <= rank < facts["n"]:
        return None
    low, high, below = facts["low"], facts["high"], 0
    while low < high:
        place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit((high - low) / buckets)), F.lit(buckets - 1)).alias("b")
        counts = x.where(F.col("x").between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
        for r in counts:  # ``buckets`` rows at most
            if below + r["n"] > rank:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    return low


def pruned_rows(rows: DataFrame, key: str, vector: str, share: float) -> DataFrame:
    """The rows whose approximate norm isn't below that of rank floor(n * share), with their ``norm``."""
    normed = kept(rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"), approx_norm(F.col(vector)).alias("norm")))
    n = normed.count()
    least = order_statistic(normed, "norm", min(int(n * share), n - 1)) if n else None
    return normed.where(F.col("norm") >= F.lit(least))


def pruned_product(rows: DataFrame, key: str, vector: str, matrix: DataFrame, share: float) -> DataFrame:
    """key, j, value: products of the rows that are left after pruning with the columns of a matrix, given as (j, column:
    array)."""
    pairs = pair_with(pruned_rows(rows, key, vector, share).select(key, "v"), matrix.select("j", "column"))
    return pairs.select(key, "j", dot(F.col("v"), F.col("column")).alias("value"))


@dataclass(frozen=True)
class Part:
    """``lower``: the least cost that a row of the part can have, from a query's columns. ``n``: how many of its rows a
    query meets. ``meet``: open queries (with ``kth``) -> query_id, key, cost."""

    lower: Column
    n: Column
    meet: Callable[[DataFrame], DataFrame]


def bounded(queries: DataFrame, parts: list[Part], key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` rows of least cost per query (query_id, key, cost, rank; ties by key), and the rows that each query met
    (query_id, parts, rows_read). ``parts`` come in an order in which no query's ``lower`` falls."""
    open_ = kept(queries.withColumn("kth", F.lit(None).cast("double")))
    best = reads = None
    for part in parts:
        asked = open_.where(F.col("kth").isNull() | (part.lower <= F.col("kth")))
        if asked.isEmpty():
            break
        asked = kept(asked)
        read = asked.select("query_id", part.n.cast("bigint").alias("n"))
        reads = read if reads is None else reads.unionByName(read)
        found = part.meet(asked).where(F.col("kth").isNull() | (F.col("cost") <= F.col("kth"))).select("query_id", key, "cost")
        found = found if best is None else found.unionByName(best.select("query_id", key, "cost"))
        best = kept(top_k_per(found, "query_id", "cost", key, k))
        kth = best.where(F.col("rank") == k).select("query_id", F.col("cost").cast("double").alias("kth"))
        open_ = asked.drop("kth").join(kth, "query_id", "left")
    if best is None:
        spark = queries.sparkSession
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, cost double, rank int"), spark.createDataFrame([], "query_id bigint, parts bigint, rows_read bigint")
    return best, reads.groupBy("query_id").agg(F.count("*").alias("parts"), F.sum("n").alias("rows_read"))


#: Bands of norms, each with squares from a half of the band's before; the last has all that is left.
BANDS = 32


@dataclass(frozen=True)
class NormIndex:
    """``rows``: key, v, norm2, band, in a folder per band; ``bands``: (number, largest square, rows), largest first."""

    rows: DataFrame
    bands: list[tuple[int, float, int]]
    key: str


def norm_index(rows: DataFrame, key: str, vector: str) -> NormIndex:
    """Deals rows out by the squares of their norms. Rows with a null vector or a square that isn't finite stay out."""
    v = rows.where(F.col(vector).isNotNull()).select(key, doubles(F.col(vector)).alias("v"))
    v = v.withColumn("norm2", dot(F.col("v"), F.col("v"))).where(F.col("norm2") < float("inf"))
    top = v.agg(F.max("norm2")).first()[0] or 0.0
    halvings = sum((F.when(F.col("norm2") * F.lit(2.0**i) <= F.lit(top), 1).otherwise(0) for i in range(1, BANDS)), F.lit(0))
    stored = kept(v.withColumn("band", halvings), "band")
    facts = stored.groupBy("band").agg(F.max("norm2").alias("high"), F.count("*").alias("n")).orderBy("band").collect()  # BANDS rows at most
    return NormIndex(stored, [(r["band"], r["high"], r["n"]) for r in facts], key)


def max_product(index: NormIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` rows of the largest inner products per query (query_id, q): query_id, key, score, rank; and what was read.

    No row of a band has a product above the query's norm times the band's largest; a query is closed where its k-th
    product is above that."""
    asked = queries.select("query_id", doubles(F.col("q")).alias("q"))
    asked = asked.withColumn("reach", F.sqrt(dot(F.col("q"), F.col("q"))))

    def part(band: int, high: float, n: int) -> Part:
        def meet(open_: DataFrame) -> DataFrame:
            rows = index.rows.where(F.col("band") == band).select(index.key, "v")
            return pair_with(rows, open_).select("query_id", index.key, "kth", (-dot(F.col("v"), F.col("q"))).alias("cost"))

        return Part(-F.col("reach") * F.lit(high**0.5 * (1 + 1e-9)), F.lit(n), meet)

    best, reads = bounded(asked, [part(*b) for b in index.bands], index.key, k)
    return best.select("query_id", index.key, (-F.col("cost")).alias("score"), "rank"), reads


def ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, x: a + F.bit_count(x))


@dataclass(frozen=True)
class OnesIndex:
    """``rows``: key, words, ones, in a folder for each number of set bits; ``counts``: their rows."""

    rows: DataFrame
    counts: dict[int, int]
    key: str


def ones_index(rows: DataFrame, key: str, words: str) -> OnesIndex:
    """Deals prints (arrays of 64-bit words) out by their set bits."""
    stored = kept(rows.where(F.col(words).isNotNull()).select(key, F.col(words).alias("words"), ones(F.col(words)).alias("ones")), "ones")
    counts = stored.groupBy("ones").agg(F.count("*").alias("n")).collect()  # one row for each number of bits at most
    return OnesIndex(stored, {r["ones"]: r["n"] for r in counts}, key)


def hamming_candidates(index: OnesIndex, queries: DataFrame, k: int, step: int = 2) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest prints per query (query_id, q: words): query_id, key, d, rank; and what was read.

    Prints whose numbers of set bits are ``m`` apart differ in ``m`` bits or more: rings of growing ``m`` are read until a
    query's k-th distance is below the next ring's least."""
    asked = queries.select("query_id", "q", ones(F.col("q")).alias("q_ones"))
    sizes = F.array(*[F.struct(F.lit(o).alias("ones"), F.lit(n).alias("n")) for o, n in sorted(index.counts.items())])
    present = [r["q_ones"] for r in asked.select("q_ones").distinct().collect()]  # numbers of bits, not rows

    def ring(low: int, high: int) -> Part:
        inside = lambda o: F.abs(o - F.col("q_ones")).between(low, high - 1)

        def meet(open_: DataFrame) -> DataFrame:
            rows = index.rows.where(F.col("ones").isin([o for o in index.counts if any(low <= abs(o - p) < high for p in present)]))
            pairs = pair_with(rows, open_).where(inside(F.col("ones")))
            return pairs.select("query_id", index.key, "kth", hamming_words(F.col("words"), F.col("q")).cast("double").alias("cost"))

        n = F.aggregate(F.filter(sizes, lambda s: inside(s["ones"])), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
        return Part(F.lit(float(low)), n, meet)

    edges, widest = [0], max((abs(o - p) for o in index.counts for p in present), default=-1)
    while edges[-1] <= widest:
        edges.append(edges[-1] + step * len(edges))
    best, reads = bounded(asked, [ring(a, b) for a, b in zip(edges, edges[1:])], index.key, k)
    return best.select("query_id", index.key, F.col("cost").cast("bigint").alias("d"), "rank"), reads
