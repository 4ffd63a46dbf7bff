"""Reductions of columns and along axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance(v: str, ddof: int = 0) -> Column:
    """Variance with ``ddof`` degrees of freedom taken off; null where too few values are left."""
    n = F.count(v)
    return F.when(n > ddof, F.var_pop(v) * n / (n - ddof))


def norms(v: str) -> list[Column]:
    x = F.col(v)
    return [
        F.count_if(x != 0).cast("double").alias("l0"),
        F.sum(F.abs(x)).alias("l1"),
        F.sqrt(F.sum(x * x)).alias("l2"),
        F.pow(F.sum(F.pow(F.abs(x), F.lit(3.0))), F.lit(1 / 3)).alias("l3"),
    ]


def summary(frame: DataFrame, by: list[str], v: str) -> DataFrame:
    """Mean, median, percentiles, population deviation and norms in one pass; one table of counts serves all percentiles."""
    whole = frame.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.percentile(v, [0.25, 0.5, 0.9]).alias("_p"),
        F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"), *norms(v),
    )
    for i, name in enumerate(("p25", "median", "p90")):
        whole = whole.withColumn(name, F.get("_p", i))
    return whole.drop("_p")


def arg_extremes(frame: DataFrame, by: list[str], index: str, v: str) -> DataFrame:
    """First index of the least and of the greatest value; NaN doesn't count."""
    good = frame.where(~F.isnan(F.col(v).cast("double")))
    return good.groupBy(*by).agg(F.min(F.struct(v, index))[index].alias("argmin"), F.min(F.struct(-F.col(v), F.col(index)))[index].alias("argmax"), F.min(F.struct(-F.abs(F.col(v)), F.col(index)))[index].alias("argmax_abs"))


def axis_reduce(a: DataFrame, keep: list[str], ddof: int = 0) -> DataFrame:
    """Sum, mean, variance, deviation and product of logs along all axes but ``keep``."""
    return a.groupBy(*keep).agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), variance("v", ddof).alias("variance"), F.sqrt(variance("v", ddof)).alias("deviation"), F.min("v").alias("low"), F.max("v").alias("high"))


def spearman(frame: DataFrame, a: str, b: str, buckets: int = 32) -> DataFrame:
    """Rank correlation with mean ranks for ties, without a global sort in one task.

    Ranks come from counts per distinct value: a value's rank is how many values are smaller plus half of its own. The
    counts of each of ``buckets`` quantile ranges are summed first, and a window runs inside each range."""

    def ranked(column: str, out: str) -> DataFrame:
        counts = frame.groupBy(column).agg(F.count("*").alias("n"))
        marks = frame.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("m")).first()["m"] or []
        table = F.array(*[F.lit(float(x)) for x in sorted(set(marks))]) if marks else F.array().cast("array<double>")
        counts = counts.withColumn("range", F.size(F.filter(table, lambda x: x < F.col(column))))
        sums = counts.groupBy("range").agg(F.sum("n").alias("in_range"))
        sums = sums.withColumn("below", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most `buckets` rows
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumn("inside", inside).join(F.broadcast(sums), "range").select(F.col(column), (F.col("below") + F.col("inside") + (F.col("n") + 1) / 2).alias(out))

    ranks = frame.join(ranked(a, "rank_a"), a).join(ranked(b, "rank_b"), b)
    return ranks.agg(F.corr("rank_a", "rank_b").alias("rho"))


def spearman_of_counts(cells: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """Rank correlation with mean ranks for ties of pairs that are given by how often each comes; for columns of few values,
    as the window over a column's values is one task."""
    cells = cells.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).cast("double").alias("n"))

    def ranked(column: str, out: str) -> DataFrame:
        counts = cells.groupBy(column).agg(F.sum("n").alias("m"))
        below = F.coalesce(F.sum("m").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return counts.select(column, (below + (F.col("m") + 1) / 2).alias(out))

    middle = cells.agg(((F.sum("n") + 1) / 2).alias("middle"))
    ranks = cells.join(ranked("a", "ra"), "a").join(ranked("b", "rb"), "b").crossJoin(F.broadcast(middle))  # one row
    x, y = F.col("ra") - F.col("middle"), F.col("rb") - F.col("middle")
    sums = ranks.agg(F.sum(F.col("n") * x * y).alias("xy"), F.sum(F.col("n") * x * x).alias("xx"), F.sum(F.col("n") * y * y).alias("yy"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    return sums.select(F.when(spread > 0, F.col("xy") / spread).alias("rho"))


def adjusted_rand(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings, corrected for chance, from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    cells = frame.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("by_a"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("by_b"))
    one = both.crossJoin(rows).crossJoin(columns)  # single rows
    expected, top = F.col("by_a") * F.col("by_b") / pairs(F.col("all")), (F.col("by_a") + F.col("by_b")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def otsu(frame: DataFrame, v: str) -> DataFrame:
    """The threshold of an 8-bit column that maximises the variance between both sides; the lowest on ties."""
    hist = frame.groupBy(F.col(v).alias("t")).agg(F.count("*").cast("double").alias("n"))  # at most 256 rows from here on
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = hist.select("t", F.sum("n").over(w).alias("w0"), F.sum(F.col("t") * F.col("n")).over(w).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("t") * F.col("n")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.col("w0") * w1 * gap * gap).otherwise(0.0)
    return run.select("t", between.alias("between")).groupBy().agg(F.min(F.struct(-F.col("between"), F.col("t")))["t"].alias("threshold"))
