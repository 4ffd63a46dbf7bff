"""Arrays of any number of axes as coordinate frames: columns i0, i1, .. for the axes, in order, and v.

Lanes (all elements along one axis) are gathered only where an operator needs their order: they are as long as the axis.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def axes(a: DataFrame) -> list[str]:
    return sorted((c for c in a.columns if re.fullmatch(r"i\d+", c)), key=lambda c: int(c[1:]))


def _size(shape: tuple[int, ...]) -> int:
    return reduce(lambda x, y: x * y, shape, 1)


def _coordinates(linear: Column, shape: tuple[int, ...], column_major: bool = False) -> list[Column]:
    out, step, order = {}, 1, range(len(shape)) if column_major else reversed(range(len(shape)))
    for axis in order:
        out[axis] = F.pmod(F.floor(linear / step), F.lit(shape[axis])).cast("bigint").alias(f"i{axis}")
        step *= shape[axis]
    return [out[axis] for axis in range(len(shape))]


def _linear(shape: tuple[int, ...], column_major: bool = False) -> Column:
    at, step = F.lit(0).cast("bigint"), 1
    for axis in range(len(shape)) if column_major else reversed(range(len(shape))):
        at, step = at + F.col(f"i{axis}") * step, step * shape[axis]
    return at


def from_function(spark: SparkSession, shape: tuple[int, ...], body) -> DataFrame:
    """Every element from its coordinates: ``body`` takes a column per axis. One range, no join."""
    cells = spark.range(_size(shape)).select(*_coordinates(F.col("id"), shape))
    return cells.withColumn("v", body(*[F.col(f"i{k}") for k in range(len(shape))]))


def full(spark: SparkSession, shape: tuple[int, ...], value: float) -> DataFrame:
    return from_function(spark, shape, lambda *_: F.lit(value))


def stepped_range(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """Half-open: start, start + step, .. below ``end`` (above it for a negative step)."""
    n = max(0, -int((start - end) // step))
    return spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).alias("v"))


def from_diagonal(d: DataFrame, n: int) -> DataFrame:
    """The square array with the vector (i0, v) on its diagonal."""
    return d.select("i0", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i1")).select("i0", "i1", F.when(F.col("i0") == F.col("i1"), F.col("v")).otherwise(0.0).alias("v"))


def from_flat(flat: DataFrame, shape: tuple[int, ...], column_major: bool = False) -> DataFrame:
    """A vector (i0, v) in a shape; a length that doesn't fit is an error."""
    n = flat.count()
    if n != _size(shape):
        raise ValueError(f"{n} elements don't fill the shape {shape}")
    return flat.select(*_coordinates(F.col("i0"), shape, column_major), "v")


def reshape(a: DataFrame, old: tuple[int, ...], new: tuple[int, ...], column_major: bool = False) -> DataFrame:
    if _size(old) != _size(new):
        raise ValueError(f"{old} and {new} hold different numbers of elements")
    return a.select(_linear(old, column_major).alias("_at"), "v").select(*_coordinates(F.col("_at"), new, column_major), "v")


def permute(a: DataFrame, order: tuple[int, ...]) -> DataFrame:
    """Axis ``order[k]`` becomes axis k."""
    return a.select(*[F.col(f"i{old}").alias(f"i{new}") for new, old in enumerate(order)], "v")


def swap_axes(a: DataFrame, x: int, y: int) -> DataFrame:
    order = list(range(len(axes(a))))
    order[x], order[y] = order[y], order[x]
    return permute(a, tuple(order))


def insert_axis(a: DataFrame, axis: int) -> DataFrame:
    """A new axis of length 1."""
    n = len(axes(a))
    return a.select(*[(F.lit(0).cast("bigint") if k == axis else F.col(f"i{k - (k > axis)}")).alias(f"i{k}") for k in range(n + 1)], "v")


def remove_axis(a: DataFrame, axis: int, at: int = 0) -> DataFrame:
    """The sub-array at one index; the later axes move up."""
    kept = [k for k in range(len(axes(a))) if k != axis]
    return a.where(F.col(f"i{axis}") == at).select(*[F.col(f"i{k}").alias(f"i{new}") for new, k in enumerate(kept)], "v")


def merge_axes(a: DataFrame, take: int, into: int, take_length: int) -> DataFrame:
    """``into`` runs over both axes, the taken one fastest; ``take`` keeps length 1."""
    merged = F.col(f"i{into}") * take_length + F.col(f"i{take}")
    return a.withColumns({f"i{into}": merged, f"i{take}": F.lit(0).cast("bigint")})


def broadcast(a: DataFrame, shape: tuple[int, ...], ones: tuple[int, ...] = ()) -> DataFrame:
    """Stretches an array to ``shape``: its axes are the last ones, and repeat along the axes before them and along those of
    ``ones`` (numbered as in ``shape``), where it has length 1."""
    missing = len(shape) - len(axes(a))
    a = a.select(*[F.col(f"i{k}").alias(f"i{k + missing}") for k in range(len(axes(a)))], "v")
    for axis in [*range(missing), *ones]:
        a = a.withColumn(f"i{axis}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shape[axis] - 1).cast("bigint"))))
    return a.select(*[f"i{k}" for k in range(len(shape))], "v")


def zip_broadcast(a: DataFrame, b: DataFrame, on: dict[str, str], result: Column) -> DataFrame:
    """Elementwise with an array that lacks some axes: ``on`` pairs a's axes with b's; the values are ``va`` and ``vb``. A
    shuffle join unless Spark knows ``b`` to be small; nothing is repeated."""
    other = b.select(*[F.col(theirs).alias(ours) for ours, theirs in on.items()], F.col("v").alias("vb"))
    return a.withColumnRenamed("v", "va").join(other, list(on)).select(*axes(a), result.alias("v"))


def assign(a: DataFrame, b: DataFrame, on: dict[str, str]) -> DataFrame:
    """a's elements from b, repeated along the axes that b lacks; where b has none they stay."""
    other = b.select(*[F.col(theirs).alias(ours) for ours, theirs in on.items()], F.col("v").alias("_new"))
    return a.join(other, list(on), "left").select(*axes(a), F.coalesce("_new", "v").alias("v"))


def fill(a: DataFrame, value: float) -> DataFrame:
    return a.withColumn("v", F.lit(value))


def all_of(a: DataFrame, test: Column) -> DataFrame:
    """One row: whether the test holds for every element; true for none."""
    return a.agg(F.coalesce(F.bool_and(test), F.lit(True)).alias("all"))


def any_of(a: DataFrame, test: Column) -> DataFrame:
    return a.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("any"))


def meshgrid(x: DataFrame, y: DataFrame, indexing: str = "xy") -> DataFrame:
    """i0, i1, x, y: the coordinate matrices of two vectors (i0, v), whose result has a row per pair by its nature."""
    a, b = x.select(F.col("i0").alias("ix"), F.col("v").alias("x")), y.select(F.col("i0").alias("iy"), F.col("v").alias("y"))
    rows, columns = ("iy", "ix") if indexing == "xy" else ("ix", "iy")
    return a.crossJoin(b).select(F.col(rows).alias("i0"), F.col(columns).alias("i1"), "x", "y")


def slice_axis(a: DataFrame, axis: int, start: int, stop: int, step: int = 1) -> DataFrame:
    """start <= i < stop, every ``step``-th from the start, or from the end for a negative step; renumbered from 0."""
    i = F.col(f"i{axis}")
    place = (i - start) if step > 0 else (F.lit(stop - 1) - i)
    kept = a.where((i >= start) & (i < stop) & (place % abs(step) == 0))
    return kept.withColumn(f"i{axis}", (place / abs(step)).cast("bigint"))


def slice_each_axis(a: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    return reduce(lambda f, x: slice_axis(f, x[0], *x[1]), enumerate(bounds), a)


def multi_slice(a: DataFrame, axis: int, bounds: list[tuple[int, int]]) -> list[DataFrame]:
    """Several slices at once, which must not overlap."""
    for (_, end), (begin, _) in zip(sorted(bounds), sorted(bounds)[1:]):
        if begin < end:
            raise ValueError("the slices overlap")
    return [slice_axis(a, axis, lo, hi) for lo, hi in bounds]


def element(a: DataFrame, *at: int) -> DataFrame:
    """One row: the element at a place, null outside the array."""
    here = reduce(lambda x, y: x & y, [F.col(f"i{k}") == i for k, i in enumerate(at)])
    return a.where(here).agg(F.max("v").alias("v"))


def ends(a: DataFrame) -> DataFrame:
    """One row: first and last, in row-major order; null without elements."""
    place = F.struct(*axes(a))
    return a.agg(F.min_by("v", place).alias("first"), F.max_by("v", place).alias("last"))


def product_axis(a: DataFrame, axis: int) -> DataFrame:
    return a.groupBy(*[c for c in axes(a) if c != f"i{axis}"]).agg(F.product("v").alias("v"))


def lanes(a: DataFrame, axis: int) -> DataFrame:
    """One row per lane: ``lane``, its elements in order."""
    by = [c for c in axes(a) if c != f"i{axis}"]
    return a.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(f"i{axis}", "v"))), lambda x: x["v"]).alias("lane"))


def map_axis(a: DataFrame, axis: int, body) -> DataFrame:
    """Each lane's value, ``body`` of its array."""
    one = lanes(a, axis)
    return one.select(*[c for c in one.columns if c != "lane"], body(F.col("lane")).alias("v"))


def fold_axis(a: DataFrame, axis: int, start: Column, step) -> DataFrame:
    """An ordered fold along an axis."""
    return map_axis(a, axis, lambda lane: F.aggregate(lane, start, step))


def fold_while(values: Column, start: Column, step, go_on) -> Column:
    """Folds an array until ``go_on`` of the value so far fails; later elements are passed over."""
    state = F.struct(start.alias("value"), F.lit(True).alias("on"))

    def one(s: Column, x: Column) -> Column:
        value = F.when(s["on"], step(s["value"], x)).otherwise(s["value"])
        return F.struct(value.alias("value"), (s["on"] & go_on(value)).alias("on"))

    return F.aggregate(values, state, one, lambda s: s["value"])


def _lane_rank(a: DataFrame, axis: int) -> Column:
    """An element's rank in its lane, from 0; ties by place, nulls last."""
    by = [c for c in axes(a) if c != f"i{axis}"]
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("v"), f"i{axis}")) - 1


def partition(a: DataFrame, axis: int, kth: int) -> DataFrame:
    """Marks each lane's elements: ``rank``, and ``side`` -1 below the element of rank ``kth``, 0 it, 1 above."""
    return a.withColumn("rank", _lane_rank(a, axis).cast("bigint")).withColumn("side", F.signum(F.col("rank") - kth).cast("int"))


def sorted_lanes(a: DataFrame, axis: int) -> DataFrame:
    return a.withColumn(f"i{axis}", _lane_rank(a, axis).cast("bigint"))


def push(a: DataFrame, axis: int, length: int, part: DataFrame) -> DataFrame:
    """Appends a sub-array (one axis less) at index ``length`` of an axis."""
    n = len(axes(a))
    new = part.select(*[(F.lit(length).cast("bigint") if k == axis else F.col(f"i{k - (k > axis)}")).alias(f"i{k}") for k in range(n)], "v")
    return a.unionByName(new)


def append(a: DataFrame, axis: int, length: int, other: DataFrame) -> DataFrame:
    """Appends an array of as many axes along one of them."""
    return a.unionByName(other.withColumn(f"i{axis}", F.col(f"i{axis}") + length))


def random(spark: SparkSession, shape: tuple[int, ...], seed: int, normal: bool = False) -> DataFrame:
    """Elements drawn by a hash of seed and place, so that lost partitions come back the same: uniform in [0, 1), or normal
    by the Box-Muller transform."""
    unit = lambda k, at: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), at), 11) + 0.5) / float(1 << 53)
    cells = spark.range(_size(shape)).select(*_coordinates(F.col("id"), shape), F.col("id").alias("_at"))
    u = unit(0, F.col("_at"))
    v = F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * unit(1, F.col("_at"))) if normal else u
    return cells.withColumn("v", v).drop("_at")


def sample_axis(a: DataFrame, axis: int, length: int, n: int, seed: int, replace: bool = False) -> DataFrame:
    """``n`` lanes drawn from an axis, renumbered; without replacement no index comes twice. The draw is ``n`` numbers."""
    import random as rnd

    draw = rnd.Random(seed)
    chosen = [draw.randrange(length) for _ in range(n)] if replace else draw.sample(range(length), n)
    table = F.broadcast(a.sparkSession.createDataFrame(list(enumerate(chosen)), "_new bigint, _old bigint"))
    return a.join(table, F.col(f"i{axis}") == F.col("_old")).withColumn(f"i{axis}", F.col("_new")).drop("_new", "_old")


def to_json(a: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """One row: the array as JSON text {"v": 1, "dim": [..], "data": [..]}. For arrays that fit one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*axes(a), "v"))), lambda x: x["v"])
    return a.agg(F.to_json(F.struct(F.lit(1).alias("v"), F.array(*[F.lit(n) for n in shape]).alias("dim"), ordered.alias("data"))).alias("json"))


def from_json(frame: DataFrame, column: str) -> DataFrame:
    """i0, v and dim of arrays written by :func:`to_json`; other versions are left out."""
    parsed = frame.select(F.from_json(column, "v int, dim array<bigint>, data array<double>").alias("a")).where("a.v = 1")
    return parsed.select("a.dim", F.posexplode("a.data").alias("i0", "v"))
