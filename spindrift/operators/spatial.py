"""3-D points and boxes: radius and nearest-neighbour joins over grid cells, box and ray tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .search import pair_with

AXES = ("x", "y", "z")


def _cell(frame: DataFrame, size: float, name: str = "cell") -> DataFrame:
    return frame.withColumn(name, F.struct(*[F.floor(F.col(a) / size).cast("bigint").alias(a) for a in AXES]))


def squared(a: str = "", b: str = "q_") -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in AXES[1:]), (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")))


def radius_join(points: DataFrame, queries: DataFrame, radius: float, key: str = "id", query: str = "query_id") -> DataFrame:
    """Pairs within ``radius`` (included): queries visit the 27 cells around them, so both sides meet by cell alone."""
    around = F.flatten(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.struct(i.alias("x"), j.alias("y"), k.alias("z")))))))
    q = _cell(queries.select(F.col(query), *[F.col(a).alias(f"q_{a}") for a in AXES], *[F.col(a) for a in AXES]), radius).drop(*AXES)
    q = q.withColumn("step", F.explode(around)).withColumn("cell", F.struct(*[(F.col(f"cell.{a}") + F.col(f"step.{a}")).alias(a) for a in AXES])).drop("step")
    pairs = _cell(points.select(key, *AXES), radius).join(q, "cell")
    return pairs.withColumn("d2", squared()).where(F.col("d2") <= radius * radius).select(query, key, "d2")


def knn_join(points: DataFrame, queries: DataFrame, k: int, start: float, key: str = "id", query: str = "query_id", rounds: int = 12) -> DataFrame:
    """Exact k nearest points per query: the radius doubles for the queries that have fewer than k points within it; those
    that are left after ``rounds`` of it, or have a coordinate that is no number, meet all points. Distances that are no
    number come last."""
    n = points.count()
    columns = [query, *[F.col(a).alias(f"q_{a}") for a in AXES]]
    rank = F.row_number().over(Window.partitionBy(query).orderBy("d2", key))
    finite = reduce(lambda x, y: x & y, [~F.isnan(F.col(a).cast("double")) & F.col(a).isNotNull() for a in AXES])
    want, left, found, radius = min(k, n), queries.where(finite), None, start
    odd = queries.where(~F.coalesce(finite, F.lit(False)))
    for i in range(rounds):
        near = radius_join(points, left, radius, key, query).withColumn("rank", rank).where(F.col("rank") <= k)
        full = near.groupBy(query).count().where(F.col("count") >= want).select(query)
        done = near.join(full, query, "left_semi")
        found = done if found is None else found.unionByName(done)
        left = left.join(full, query, "left_anti")
        if left.isEmpty():
            break
        radius *= 2
        if i % 4 == 3:
            left, found = cut(left), cut(found)
    else:
        odd = odd.unionByName(left)
    if not odd.isEmpty():
        every = pair_with(points.select(key, *AXES), odd.select(*columns)).select(query, key, squared().alias("d2"))
        found = found.unionByName(every.withColumn("rank", rank).where(F.col("rank") <= k).select(*found.columns))
    return found


def box_hits(a: str = "", b: str = "q_") -> Column:
    """Whether two boxes meet, faces included."""
    return F.expr(" and ".join(f"{a}min_{c} <= {b}max_{c} and {b}min_{c} <= {a}max_{c}" for c in AXES))


def box_join(boxes: DataFrame, queries: DataFrame, cell: float, key: str = "id", query: str = "query_id") -> DataFrame:
    """Pairs of boxes that meet. Boxes are entered in every cell that they touch; a pair counts in the cell that holds
    the lower corner of its overlap, so it comes out once."""

    def entered(frame: DataFrame, prefix: str) -> DataFrame:
        for c in AXES:
            frame = frame.withColumn(f"c_{c}", F.explode(F.sequence(F.floor(F.col(f"{prefix}min_{c}") / cell), F.floor(F.col(f"{prefix}max_{c}") / cell))))
        return frame

    corners = [f"{e}_{c}" for c in AXES for e in ("min", "max")]
    q = entered(queries.select(query, *[F.col(x).alias(f"q_{x}") for x in corners]), "q_")
    pairs = entered(boxes.select(key, *corners), "").join(q, [f"c_{c}" for c in AXES])
    home = F.lit(True)
    for c in AXES:
        home = home & (F.col(f"c_{c}") == F.floor(F.greatest(f"min_{c}", f"q_min_{c}") / cell))
    return pairs.where(box_hits() & home).select(query, key)


def box_distance2(point: tuple[float, float, float]) -> Column:
    """Squared distance of a point to the box min_*, max_*; 0 inside."""
    parts = []
    for p, c in zip(point, AXES):
        gap = F.greatest(F.col(f"min_{c}") - p, F.lit(0.0), F.lit(p) - F.col(f"max_{c}"))
        parts.append(gap * gap)
    return parts[0] + parts[1] + parts[2]


def ray_entry(origin: tuple[float, float, float], direction: tuple[float, float, float]) -> Column:
    """Parameter at which the ray enters the box (0 if it starts inside), null for a miss: the slab test."""
    low, high = [], []
    for o, d, c in zip(origin, direction, AXES):
        if d == 0:
            inside = (F.col(f"min_{c}") <= o) & (F.col(f"max_{c}") >= o)
            low.append(F.when(inside, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            high.append(F.when(inside, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
        else:
            a, b = (F.col(f"min_{c}") - o) / d, (F.col(f"max_{c}") - o) / d
            low.append(F.least(a, b))
            high.append(F.greatest(a, b))
    enter, leave = F.greatest(*low, F.lit(0.0)), F.least(*high)
    return F.when(enter <= leave, enter)


def volume() -> Column:
    sides = [F.greatest(F.lit(0.0), F.col(f"max_{c}") - F.col(f"min_{c}")) for c in AXES]
    return sides[0] * sides[1] * sides[2]
