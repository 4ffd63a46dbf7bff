"""Queries on arrays of any number of axes, and elementwise functions by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import maths
from spindrift.functions import vectors as V
from spindrift.operators import shapes

from .numeric import _LONG, _long, _r
from .registry import query, table

#: The embeddings as an array of three axes: row, 8, 8.
_CUBE = "(select vec_id as i0, (generate_subscripts(embedding, 1) - 1) // 8 as i1, (generate_subscripts(embedding, 1) - 1) % 8 as i2, unnest(embedding)::double as v from embeddings)"


def _cube(spark, d):
    a = _long(spark, d)
    return a.select("i0", F.floor(F.col("i1") / 8).cast("bigint").alias("i1"), (F.col("i1") % 8).cast("bigint").alias("i2"), "v")


@query(f"select a.i0, a.i1, a.i2, round(a.v - b.v, 6) + 0.0 as v from {_CUBE} a join (select i1, avg(v) as v from {_CUBE} group by 1) b on a.i1 = b.i1")
def zip_broadcast(spark, d):
    """Less the mean along two axes, which is never repeated."""
    a = _cube(spark, d)
    mean = a.groupBy(F.col("i1").alias("i0")).agg(F.avg("v").alias("v"))
    return shapes.zip_broadcast(a, mean, {"i1": "i0"}, _r(F.col("va") - F.col("vb")))


@query("select x.i as i0, y.i as i1, z.i as i2, z.i * 10.0::double as v from range(3) x(i), range(4) y(i), range(5) z(i) union all select 10 + x.i, y.i, z.i, y.i + 0.5::double from range(2) x(i), range(4) y(i), range(3) z(i)")
def broadcast_array(spark, d):
    """A vector along two new axes, and a column along its axis of length 1."""
    one = shapes.broadcast(spark.range(5).select(F.col("id").alias("i0"), (F.col("id") * 10.0).alias("v")), (3, 4, 5))
    column = spark.range(4).select(F.col("id").alias("i0"), F.lit(0).cast("bigint").alias("i1"), (F.col("id") + 0.5).alias("v"))
    two = shapes.broadcast(column, (2, 4, 3), ones=(2,))
    return one.unionByName(two.withColumn("i0", F.col("i0") + 10))


@query(f"select i0, i1, case when i1 = 7 then 0.25::double when i1 % 2 = 0 then i1 / 2.0 else v end as v from {_LONG}")
def assign_fill(spark, d):
    """Even columns from a vector of their own, one column filled, the others as they were."""
    a = _long(spark, d).select("i0", F.col("i1").cast("bigint").alias("i1"), "v")
    even = spark.range(0, 64, 2).select(F.col("id").alias("i0"), (F.col("id") / 2).alias("v"))
    out = shapes.assign(a, even, {"i1": "i0"})
    return out.where("i1 <> 7").unionByName(shapes.fill(out.where("i1 = 7"), 0.25))


@query(f"select (select bool_and(v < 100) from {_LONG}) as all_small, (select bool_and(v < 0.1) from {_LONG}) as all_tiny, (select bool_or(v > 0.3) from {_LONG}) as any_large, (select bool_or(v > 100) from {_LONG}) as any_huge, true as all_of_none, false as any_of_none")
def all_any(spark, d):
    a, v = _long(spark, d), F.col("v")
    none = a.where("v > 1e9")
    parts = [shapes.all_of(a, v < 100), shapes.all_of(a, v < 0.1), shapes.any_of(a, v > 0.3), shapes.any_of(a, v > 100), shapes.all_of(none, v > 0), shapes.any_of(none, v > 0)]
    names = ["all_small", "all_tiny", "any_large", "any_huge", "all_of_none", "any_of_none"]
    return reduce(DataFrame.crossJoin, [p.toDF(n) for p, n in zip(parts, names)])  # six single rows


@query("""with s as (select vec_id, i, round(list_sum(list_transform(embedding[1:i], lambda x: abs(x::double))), 9) as s from embeddings, range(1, 65) t(i)) select vec_id, round(coalesce(min(case when s >= 2 then s end), max(s)), 6) as total from s group by 1""")
def fold_while(spark, d):
    """Sums magnitudes until the sum is 2 or more."""
    values = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    out = shapes.fold_while(values, F.lit(0.0), lambda s, x: s + x, lambda s: F.round(s, 9) < 2)
    return table(spark, d, "embeddings").select("vec_id", _r(out).alias("total"))


@query("select y.i as i0, x.i as i1, x.i * 0.5::double as x, y.i - 1.0::double as y, 'xy' as kind from range(4) x(i), range(3) y(i) union all select x.i, y.i, x.i * 0.5::double, y.i - 1.0::double, 'ij' from range(4) x(i), range(3) y(i)")
def meshgrid(spark, d):
    x = spark.range(4).select(F.col("id").alias("i0"), (F.col("id") * 0.5).alias("v"))
    y = spark.range(3).select(F.col("id").alias("i0"), (F.col("id") - 1.0).alias("v"))
    return shapes.meshgrid(x, y).withColumn("kind", F.lit("xy")).unionByName(shapes.meshgrid(x, y, "ij").withColumn("kind", F.lit("ij")))


@query("""select 'function' as kind, a.i as i0, b.i as i1, c.i as i2, a.i * 100.0::double + b.i * 10 + c.i as v from range(2) a(i), range(3) b(i), range(4) c(i) union all select 'full', a.i, b.i, null, 7.5::double from range(2) a(i), range(2) b(i)
 union all select 'diagonal', a.i, b.i, null, case when a.i = b.i then a.i + 1.0::double else 0.0 end from range(3) a(i), range(3) b(i) union all select 'range', i, null, null, 1.0::double - 0.25 * i from range(6) t(i) union all select 'flat', i // 3, i % 3, null, i * 2.0::double from range(12) t(i) union all select 'column', i % 4, i // 4, null, i * 2.0::double from range(12) t(i)""")
def constructors(spark, d):
    vector = lambda n, c: spark.range(n).select(F.col("id").alias("i0"), c.alias("v"))
    parts = {
        "function": shapes.from_function(spark, (2, 3, 4), lambda a, b, c: a * 100.0 + b * 10 + c),
        "full": shapes.full(spark, (2, 2), 7.5),
        "diagonal": shapes.from_diagonal(vector(3, F.col("id") + 1.0), 3),
        "range": shapes.stepped_range(spark, 1.0, -0.5, -0.25),
        "flat": shapes.from_flat(vector(12, F.col("id") * 2.0), (4, 3)),
        "column": shapes.from_flat(vector(12, F.col("id") * 2.0), (4, 3), column_major=True),
    }
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("kind", F.lit(n)) for n, p in parts.items()])


@query(f"select i2 as i0, i0 as i1, i1 as i2, v from {_CUBE} where i0 < 20 union all select 1000 + i1, i0, i2, v from {_CUBE} where i0 < 20")
def permuted_axes(spark, d):
    a = _cube(spark, d).where("i0 < 20")
    return shapes.permute(a, (2, 0, 1)).unionByName(shapes.swap_axes(a, 0, 1).withColumn("i0", F.col("i0") + 1000))


@query(f"select 'insert' as kind, i0, 0 as i1, i1 as i2, i2 as i3, v from {_CUBE} where i0 < 9 union all select 'remove', i0, i2, null, null, v from {_CUBE} where i0 < 9 and i1 = 0 union all select 'merge', i0, i1 * 8 + i2, 0, null, v from {_CUBE} where i0 < 9 union all select 'at', i0, i1, null, null, v from {_CUBE} where i0 < 9 and i2 = 5")
def axes_of_arrays(spark, d):
    a = _cube(spark, d).where("i0 < 9")
    parts = {"insert": shapes.insert_axis(a, 1), "remove": shapes.remove_axis(a, 1), "merge": shapes.merge_axes(a, 2, 1, 8), "at": shapes.remove_axis(a, 2, 5)}
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.withColumn("kind", F.lit(n)) for n, p in parts.items()])


@query(f"select (i0 * 64 + i1 * 8 + i2) // 80 as i0, ((i0 * 64 + i1 * 8 + i2) // 4) % 20 as i1, (i0 * 64 + i1 * 8 + i2) % 4 as i2, v, 'rows' as kind from {_CUBE} where i0 < 10 union all select (i0 + 10 * i1 + 80 * i2) % 8, ((i0 + 10 * i1 + 80 * i2) // 8) % 20, (i0 + 10 * i1 + 80 * i2) // 160, v, 'columns' from {_CUBE} where i0 < 10")
def reshape_order(spark, d):
    a = _cube(spark, d).where("i0 < 10")
    return shapes.reshape(a, (10, 8, 8), (8, 20, 4)).withColumn("kind", F.lit("rows")).unionByName(shapes.reshape(a, (10, 8, 8), (8, 20, 4), column_major=True).withColumn("kind", F.lit("columns")))


@query(f"select i0, 7 - i1 as i1, (6 - i2) // 2 as i2, v from {_CUBE} where i0 >= 2 and i2 between 2 and 6 and (6 - i2) % 2 = 0".replace("select i0,", "select i0 - 2 as i0,"))
def slice_each_axis(spark, d):
    n = table(spark, d, "embeddings").count()
    return shapes.slice_each_axis(_cube(spark, d), [(2, n, 1), (0, 8, -1), (2, 7, -2)])


@query(f"select part, i0, i1 - lo as i1, v from {_LONG}, (values (0, 0, 8), (1, 20, 33), (2, 60, 64)) s(part, lo, hi) where i1 >= lo and i1 < hi")
def multi_slice(spark, d):
    parts = shapes.multi_slice(_long(spark, d), 1, [(0, 8), (20, 33), (60, 64)])
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


@query(f"select (select v from {_LONG} where i0 = 3 and i1 = 5) as inside, null::double as outside, (select v from {_LONG} order by i0, i1 limit 1) as first, (select v from {_LONG} order by i0 desc, i1 desc limit 1) as last")
def elements(spark, d):
    a = _long(spark, d)
    return shapes.element(a, 3, 5).toDF("inside").crossJoin(shapes.element(a, 3, 64).toDF("outside")).crossJoin(shapes.ends(a))


@query(f"with p as (select i0, i1, exp(sum(ln(abs(v) + 1))) as p from {_CUBE} group by all) select i0, i1, round(p, 6) as v from p")
def product_axis(spark, d):
    a = _cube(spark, d).withColumn("v", F.abs("v") + 1)
    return shapes.product_axis(a, 2).withColumn("v", _r("v"))


@query("""select vec_id as i0, round(list_max(embedding)::double - list_min(embedding)::double, 6) as spread, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double * pow(0.5, 63 - i))), 6) + 0.0 as fold from embeddings""")
def lane_maps(spark, d):
    """Each row's spread, and an ordered fold: half of the value so far and the next element."""
    a = _long(spark, d)
    spread = shapes.map_axis(a, 1, lambda x: F.array_max(x) - F.array_min(x)).withColumnRenamed("v", "spread")
    fold = shapes.fold_axis(a, 1, F.lit(0.0), lambda s, x: s / 2 + x).withColumnRenamed("v", "fold")
    return spread.join(fold, "i0").select("i0", _r("spread").alias("spread"), _r("fold").alias("fold"))


@query(f"with r as (select i0, i1, v, row_number() over (partition by i0 order by v, i1) - 1 as rank from {_LONG}) select i0, i1, rank, sign(rank - 10)::int as side, v from r")
def partition_sort(spark, d):
    a = _long(spark, d)
    ranked = shapes.sorted_lanes(a, 1).select("i0", F.col("i1").alias("rank"), "v")
    return shapes.partition(a, 1, 10).drop("v").join(ranked, ["i0", "rank"]).select("i0", "i1", "rank", "side", "v")


@query(f"select i0, i1, v from {_LONG} union all select (select count(*) from embeddings), i1, -v from {_LONG} where i0 = 0 union all select i0, 64, i0 * 0.5::double from (select distinct i0 from {_LONG})")
def push_lanes(spark, d):
    a = _long(spark, d).select(F.col("i0").cast("bigint").alias("i0"), F.col("i1").cast("bigint").alias("i1"), "v")
    n = table(spark, d, "embeddings").count()
    row = a.where("i0 = 0").select(F.col("i1").alias("i0"), (-F.col("v")).alias("v"))
    column = a.select("i0").distinct().select("i0", (F.col("i0") * 0.5).alias("v"))
    return shapes.push(shapes.push(a, 0, n, row), 1, 64, column)


@query("""select '{"v":1,"dim":[3,4],"data":[' || string_agg((i * 0.5)::varchar, ',' order by i) || ']}' as json, sum(i * 0.5)::double as total, count(*) as n from range(12) t(i)""")
def array_json(spark, d):
    a = shapes.from_function(spark, (3, 4), lambda i, j: (i * 4 + j) * 0.5)
    text = shapes.to_json(a, (3, 4))
    return text.crossJoin(shapes.from_json(text, "json").agg(F.sum("v").alias("total"), F.count("*").alias("n")))


@query()
def random_arrays(spark, d):
    """Moments of drawn arrays, and a sample of rows with and without replacement."""
    u, z = shapes.random(spark, (200, 50), 7), shapes.random(spark, (200, 50), 7, normal=True)
    moments = lambda a, n: a.agg(F.lit(n).alias("kind"), _r(F.avg("v"), 9).alias("mean"), _r(F.stddev_pop("v"), 9).alias("deviation"), F.count("*").alias("n"))
    drawn = [shapes.sample_axis(u, 0, 200, 30, 5, r) for r in (False, True)]
    return reduce(DataFrame.unionByName, [moments(u, "uniform"), moments(z, "normal"), moments(drawn[0], "sample"), moments(drawn[1], "with replacement")])


_X, _Y = "(value / 100)", "(event_id % 7 - 3)"


@query(f"""with e as (select event_id, {_X} as x, {_Y}::double as y, tanh({_X}) as t from events) select event_id, isnan(x) as is_nan, isinf(x) as is_infinite, isinf(1e308 * 10 * (case when event_id % 2 = 0 then 1 else 0 end)) as overflow, round(x) + 0.0 as round, round(exp2, 6) as exp2, round(em1, 6) + 0.0 as exp_m1, round(log10, 6) as log10, round(log2, 6) as log2, round(asin(t), 6) + 0.0 as asin, round(acos(t), 6) as acos,
 round(atan(x), 6) + 0.0 as atan, round(sinh(t), 6) + 0.0 as sinh, round(cosh(t), 6) as cosh, round(asinh(x), 6) + 0.0 as asinh, round(acosh(1 + abs(x)), 6) as acosh, round(atanh(t * 0.9), 6) + 0.0 as atanh, round(radians(x), 6) + 0.0 as to_radians, round(degrees(t), 6) + 0.0 as to_degrees, round(x * x, 6) as pow2, round(-x, 6) + 0.0 as neg
 from (select *, pow(2.0, x) as exp2, exp(t) - 1 as em1, log10(abs(x) + 0.1) as log10, log2(abs(x) + 0.1) as log2 from e)""")
def float_maths(spark, d):
    x = F.col("value") / 100
    t, m = F.tanh(x), maths.UNARY
    of = {"exp2": x, "exp_m1": t, "log10": F.abs(x) + 0.1, "log2": F.abs(x) + 0.1, "asin": t, "acos": t, "atan": x, "sinh": t, "cosh": t, "asinh": x, "acosh": 1 + F.abs(x), "atanh": t * 0.9, "to_radians": x, "to_degrees": t, "pow2": x, "neg": x}
    overflow = F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(0.0)
    return table(spark, d, "events").select("event_id", m["is_nan"](x).alias("is_nan"), m["is_infinite"](x).alias("is_infinite"), m["is_infinite"](overflow).alias("overflow"), (m["round"](x) + 0.0).alias("round"), *[_r(m[n](c)).alias(n) for n, c in of.items()])


@query(f"""with e as (select event_id, {_X} as x, {_Y}::double as y from events) select event_id, round(pow(abs(x), y / 2), 4) as powf, round(ln(abs(x) + 0.1) / ln(3), 6) + 0.0 as log, greatest(x - y, 0.0) as abs_sub, round(sqrt(x * x + y * y), 6) as hypot,
 case when y = 0 then case when x > 0 then 'inf' when x < 0 then '-inf' else 'nan' end else 'finite' end as division, round(case when y <> 0 then x / y end, 6) + 0.0 as quotient, case when y > 0 then round(ln(y), 6) when y = 0 then -1e300 else 1e300 end as logarithm from e where abs(x) > 0.001""")
def float_pairs(spark, d):
    x, y = F.col("value") / 100, (F.col("event_id") % 7 - 3).cast("double")
    m = maths.BINARY
    q = m["div"](x, y)
    kind = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").otherwise("finite")
    logarithm = maths.ln(y)
    shown = F.when(F.isnan(logarithm), 1e300).when(logarithm == float("-inf"), -1e300).otherwise(_r(logarithm))
    rows = table(spark, d, "events").where(F.abs(x) > 0.001)
    return rows.select("event_id", _r(m["powf"](F.abs(x), y / 2), 4).alias("powf"), _r(m["log"](F.abs(x) + 0.1, F.lit(3.0))).alias("log"), m["abs_sub"](x, y).alias("abs_sub"), _r(m["hypot"](x, y)).alias("hypot"), kind.alias("division"), F.when(kind == "finite", _r(q)).alias("quotient"), shown.alias("logarithm"))


_S = "embedding[i + 1]"


@query(f"""select vec_id, list_transform(range(64), lambda i: round(exp({_S}::double), 4)) as exp, list_transform(range(64), lambda i: round(ln(abs({_S}::double) + 0.5), 4) + 0.0) as ln, list_transform(range(64), lambda i: round(tanh({_S}::double), 4) + 0.0) as tanh, list_transform(range(64), lambda i: -{_S}) as neg,
 list_transform(range(64), lambda i: round(pow(abs({_S}::double), abs(embedding[64 - i]::double)), 4)) as pow, list_transform(range(64), lambda i: round(2.5 * {_S}::double + embedding[64 - i]::double, 4) + 0.0) as axpy, list_transform(range(64), lambda i: round(-0.5 * {_S}::double, 4) + 0.0) as scal from embeddings""")
def vector_maths(spark, d):
    v = F.col("embedding").cast("array<double>")
    w = F.reverse(v)
    r4 = lambda a: F.transform(a, lambda x: _r(x.cast("double"), 4))
    on = maths.on_array
    return table(spark, d, "embeddings").select(
        "vec_id", r4(F.transform(on("exp", v), lambda x: x)).alias("exp"), r4(on("ln", F.transform(v, lambda x: F.abs(x) + 0.5))).alias("ln"), r4(on("tanh", v)).alias("tanh"), F.transform(on("neg", v), maths.single).alias("neg"),
        r4(on("powf", F.transform(v, F.abs), F.transform(w, F.abs))).alias("pow"), r4(maths.axpy(2.5, v, w)).alias("axpy"), r4(maths.scaled(-0.5, v)).alias("scal"),
    )


@query("""select vec_id, a, b, round(case when a = 0 and b = 0 then 1 else a / r end, 6) + 0.0 as c, round(case when a = 0 and b = 0 then 0 else b / r end, 6) + 0.0 as s, round(r, 6) + 0.0 as r from (select vec_id, a, b, sqrt(a * a + b * b) * sign(case when abs(a) > abs(b) then a else b end) as r
 from (select vec_id, case when vec_id % 50 = 0 then 0.0::double else embedding[1]::double end as a, case when vec_id % 100 = 0 then 0.0::double else embedding[2]::double end as b from embeddings))""")
def givens_rotations(spark, d):
    a = F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(F.get("embedding", 0).cast("double"))
    b = F.when(F.col("vec_id") % 100 == 0, 0.0).otherwise(F.get("embedding", 1).cast("double"))
    g = maths.givens(F.col("a"), F.col("b"))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"), b.alias("b")).withColumn("g", g)
    return rows.select("vec_id", "a", "b", *[_r(f"g.{n}").alias(n) for n in ("c", "s", "r")])


_W, _B = "(1 + (i % 5) / 10.0::double)", "((i % 3) / 100.0::double)"


@query(f"""with e as (select vec_id, embedding::double[] as e, list_avg(embedding::double[]) as mu from embeddings), s as (select *, list_avg(list_transform(e, lambda x: (x - mu) * (x - mu))) as var, list_avg(list_transform(e, lambda x: x * x)) as ms, list_max(e) as top from e),
 g as (select *, list_transform(range(4), lambda g: list_avg(e[g * 16 + 1:g * 16 + 16])) as gm from s), h as (select *, list_transform(range(4), lambda g: list_avg(list_transform(e[g * 16 + 1:g * 16 + 16], lambda x: (x - gm[g + 1]) * (x - gm[g + 1])))) as gv from g)
 select vec_id, list_transform(range(64), lambda i: round((e[i + 1] - mu) / sqrt(var + 1e-5) * {_W} + {_B}, 5) + 0.0) as layer, list_transform(range(64), lambda i: round(e[i + 1] / sqrt(ms + 1e-5) * {_W}, 5) + 0.0) as rms,
 list_transform(range(64), lambda i: round((e[i + 1] - gm[i // 16 + 1]) / sqrt(gv[i // 16 + 1] + 1e-5) * {_W} + {_B}, 5) + 0.0) as groups, list_transform(e, lambda x: round(x - top - ln(list_sum(list_transform(e, lambda y: exp(y - top)))), 5) + 0.0) as log_softmax from h""")
def weighted_norms(spark, d):
    v = F.col("embedding").cast("array<double>")
    at = F.sequence(F.lit(0), F.lit(63))
    w, b = F.transform(at, lambda i: 1 + (i % 5) / 10.0), F.transform(at, lambda i: (i % 3) / 100.0)
    r5 = lambda a: F.transform(a, lambda x: _r(x, 5))
    return table(spark, d, "embeddings").select(
        "vec_id", r5(V.affine(V.layer_norm(v), w, b)).alias("layer"), r5(V.affine(V.rms_norm(v), w)).alias("rms"), r5(V.group_norm(v, 4, w, b)).alias("groups"), r5(V.log_softmax(v)).alias("log_softmax")
    )
