"""Queries on reductions, windows, shapes, elementwise functions and linear algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import arrays, linalg, numerics, windows

from .registry import query, table

_LONG = "(select vec_id as i0, generate_subscripts(embedding, 1) - 1 as i1, unnest(embedding)::double as v from embeddings)"
_DAILY = "(select date_trunc('month', o_orderdate) as grp, date_trunc('day', o_orderdate) as d, sum(o_totalprice) as t from orders group by all)"


def _long(spark, d):
    return arrays.from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def _daily(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").alias("grp"), F.date_trunc("day", "o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("t"))


def _r(c, n=6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


@query("""select l_returnflag, count(l_extendedprice) as n, round(sum(l_extendedprice), 2) as total, round(avg(l_extendedprice), 6) as mean,
 round(median(l_extendedprice), 6) as median, round(quantile_cont(l_extendedprice, 0.25), 6) as p25, round(quantile_cont(l_extendedprice, 0.9), 6) as p90,
 round(var_pop(l_extendedprice), 1) as variance, round(stddev_pop(l_extendedprice), 4) as deviation, sum((l_extendedprice <> 0)::int)::double as l0,
 round(sum(abs(l_extendedprice)), 2) as l1, round(sqrt(sum(l_extendedprice * l_extendedprice)), 3) as l2, round(pow(sum(pow(abs(l_extendedprice), 3.0)), 1.0/3), 3) as l3
 from lineitem group by 1""")
def stats_suite(spark, d):
    s = numerics.summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    digits = {"total": 2, "mean": 6, "median": 6, "p25": 6, "p90": 6, "variance": 1, "deviation": 4, "l1": 2, "l2": 3, "l3": 3}
    return s.select("l_returnflag", "n", "l0", *[_r(c, n).alias(c) for c, n in digits.items()])


@query("""select o_orderstatus, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as argmin, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as argmax,
 arg_min(o_orderkey, (-abs(o_totalprice), o_orderkey)) as argmax_abs from orders group by 1""")
def argminmax(spark, d):
    return numerics.arg_extremes(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", "o_totalprice")


@query(f"""select i1, round(sum(v), 6) as sum, round(avg(v), 6) as mean, round(var_samp(v), 6) as variance, round(stddev_samp(v), 6) as deviation, round(min(v), 6) as low, round(max(v), 6) as high from {_LONG} group by 1""")
def axis_mean_var(spark, d):
    a = numerics.axis_reduce(_long(spark, d), ["i1"], ddof=1)
    return a.select("i1", *[_r(c).alias(c) for c in ("sum", "mean", "variance", "deviation", "low", "high")])


@query(f"""select i0, round(sum(v), 6) as sum, round(avg(v), 6) as mean, round(var_pop(v), 6) as variance, round(stddev_pop(v), 6) as deviation, round(min(v), 6) as low, round(max(v), 6) as high from {_LONG} group by 1""")
def axis_rows(spark, d):
    a = numerics.axis_reduce(_long(spark, d), ["i0"])
    return a.select("i0", *[_r(c).alias(c) for c in ("sum", "mean", "variance", "deviation", "low", "high")])


@query("""with r as (select avg(n1) over (partition by x) as rx, avg(n2) over (partition by y) as ry from (select embedding[1] as x, embedding[2] as y, row_number() over (order by embedding[1]) as n1, row_number() over (order by embedding[2]) as n2 from embeddings))
 select round(corr(rx, ry), 6) as rho from r""")
def spearman(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return numerics.spearman(e, "x", "y").select(_r("rho").alias("rho"))


@query("""with c as (select l_returnflag a, l_linestatus b, count(*)::double n from lineitem group by all),
 s as (select sum(n*(n-1)/2) bo, sum(n) al from c), ra as (select sum(n*(n-1)/2) x from (select sum(n) n from c group by a)), rb as (select sum(n*(n-1)/2) y from (select sum(n) n from c group by b))
 select round((bo - x*y/(al*(al-1)/2)) / ((x+y)/2 - x*y/(al*(al-1)/2)), 6) as ari from s, ra, rb""")
def adjusted_rand_index(spark, d):
    return numerics.adjusted_rand(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(_r("ari").alias("ari"))


@query("""with h as (select (l_quantity * 5)::int as t, count(*)::double n from lineitem group by 1), r as (select t, sum(n) over (order by t) w0, sum(t*n) over (order by t) s0, sum(n) over () w, sum(t*n) over () s from h)
 select arg_min(t, (-(case when w > w0 then w0*(w-w0)*pow(s0/w0 - (s-s0)/(w-w0), 2) else 0 end), t)) as threshold from r""")
def otsu_threshold(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_quantity") * 5).cast("int").alias("v"))
    return numerics.otsu(l, "v")


@query(f"select grp, d, round(sum(t) over w, 2) as total, max(t) over w as high, count(*) over w as n from {_DAILY} window w as (partition by grp order by d rows between unbounded preceding and current row)")
def running_total(spark, d):
    r = windows.running(_daily(spark, d), ["grp"], "d", total=F.sum("t"), high=F.max("t"), n=F.count("*"))
    return r.withColumn("total", _r("total", 2))


@query(f"select grp, d, round(exp(sum(ln(1 + t / 1e9)) over (partition by grp order by d rows between unbounded preceding and current row)), 8) as product from {_DAILY}")
def cumprod(spark, d):
    r = windows.running(_daily(spark, d).withColumn("g", 1 + F.col("t") / 1e9), ["grp"], "d", product=F.product("g"))
    return r.withColumn("product", _r("product", 8))


@query(f"select grp, d, round(t - 2 * lag(t) over w + lag(t, 2) over w, 2) as diff from {_DAILY} window w as (partition by grp order by d) qualify lag(t, 2) over w is not null")
def diff_n(spark, d):
    s = _daily(spark, d).withColumnRenamed("d", "day")
    return windows.difference(s, ["grp"], "day", "t", 2).select("grp", F.col("day").alias("d"), _r("d", 2).alias("diff"))


@query(f"""select grp, start, (i - 1)::bigint as i, round(total, 2) as total, low, high from (select grp, d as start, row_number() over (partition by grp order by d) as i, count(*) over w as n, sum(t) over w as total, min(t) over w as low, max(t) over w as high
 from {_DAILY} window w as (partition by grp order by d rows between current row and 6 following)) where n = 7 and (i - 1) % 2 = 0""")
def moving_window(spark, d):
    w = windows.sliding(_daily(spark, d), ["grp"], "d", "t", 7, stride=2)
    return w.select("grp", "start", F.col("i").cast("bigint").alias("i"), _r("total", 2).alias("total"), "low", "high")


@query(f"select grp, i // 7 as chunk, count(*) as n, round(sum(t), 2) as total, min(d) as start from (select *, row_number() over (partition by grp order by d) - 1 as i from {_DAILY}) group by all having count(*) = 7")
def exact_chunks(spark, d):
    return windows.chunks(_daily(spark, d), ["grp"], "d", "t", 7).withColumn("total", _r("total", 2))


@query(f"select grp, i // 4 as chunk, count(*) as n, round(sum(t), 2) as total, min(d) as start from (select *, row_number() over (partition by grp order by d) - 1 as i from {_DAILY}) group by all")
def axis_chunks(spark, d):
    return windows.chunks(_daily(spark, d), ["grp"], "d", "t", 4, exact=False).withColumn("total", _r("total", 2))


@query("select vec_id, list_transform(embedding, lambda x: round(exp(x::double - list_max(embedding)::double) / list_sum(list_transform(embedding, lambda y: exp(y::double - list_max(embedding)::double))), 6) + 0.0) as p from embeddings")
def softmax_rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.softmax(F.col("embedding")), lambda x: _r(x)).alias("p"))


@query("""with m as (select vec_id, embedding::double[] as e, list_avg(embedding::double[]) as mu from embeddings), s as (select *, sqrt(list_avg(list_transform(e, lambda x: (x - mu) * (x - mu))) + 1e-5) as sd from m)
 select vec_id, round(list_sum(list_transform(e, lambda x: abs((x - mu) / sd))), 5) as layer_l1, round(list_sum(list_transform(e, lambda x: abs(x))) / sqrt(list_avg(list_transform(e, lambda x: x * x)) + 1e-5), 5) as rms_l1 from s""")
def layer_norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", _r(V.norm(V.layer_norm(F.col("embedding")), 1), 5).alias("layer_l1"), _r(V.norm(V.rms_norm(F.col("embedding")), 1), 5).alias("rms_l1"))


@query("""select event_id, round(sqrt(abs(value)), 6) as root, round(ln(1 + abs(value)), 6) as log1p, round(cbrt(value), 6) as cbrt, round(sin(value), 6) + 0.0 as sin, round(cos(value), 6) + 0.0 as cos, floor(value) as floor, ceil(value) as ceil,
 round_even(value, 0) as rint, trunc(value) as trunc, sign(value)::double as signum, round(value - trunc(value), 6) + 0.0 as fract, greatest(10.0, least(100.0, value)) as clamp, round(1 / (1 + exp(-value / 100)), 6) as sigmoid,
 round(value / 100 / (1 + exp(-value / 100)), 6) + 0.0 as silu, round(0.5 * value / 100 * (1 + tanh(0.7978845608028654 * (value / 100 + 0.044715 * pow(value / 100, 3)))), 6) + 0.0 as gelu, round(degrees(atan2(value, 10)), 6) as angle from events""")
def elementwise(spark, d):
    v, s = F.col("value"), F.col("value") / 100
    return table(spark, d, "events").select(
        "event_id", _r(F.sqrt(F.abs(v))).alias("root"), _r(F.log1p(F.abs(v))).alias("log1p"), _r(F.cbrt(v)).alias("cbrt"), _r(F.sin(v)).alias("sin"), _r(F.cos(v)).alias("cos"),
        F.floor(v).cast("double").alias("floor"), F.ceil(v).cast("double").alias("ceil"), F.rint(v).alias("rint"), V.trunc(v).alias("trunc"), F.signum(v).alias("signum"), _r(v - V.trunc(v)).alias("fract"),
        F.greatest(F.lit(10.0), F.least(F.lit(100.0), v)).alias("clamp"), _r(V.sigmoid(s)).alias("sigmoid"), _r(V.silu(s)).alias("silu"), _r(V.gelu(s)).alias("gelu"), _r(F.degrees(F.atan2(v, F.lit(10.0)))).alias("angle"),
    )


@query("""with v as (select vec_id, embedding::double[] as e from embeddings union all select vec_id + 1000000, list_transform(embedding, lambda x: abs(x::double) + 0.5) from embeddings union all select vec_id + 2000000, list_transform(embedding, lambda x: -abs(x::double) - 0.5) from embeddings),
 q as (select vec_id, e, list_min(e) as lo, list_max(e) as hi from v), p as (select *, (hi - lo) / 255 as scale, greatest(0, least(255, round(-lo / ((hi - lo) / 255)))) as zero from q)
 select vec_id, round(scale, 9) as scale, zero::int as zero, list_transform(e, lambda x: greatest(0, least(255, round(x / scale + zero)))::int) as codes from p""")
def quantize_u8(spark, d):
    """The vectors, and copies with positive and with negative numbers only."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    up = e.select(F.col("vec_id") + 1_000_000, F.transform("v", lambda x: F.abs(x) + 0.5))
    down = e.select(F.col("vec_id") + 2_000_000, F.transform("v", lambda x: -F.abs(x) - 0.5))
    return e.union(up).union(down).select("vec_id", V.quantize_u8(F.col("v")).alias("q")).select("vec_id", _r("q.scale", 9).alias("scale"), "q.zero", "q.codes")


@query("""with q as (select vec_id, embedding::double[] as e, list_max(list_transform(embedding, lambda x: abs(x::double))) / 127 as s from embeddings)
 select vec_id, round(s, 9) as scale, list_transform(e, lambda x: greatest(-127, least(127, round(x / s)))::int) as codes from q""")
def quantize_i8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.quantize_i8(F.col("embedding")).alias("q")).select("vec_id", _r("q.scale", 9).alias("scale"), "q.codes")


@query("""with c as (select vec_id, bits, list_transform(embedding, lambda x: (floor(abs(x) * 1000)::bigint % (1 << bits))::int) as codes from embeddings, (values (2), (4), (8), (16)) t(bits))
 select vec_id, bits, codes, list_transform(range((2 * bits)::bigint), lambda w: list_sum(list_transform(range((32 // bits)::bigint), lambda j: codes[w * (32 // bits) + j + 1]::bigint << (j * bits)::bigint))::bigint) as words from c""")
def pack_round_trip(spark, d):
    """Codes of every width packed, the words themselves, and the codes unpacked from them."""
    e = table(spark, d, "embeddings")
    one = lambda bits: e.select("vec_id", F.lit(bits).alias("bits"), V.pack_codes(F.transform("embedding", lambda x: (F.floor(F.abs(x) * F.lit(1000).cast("float")) % (1 << bits)).cast("int")), bits).alias("words"))
    parts = [one(b).withColumn("codes", V.unpack_codes(F.col("words"), b, F.lit(64))) for b in (2, 4, 8, 16)]
    return reduce(DataFrame.unionByName, parts)


@query(f"select a.i1 as i0, b.i1 as i1, round(sum(a.v * b.v), 5) as v from {_LONG} a join {_LONG} b on a.i0 = b.i0 group by all")
def matmul_gram(spark, d):
    g = linalg.gram(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")))
    return g.withColumn("v", _r("v", 5))


@query(f"""with g as (select label, i1, avg(v) as c from (select e.label, a.i1, a.v from {_LONG} a join embeddings e on e.vec_id = a.i0) group by all)
 select a.i0, g.label as i1, round(2.0 * sum(a.v * g.c), 5) as v from {_LONG} a join g on a.i1 = g.i1 group by all""")
def matmul_centroids(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select("label", F.posexplode("embedding").alias("i1", "v")).groupBy(F.col("i1").alias("i0"), F.col("label").alias("i1")).agg(F.avg(F.col("v").cast("double")).alias("v"))
    return linalg.matmul(_long(spark, d), b, 2.0).withColumn("v", _r("v", 5))


@query(f"select i0, round(0.5 * sum(v / (i1 + 1)), 6) + 0.0 as v from {_LONG} group by 1")
def gemv(spark, d):
    x = spark.range(64).select(F.col("id").alias("i"), (1 / (F.col("id") + 1)).alias("x"))
    return linalg.matvec(_long(spark, d), x, 0.5).withColumn("v", _r("v"))


_SQUARE = "(select s.s_nationkey as i0, c.c_nationkey as i1, count(*)::double as v from orders o join customer c on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey join supplier s on s.s_suppkey = l.l_suppkey group by all)"


def _square(spark, d):
    o, c, l, s = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy(F.col("s_nationkey").alias("i0"), F.col("c_nationkey").alias("i1")).agg(F.count("*").cast("double").alias("v"))


@query(f"select i0, i1, case when i1 >= i0 + 1 then v else 0.0 end as v from {_SQUARE}")
def triu(spark, d):
    return arrays.triangle(_square(spark, d), 1)


@query(f"select i0, i1, case when i1 <= i0 then v else 0.0 end as v from {_SQUARE}")
def tril(spark, d):
    return arrays.triangle(_square(spark, d), 0, upper=False)


@query(f"with s as {_SQUARE}, f as (select i0, i1, v from s where i0 <= i1 union all select i1, i0, v from s where i0 < i1) select i0, sum(v * (i1 + 1)) as v from f group by 1")
def symv(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return linalg.matvec(linalg.symmetric(_square(spark, d), True), x)


@query(f"select i0, sum(v * (i1 + 1)) as v from {_SQUARE} where i1 - i0 between -2 and 3 group by 1")
def gbmv(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return linalg.matvec(linalg.banded(_square(spark, d), 2, 3), x)


@query(f"select i1 as i0, i0 as i1, v from {_SQUARE}")
def transpose(spark, d):
    return arrays.transpose(_square(spark, d))


@query(f"select i0 * 2 + a as i0, i1 * 2 + b as i1, v * (1 + a + b) as v from {_SQUARE}, (values (0), (1)) x(a), (values (0), (1)) y(b)")
def kron(spark, d):
    small = spark.createDataFrame([(i, j, 1.0 + i + j) for i in (0, 1) for j in (0, 1)], "i0 int, i1 int, v double")
    return linalg.kron(_square(spark, d), small, 2, 2)


@query("select n_nationkey as i0, r_regionkey as i1, 0.5::double * (n_nationkey + 1) * (r_regionkey + 1) as v from nation, region")
def ger(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1).cast("double").alias("x"))
    y = table(spark, d, "region").select(F.col("r_regionkey").alias("i"), (F.col("r_regionkey") + 1).cast("double").alias("x"))
    return linalg.outer(x, y, 0.5)


@query(f"select i0, ((i1 - 4) // 3)::bigint as i1, v from {_LONG} where i1 >= 4 and i1 < 40 and (i1 - 4) % 3 = 0")
def slice_axis(spark, d):
    return arrays.slice_axis(_long(spark, d), "i1", 4, 40, 3)


@query(f"select i0, s.i as i1, v from {_LONG} a join (values (0, 5), (1, 5), (2, 63), (3, 0)) s(i, o) on a.i1 = s.o")
def take_axis(spark, d):
    a = arrays.take(_long(spark, d), "i1", [5, 5, 63, 0])
    return a.select("i0", F.col("i1").cast("int").alias("i1"), "v")


@query(f"select i0, 63 - i1 as i1, v from {_LONG}")
def invert_axis(spark, d):
    return arrays.invert_axis(_long(spark, d), "i1", 64)


@query(f"select i0, case when i1 > 10 then i1 - 1 else i1 end as i1, v from {_LONG} where i1 <> 10")
def remove_index(spark, d):
    return arrays.remove_index(_long(spark, d), "i1", 10)


@query(f"select i0 * 4 + i1 // 16 as i0, i1 % 16 as i1, v from {_LONG}")
def reshape(spark, d):
    n = table(spark, d, "embeddings").count()
    return arrays.reshape(_long(spark, d), (n, 64), (n * 4, 16))


@query(f"select i0 * 64 + i1 as i, v from {_LONG}")
def flatten(spark, d):
    return arrays.flatten(_long(spark, d), 64)


@query(f"select i0, i1, v from {_LONG} union all select i0 + (select count(*) from embeddings), i1, -v from {_LONG}")
def concatenate(spark, d):
    n = table(spark, d, "embeddings").count()
    a = _long(spark, d)
    return arrays.concatenate([(a, n), (a.withColumn("v", -F.col("v")), n)], "i0")


@query(f"select i0, i1, v, 0::bigint as k from {_LONG} union all select i0, i1, -v, 1 from {_LONG}")
def stack(spark, d):
    a = _long(spark, d)
    return arrays.stack([a, a.withColumn("v", -F.col("v"))])


@query(f"select a.i0, a.i1, round(a.v * b.v + 1, 6) as v from {_LONG} a join {_LONG} b on a.i0 = b.i0 and a.i1 = 63 - b.i1")
def zip_map(spark, d):
    a = _long(spark, d)
    return arrays.zip_arrays(a, arrays.invert_axis(a, "i1", 64), ["i0", "i1"], _r(F.col("va") * F.col("vb") + 1))


@query("select i, round(1.0::double + i * 0.5, 6) as lin, round(pow(2.0, 1.0 + i * 0.5), 6) as log, round(exp(ln(1.0) + i * (ln(1000.0) - ln(1.0)) / 18), 6) as geo from range(19) t(i)")
def spaces(spark, d):
    lin, log, geo = arrays.linspace(spark, 1.0, 10.0, 19), arrays.logspace(spark, 2.0, 1.0, 10.0, 19), arrays.geomspace(spark, 1.0, 1000.0, 19)
    return lin.select("i", _r("v").alias("lin")).join(log.select("i", _r("v").alias("log")), "i").join(geo.select("i", _r("v").alias("geo")), "i")


@query("select i // 8 as i0, i % 8 as i1, case when i // 8 = i % 8 then 1.0::double else 0.0 end as v from range(64) t(i)")
def eye(spark, d):
    return arrays.eye(spark, 8)


@query("""select vec_id, list_transform(range(33), lambda k: round(pow(list_sum(list_transform(range(64), lambda t: embedding[t + 1]::double * cos(2 * pi() * k * t / 64))), 2) + pow(list_sum(list_transform(range(64), lambda t: embedding[t + 1]::double * sin(2 * pi() * k * t / 64))), 2), 6) + 0.0) as power from embeddings""")
def fft_energy(spark, d):
    return linalg.spectrum(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.transform("v", lambda x: _r(x)).alias("power"))


@query("select vec_id, list_transform(range(64), lambda i: round(list_sum(list_transform(range(64), lambda k: embedding[k + 1]::double * (1 - 2 * (bit_count(i & k) % 2)))) / 8, 4) + 0.0) as v from embeddings")
def walsh_hadamard(spark, d):
    w = linalg.walsh_hadamard(table(spark, d, "embeddings"), "vec_id", "embedding")
    return w.select("vec_id", F.transform("v", lambda x: _r(x, 4)).alias("v"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))), 4) as norm, list_transform(embedding, lambda x: round(x::double, 4) + 0.0) as back from embeddings")
def walsh_hadamard_twice(spark, d):
    """Its own inverse; ``walsh_hadamard`` has the transform itself."""
    once = linalg.walsh_hadamard(table(spark, d, "embeddings"), "vec_id", "embedding")
    twice = linalg.walsh_hadamard(once.withColumnRenamed("v", "w"), "vec_id", "w").withColumnRenamed("v", "back")
    return twice.join(once, "vec_id").select("vec_id", _r(V.norm(F.col("v")), 4).alias("norm"), F.transform("back", lambda x: _r(x, 4)).alias("back"))


@query("select vec_id, list_transform(embedding[1:4], lambda x: round(x::double, 4) + 0.0) as x from embeddings")
def solve_systems(spark, d):
    """Builds b = A x with x the first four dimensions and solves for x again."""
    a = F.array(*[F.lit(5.0 + i if i == j else 1.0 / (1 + i + j)) for i in range(4) for j in range(4)])
    e = table(spark, d, "embeddings").select("vec_id", a.alias("a"), F.slice("embedding", 1, 4).cast("array<double>").alias("x"))
    e = e.withColumn("b", F.array(*[V.dot(F.slice("a", 4 * i + 1, 4), F.col("x")) for i in range(4)]))
    return linalg.solve(e, "vec_id", "a", "b", 4).select("vec_id", F.transform("v", lambda x: _r(x, 4)).alias("x"))
