"""Queries on dense factorisations, transforms, triangular and symmetric products, whole-number products and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import halves
from spindrift.functions import vectors as V
from spindrift.operators import linalg, signals

from .numeric import _LONG, _SQUARE, _long, _r, _square
from .registry import query, table
from .search import _prints

#: Three-by-three matrices of the embeddings' first numbers, diagonally heavy, and the same times its transpose.
_A3 = "(select vec_id, list_transform(range(9), lambda i: embedding[i + 1]::double + case when i % 4 = 0 then 3 else 0 end) as a, list_transform(range(3), lambda i: embedding[i + 20]::double) as b from embeddings)"
_SPD = f"(select vec_id, list_transform(range(9), lambda i: a[3 * (i // 3) + 1] * a[3 * (i % 3) + 1] + a[3 * (i // 3) + 2] * a[3 * (i % 3) + 2] + a[3 * (i // 3) + 3] * a[3 * (i % 3) + 3]) as s, b from {_A3})"


def _small(spark, d):
    e = F.col("embedding").cast("array<double>")
    a = F.transform(F.slice(e, 1, 9), lambda x, i: x + F.when(i % 4 == 0, 3.0).otherwise(0.0))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"), F.slice(e, 20, 3).alias("b"))
    s = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: V.dot(F.slice("a", 3 * i + 1, 3), F.slice("a", 3 * j + 1, 3)))))
    return rows.withColumn("s", s)


def _rounded(frame, *names, n=5):
    return frame.select("vec_id", *[F.transform(c, lambda x: _r(x, n)).alias(c) for c in names])


@query(f"""with f as (select vec_id, s, sqrt(s[1]) as l11 from {_SPD}), g as (select *, s[4] / l11 as l21, s[7] / l11 as l31 from f), h as (select *, sqrt(s[5] - l21 * l21) as l22 from g), k as (select *, (s[8] - l31 * l21) / l22 as l32 from h)
 select vec_id, list_transform([l11, 0, 0, l21, l22, 0, l31, l32, sqrt(s[9] - l31 * l31 - l32 * l32)], lambda x: round(x, 5) + 0.0) as lower from k""")
def cholesky_factor(spark, d):
    return _rounded(linalg.cholesky(_small(spark, d), "vec_id", "s", 3), "lower")


@query(f"""with f as (select vec_id, s, sqrt(s[1]) as r11 from (select vec_id, list_transform(range(9), lambda i: a[i // 3 + 1] * a[i % 3 + 1] + a[i // 3 + 4] * a[i % 3 + 4] + a[i // 3 + 7] * a[i % 3 + 7]) as s from {_A3})), g as (select *, s[2] / r11 as r12, s[3] / r11 as r13 from f), h as (select *, sqrt(s[5] - r12 * r12) as r22 from g), k as (select *, (s[6] - r12 * r13) / r22 as r23 from h)
 select vec_id, list_transform([r11, r12, r13, 0, r22, r23, 0, 0, sqrt(s[9] - r13 * r13 - r23 * r23)], lambda x: round(x, 4) + 0.0) as r, list_transform([1, 0, 0, 0, 1, 0, 0, 0, 1], lambda x: x::double) as "qtq", true as whole from k""")
def qr_factors(spark, d):
    """r; that q's columns are orthonormal, and that q r is the matrix."""
    f = linalg.qr(_small(spark, d), "vec_id", "a", 3, 3).join(_small(spark, d).select("vec_id", "a"), "vec_id")
    q, r, a = (lambda i, c=c: F.get(c, i) for c in ("q", "r", "a"))
    product = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    qtq = F.array(*[_r(product([q(i + 3 * k) for k in range(3)], [q(j + 3 * k) for k in range(3)]), 4) for i in range(3) for j in range(3)])
    gaps = [F.abs(product([q(3 * i + k) for k in range(3)], [r(3 * k + j) for k in range(3)]) - a(3 * i + j)) for i in range(3) for j in range(3)]
    whole = F.greatest(*gaps) < 1e-6
    return f.select("vec_id", F.transform("r", lambda x: _r(x, 4)).alias("r"), qtq.alias("qtq"), whole.alias("whole"))


@query(f"""with f as (select vec_id, a, a[4] / a[1] as l21, a[7] / a[1] as l31 from {_A3}), g as (select *, a[5] - l21 * a[2] as u22, a[6] - l21 * a[3] as u23 from f), h as (select *, (a[8] - l31 * a[2]) / u22 as l32 from g)
 select vec_id, list_transform([1, 0, 0, l21, 1, 0, l31, l32, 1], lambda x: round(x, 5) + 0.0) as lower, list_transform([a[1], a[2], a[3], 0, u22, u23, 0, 0, a[9] - l31 * a[3] - l32 * u23], lambda x: round(x, 5) + 0.0) as upper, [2.0::double, 0, 1] as pivots from h""")
def lu_factors(spark, d):
    """Of the matrices with their rows in the order 3, 1, 2 on input: pivoting has to undo that."""
    rows = _small(spark, d).select("vec_id", F.concat(F.slice("a", 4, 3), F.slice("a", 7, 3), F.slice("a", 1, 3)).alias("a"))
    f = linalg.lu(rows, "vec_id", "a", 3)
    return f.select("vec_id", *[F.transform(c, lambda x: _r(x, 5)).alias(c) for c in ("lower", "upper")], "pivots")


@query(f"""with x as (select vec_id, a, b, b[1] / a[1] as x1 from {_A3}), y as (select *, (b[2] - a[4] * x1) / a[5] as x2 from x), u as (select vec_id, a, b, b[3] / a[9] as u3 from {_A3}), w as (select *, (b[2] - a[6] * u3) / a[5] as u2 from u)
 select y.vec_id, list_transform([x1, x2, (y.b[3] - y.a[7] * x1 - y.a[8] * x2) / y.a[9]], lambda x: round(x, 6) + 0.0) as lower, list_transform([(w.b[1] - w.a[2] * u2 - w.a[3] * u3) / w.a[1], u2, u3], lambda x: round(x, 6) + 0.0) as upper,
 list_transform([y.b[1], y.b[2] - y.a[4] * y.b[1], y.b[3] - y.a[7] * y.b[1] - y.a[8] * (y.b[2] - y.a[4] * y.b[1])], lambda x: round(x, 6) + 0.0) as unit from y join w on y.vec_id = w.vec_id""")
def triangular_solves(spark, d):
    a = _small(spark, d)
    one = lambda name, **how: linalg.solve_triangular(a, "vec_id", "a", "b", 3, **how).select("vec_id", F.transform("v", lambda x: _r(x)).alias(name))
    return one("lower", upper=False).join(one("upper", upper=True), "vec_id").join(one("unit", upper=False, unit=True), "vec_id")


@query(f"""with r as (select vec_id, a, list_transform(range(6), lambda i: embedding[i + 30]::double) as b from {_A3} join (select vec_id, embedding from embeddings) using (vec_id)), x as (select *, b[1] / a[1] as p1, b[2] / a[1] as q1 from r), y as (select *, (b[3] - a[4] * p1) / a[5] as p2, (b[4] - a[4] * q1) / a[5] as q2 from x)
 select vec_id, list_transform([p1, q1, p2, q2, (b[5] - a[7] * p1 - a[8] * p2) / a[9], (b[6] - a[7] * q1 - a[8] * q2) / a[9]], lambda x: round(x, 6) + 0.0) as v from y""")
def triangular_solve_matrix(spark, d):
    b = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 30, 6).alias("b"))
    a = _small(spark, d).drop("b").join(b, "vec_id")
    return _rounded(linalg.solve_triangular(a, "vec_id", "a", "b", 3, upper=False, columns=2), "v", n=6)


_RE, _IM = "embedding[t + 1]::double", "embedding[t + 33]::double"
_ROT = "(2 * pi() * k * t / 32)"


@query(f"""select vec_id, list_transform(range(32), lambda k: round(list_sum(list_transform(range(32), lambda t: {_RE} * cos{_ROT} + {_IM} * sin{_ROT})), 5) + 0.0) as re, list_transform(range(32), lambda k: round(list_sum(list_transform(range(32), lambda t: {_IM} * cos{_ROT} - {_RE} * sin{_ROT})), 5) + 0.0) as im from embeddings where vec_id % 5 = 0
 union all select vec_id + 1000000, list_transform(range(32), lambda k: round(list_sum(list_transform(range(32), lambda t: {_RE} * cos{_ROT} - {_IM} * sin{_ROT})) / 32, 5) + 0.0), list_transform(range(32), lambda k: round(list_sum(list_transform(range(32), lambda t: {_IM} * cos{_ROT} + {_RE} * sin{_ROT})) / 32, 5) + 0.0) from embeddings where vec_id % 5 = 0""".replace(" where vec_id % 5 = 0", ""))
def complex_fft(spark, d):
    """Complex rows of 32 numbers and, under ids a million higher, the inverse transform of the same rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    there, back = linalg.fft(e, "vec_id", "x", "y"), linalg.fft(e, "vec_id", "x", "y", inverse=True)
    return _rounded(there.unionByName(back.withColumn("vec_id", F.col("vec_id") + 1_000_000)), "re", "im")


@query("""select vec_id, list_transform(range(33), lambda k: round(list_sum(list_transform(range(64), lambda t: embedding[t + 1]::double * cos(2 * pi() * k * t / 64))), 5) + 0.0) as re, list_transform(range(33), lambda k: round(-list_sum(list_transform(range(64), lambda t: embedding[t + 1]::double * sin(2 * pi() * k * t / 64))), 5) + 0.0) as im from embeddings""")
def real_fft(spark, d):
    return _rounded(linalg.rfft(table(spark, d, "embeddings"), "vec_id", "embedding"), "re", "im")


@query(f"with s as {_SQUARE} select i0, sum(case when i1 = i0 then 1 else v end * (i1 + 1)) as v from s where i1 <= i0 group by 1")
def trmv_unit(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return linalg.trmv(_square(spark, d), x, upper=False, unit=True)


@query(f"with s as {_SQUARE}, t as {_SQUARE} select s.i0, t.i1, 0.5::double * sum(s.v * t.v) as v from s join t on s.i1 = t.i0 where s.i0 <= s.i1 group by all")
def trmm(spark, d):
    return linalg.trmm(_square(spark, d), _square(spark, d), upper=True, alpha=0.5)


@query(f"with s as {_SQUARE}, f as (select i0, i1, v from s where i0 >= i1 union all select i1, i0, v from s where i0 > i1) select f.i0, t.i1, sum(f.v * t.v) as v from f join {_SQUARE} t on f.i1 = t.i0 group by all")
def symm(spark, d):
    return linalg.symm(_square(spark, d), _square(spark, d), upper=False)


@query(f"with s as {_SQUARE}, f as (select i0, i1, v from s where i0 <= i1 union all select i1, i0, v from s where i0 < i1) select i0, 2.0::double * sum(v * (i1 + 1)) as v from f where abs(i0 - i1) <= 4 group by 1")
def sbmv(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return linalg.sbmv(_square(spark, d), x, upper=True, width=4, alpha=2.0)


@query(f"""with x as (select n_nationkey as i, n_nationkey + 1.0::double as x, n_regionkey * 2.0::double as y from nation), p as (select a.i as i0, b.i as i1, 0.5 * a.x * b.x as one, 0.25 * (a.x * b.y + a.y * b.x) as two from x a, x b), s as {_SQUARE}
 select 'rank one' as kind, p.i0, p.i1, round(one + coalesce(v, 0), 6) as v from p left join s on p.i0 = s.i0 and p.i1 = s.i1 where p.i0 <= p.i1 union all select 'rank two', p.i0, p.i1, round(two + coalesce(v, 0), 6) from p left join s on p.i0 = s.i0 and p.i1 = s.i1 where p.i0 >= p.i1""")
def syr(spark, d):
    n = table(spark, d, "nation")
    x = n.select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1).cast("double").alias("x"))
    y = n.select(F.col("n_nationkey").alias("i"), (F.col("n_regionkey") * 2).cast("double").alias("x"))
    one = linalg.syr(_square(spark, d), x, 0.5, upper=True).withColumn("kind", F.lit("rank one"))
    two = linalg.syr(_square(spark, d), x, 0.25, upper=False, y=y).withColumn("kind", F.lit("rank two"))
    return one.unionByName(two).select("kind", "i0", "i1", _r("v").alias("v"))


@query(f"with s as {_SQUARE}, m as (select a.i0, b.i1, 0.5 * sum(a.v * b.v) as v from s a join s b on a.i1 = b.i0 group by all), u as (select * from m union all select i0, i1, 2.0 * v from s) select i0, i1, sum(v)::double as v from u group by all")
def gemm_into(spark, d):
    return linalg.matmul_add(_square(spark, d), _square(spark, d), _square(spark, d), 0.5, 2.0)


_CODES = "(select vec_id as i0, generate_subscripts(embedding, 1) - 1 as i1, greatest(0, least(255, round((unnest(embedding)::double + 1) * 100)))::bigint as q from embeddings)"


@query(f"select a.i0, c as i1, sum((q - 100) * ((i1 * 7 + c * 3) % 17 - 8))::bigint as v, round(sum((q - 100) * ((i1 * 7 + c * 3) % 17 - 8)) * 0.005::double, 6) + 0.0 as scaled from {_CODES} a, range(3) t(c) group by all")
def int8_matmul(spark, d):
    """8-bit codes with a zero point of 100 times 8-bit weights, exactly and scaled."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((F.col("v") + 1) * 100)))
    a = _long(spark, d).withColumn("v", q)
    b = spark.range(64 * 3).select(F.floor(F.col("id") / 3).alias("i0"), (F.col("id") % 3).alias("i1")).withColumn("v", (F.col("i0") * 7 + F.col("i1") * 3) % 17 - 8)
    exact, scaled = linalg.int8_matmul(a, b, 100), linalg.int8_matmul(a, b, 100, 0.005)
    return exact.join(scaled.select("i0", "i1", _r("v").alias("scaled")), ["i0", "i1"])


_BF = "case when v = 0 then 0 else round_even(v / pow(2.0, floor(log2(abs(v))) - 7), 0) * pow(2.0, floor(log2(abs(v))) - 7) end"


@query(f"select i0, c as i1, round(sum({_BF} * (i1 - 30) * (c + 1) / 64), 5) + 0.0 as v from {_LONG}, range(2) t(c) group by all")
def bf16_matmul(spark, d):
    """Factors rounded to bfloat16, sums in full precision."""
    e = table(spark, d, "embeddings").select("vec_id", halves.bf16_round_trip("embedding").alias("w"))
    a = e.select(F.col("vec_id").alias("i0"), F.posexplode(F.col("w").cast("array<double>")).alias("i1", "v"))
    b = spark.range(128).select(F.floor(F.col("id") / 2).alias("i0"), (F.col("id") % 2).alias("i1")).withColumn("v", (F.col("i0") - 30) * (F.col("i1") + 1) / 64)
    return linalg.matmul(a, b).withColumn("v", _r("v", 5))


@query("""select vec_id, f as frame, list_transform(range(9), lambda k: round(sqrt(pow(list_sum(list_transform(range(16), lambda t: embedding[f * 8 + t + 1]::double * 0.5 * (1 - cos(2 * pi() * t / 16)) * cos(2 * pi() * k * t / 16))), 2) + pow(list_sum(list_transform(range(16), lambda t: embedding[f * 8 + t + 1]::double * 0.5 * (1 - cos(2 * pi() * t / 16)) * sin(2 * pi() * k * t / 16))), 2)), 5) + 0.0) as v from embeddings, range(7) t(f)""")
def stft_magnitude(spark, d):
    s = signals.stft_magnitude(table(spark, d, "embeddings"), "vec_id", "embedding", 16, 8)
    return s.select("vec_id", "frame", F.transform("v", lambda x: _r(x, 5)).alias("v"))


@query("""select vec_id, f as frame, list_transform(range(8), lambda k: round(list_sum(list_transform(range(16), lambda t: embedding[f * 8 + t + 1]::double * sin(pi() * (t + 0.5) / 16) * cos(pi() / 8 * (t + 4.5) * (k + 0.5)))), 5) + 0.0) as v from embeddings, range(7) t(f)""")
def mdct(spark, d):
    s = signals.mdct(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return s.select("vec_id", "frame", F.transform("v", lambda x: _r(x, 5)).alias("v"))


@query("select vec_id, 16000::bigint as rate, 64::bigint as samples, 172 as bytes from embeddings")
def wav_files(spark, d):
    w = signals.wav_bytes(table(spark, d, "embeddings"), "vec_id", "embedding", 16_000)
    return w.select("vec_id", signals.wav_header(F.col("wav")).alias("h"), F.length("wav").alias("bytes")).select("vec_id", "h.*", "bytes")


@query("""with r as (select label, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 as i from embeddings), k as (select embedding as q from embeddings where vec_id = 0)
 select label, (i // 2)::bigint as i, (64 - h)::bigint as alike, round(2.0 * (64 - h) / 64 - 1, 6)::double as score from (select label, i, list_sum(list_transform(list_zip(embedding, q), lambda z: ((z[1] > 0) <> (z[2] > 0))::int)) as h from r, k where i % 2 = 0)""")
def binary_convolution(spark, d):
    p = _prints(spark, d).withColumn("w", F.array("fp"))
    kernel = F.array(F.lit(p.where("vec_id = 0").first()["fp"]))
    return signals.binary_conv1d(p, ["label"], "vec_id", "w", kernel, 64, 2).withColumn("score", _r("score"))


@query("""with p as (select vec_id, (generate_subscripts(embedding, 1) - 1) // 8 as i0, (generate_subscripts(embedding, 1) - 1) % 8 as i1, unnest(embedding)::double as v from embeddings)
 select a.vec_id, a.i0, a.i1, (any_value(a.v) < avg(b.v) - 0.05)::int as bit from p a join p b on a.vec_id = b.vec_id and abs(a.i0 - b.i0) <= 1 and abs(a.i1 - b.i1) <= 1 group by all""")
def adaptive_threshold(spark, d):
    a = _long(spark, d)
    image = a.select(F.col("i0").alias("vec_id"), F.floor(F.col("i1") / 8).cast("bigint").alias("i0"), (F.col("i1") % 8).cast("bigint").alias("i1"), "v")
    return signals.adaptive_binarize(image, ["vec_id"], 3, 0.05).drop("v")


@query("""with b as (select label, vec_id, generate_subscripts(embedding, 1) - 1 as i, case when unnest(embedding) > 0 then 1 else -1 end as b from embeddings), t as (select label, i, sum(case when vec_id % 4 = 1 then 0 else b end) as t from b group by all) select label, list((t > 0)::int order by i) as bits, sum(t)::bigint as total from t group by 1""")
def tally_with_takeback(spark, d):
    """Every print is added to its label's tally; the prints of every fourth row are taken back."""
    p = _prints(spark, d).select("label", "vec_id", "fp", F.explode(F.when(F.col("vec_id") % 4 == 1, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))).alias("sign"))
    t = signals.tally(p, ["label"], "fp", F.col("sign"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("w"), i).bitwiseAND(F.lit(1)).cast("int"))
    total = sum((F.col(f"t{i}") for i in range(1, 64)), F.col("t0")).cast("bigint")
    return t.select("label", signals.tally_word().alias("w"), total.alias("total")).select("label", bits.alias("bits"), "total")


@query("""with recursive h as (select user_id, row_number() over (partition by user_id order by event_id) as i, (value::bigint % 41) - 17 as x from events), r as (select user_id, i, greatest(-128, least(127, x)) as s from h where i = 1 union all select r.user_id, h.i, greatest(-128, least(127, r.s + h.x)) from r join h on h.user_id = r.user_id and h.i = r.i + 1)
 select user_id, arg_max(s, i)::int as total from r group by 1""".replace("(value::bigint % 41)", "(floor(abs(value))::bigint % 41)"))
def saturating_evidence(spark, d):
    """Sums held within 8 bits after every event, in order; a user's history is one row here."""
    x = (F.floor(F.abs("value")).cast("int") % 41 - 17).alias("x")
    e = table(spark, d, "events").select("user_id", "event_id", x)
    h = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda r: r["x"]).alias("h"))
    return h.select("user_id", signals.saturating_sum(F.col("h")).alias("total"))


@query("""select label, arg_max(vec_id, (s, -vec_id)) as vec_id, round(max(s), 6)::double as score from (select b.label, b.vec_id, 2.0 * (64 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::int))) / 64 - 1 as s from embeddings a, embeddings b where a.vec_id = 7) group by 1""")
def winning_neuron(spark, d):
    p = _prints(spark, d)
    q = F.lit(p.where("vec_id = 7").first()["fp"])
    s = p.select("label", "vec_id", (2 * (64 - V.hamming(F.col("fp"), q)) / 64 - 1).alias("score"))
    return signals.winner(s, ["label"], "vec_id", "score").withColumn("score", _r("score"))

