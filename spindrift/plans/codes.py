"""Queries on bit vectors, byte codes, half floats, files and scan specifications."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spindrift.functions import bits, halves
from spindrift.functions import vectors as V
from spindrift.operators import search

from .numeric import _r
from .registry import query, table
from .search import _first, _H, _prints
from .spec import ScanSpec

_BYTES = "list_transform(embedding, lambda x: (floor(abs(x) * 255)::int % 256))"


def _bytes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x) * 255).cast("int") % 256)).alias("b"))


@query(f"select vec_id, list_transform(list_zip({_BYTES}, list_reverse({_BYTES})), lambda z: (z[1] + z[2]) % 256) as bound, {_BYTES} as back from embeddings")
def phase_bind(spark, d):
    b = _bytes(spark, d).withColumn("k", F.reverse("b")).withColumn("bound", bits.phase_bind(F.col("b"), F.col("k")))
    return b.select("vec_id", "bound", bits.phase_unbind(F.col("bound"), F.col("k")).alias("back"))


@query(f"with b as (select vec_id, {_BYTES} as b from embeddings) select x.vec_id, list_sum(list_transform(list_zip(x.b, y.b), lambda z: least(abs(z[1] - z[2]), 256 - abs(z[1] - z[2]))))::bigint as circular, list_sum(list_transform(list_zip(list_sort(x.b), list_sort(y.b)), lambda z: abs(z[1] - z[2])))::bigint as w1 from b x, b y where y.vec_id = 0")
def byte_distances(spark, d):
    b = _bytes(spark, d)
    q = F.array(*[F.lit(x) for x in _first(b, "b")])
    return b.select("vec_id", bits.circular_distance(F.col("b"), q).alias("circular"), bits.wasserstein(F.col("b"), q).alias("w1"))


@query(f"with b as (select vec_id, {_BYTES} as b from embeddings) select vec_id, list_filter(list_transform(range(64), lambda i: case when b[i + 1] = 0 then i::int end), lambda i: i is not null) as zeros, len(list_filter(b, lambda x: x = 0))::bigint as n from b")
def byte_find(spark, d):
    return _bytes(spark, d).select("vec_id", bits.find_all(F.col("b"), 0).alias("zeros"), F.size(F.filter("b", lambda x: x == 0)).cast("bigint").alias("n"))


@query(f"with b as (select vec_id, list_transform({_BYTES}, lambda x: x % 16) as c from embeddings) select vec_id, list_transform(range(32), lambda i: c[2 * i + 1] + 16 * c[2 * i + 2]) as packed, c as back from b")
def nibbles(spark, d):
    b = _bytes(spark, d).select("vec_id", F.transform("b", lambda x: x % 16).alias("c")).withColumn("packed", bits.nibble_pack(F.col("c")))
    return b.select("vec_id", "packed", bits.nibble_unpack(F.col("packed"), F.size("c")).alias("back"))


@query("select vec_id, list_transform(range(64), lambda i: (embedding[((i - 7 + 64) % 64) + 1] > 0)::int) as turned, list_transform(embedding, lambda x: (x > 0)::int) as back, list_sum(list_transform(embedding, lambda x: (x > 0)::int))::bigint as ones from embeddings")
def rotate_bits(spark, d):
    p = _prints(spark, d).select("vec_id", F.array("fp").alias("w"))
    unpack = lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.get(w, 0), i).bitwiseAND(F.lit(1)).cast("int"))
    p = p.withColumn("t", bits.rotate(F.col("w"), 1, 7))
    return p.select("vec_id", unpack(F.col("t")).alias("turned"), unpack(bits.rotate(F.col("t"), 1, -7)).alias("back"), bits.popcount(F.col("t")).alias("ones"))


@query(f"select b.vec_id, {_H} as apart, (64 - {_H}) as alike, round(1 - {_H} / 64.0, 6)::double as similarity, round(2.0 * (64 - {_H}) / 64 - 1, 6)::double as score from embeddings a, embeddings b where a.vec_id = 0")
def binary_dot(spark, d):
    p = _prints(spark, d)
    apart = V.hamming(F.col("fp"), F.lit(_first(p, "fp")))
    return p.select("vec_id", apart.alias("apart"), (64 - apart).alias("alike"), _r(1 - apart / 64).alias("similarity"), _r(2 * (64 - apart) / 64 - 1).alias("score"))


@query("select label, i::bigint as i, list_sum(list_transform(l, lambda x: x))::bigint // len(l) as mean from (select label, i, list(b) as l from (select label, generate_subscripts(embedding, 1) - 1 as i, (floor(abs(unnest(embedding)) * 255)::int % 256) as b from embeddings) group by all)")
def integer_bundle(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda x: F.floor(F.abs(x) * 255).cast("int") % 256)).alias("i", "b"))
    return e.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(F.floor(F.sum("b") / F.count("*")).cast("bigint").alias("mean"))


@query("select label, i::bigint as i, round(atan2(sum(sin(b * pi() / 128)), sum(cos(b * pi() / 128))), 5) + 0.0 as phase from (select label, generate_subscripts(embedding, 1) - 1 as i, (floor(abs(unnest(embedding)) * 255)::int % 256) as b from embeddings) group by all")
def circular_bundle(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda x: F.floor(F.abs(x) * 255).cast("int") % 256)).alias("i", "b"))
    angle = F.col("b") * F.pi() / 128
    return e.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(_r(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))), 5).alias("phase"))


@query("select b // 16 as bin, count(*) as n from (select (floor(abs(unnest(embedding)) * 255)::int % 256) as b from embeddings) group by 1")
def histogram_16(spark, d):
    b = _bytes(spark, d).select(F.explode("b").alias("b"))
    return b.groupBy(F.floor(F.col("b") / 16).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_UNIT = "pow(2.0, floor(log2(abs(x::double))) - 7)"


@query(f"""select vec_id, list_transform(embedding, lambda x: case when x = 0 then 0.0::double else round_even(x::double / {_UNIT}, 0) * {_UNIT} end) as rounded,
 list_transform(embedding, lambda x: case when x = 0 then 0.0::double else trunc(x::double / {_UNIT}) * {_UNIT} end) as cut from embeddings""")
def bf16_round_trip(spark, d):
    """The numbers as bfloat16 holds them: eight significant bits."""
    both = [halves.bf16_round_trip("embedding", r).cast("array<double>").alias(n) for n, r in (("rounded", True), ("cut", False))]
    return table(spark, d, "embeddings").select("vec_id", *both)


_ANGLE = "(vec_id % 50 * pow(10000.0::double, -2.0 * (i // 2) / 64))"


@query(f"""select vec_id, list_transform(range(64), lambda i: round(case when i % 2 = 0 then embedding[i + 1]::double * cos{_ANGLE} - embedding[i + 2]::double * sin{_ANGLE}
 else embedding[i]::double * sin{_ANGLE} + embedding[i + 1]::double * cos{_ANGLE} end, 4) + 0.0) as v from embeddings""")
def rope(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", halves.rope(F.col("embedding"), F.col("vec_id") % 50).alias("v")).select("vec_id", F.transform("v", lambda x: _r(x, 4)).alias("v"))


@query(f"select b.vec_id, {_H} as d from embeddings a, embeddings b where a.vec_id = 0 and b.label <> 3 and {_H} <= 30 order by d, b.vec_id limit 12")
def scan_spec(spark, d):
    spec = {"version": 1, "kernel": "hamming", "scan": {"threshold": 30, "top_k": 12}, "pipeline": [{"stage": "filter", "where": "label <> 3"}]}
    p = _prints(spark, d)
    return ScanSpec.parse(json.dumps(spec)).apply(p, "vec_id", "fp", _first(p, "fp"))


@query(f"""with v as (select label, generate_subscripts(embedding, 1) as i, (unnest(embedding) > 0)::int as bit from embeddings), m as (select label, i, (sum(bit) > count(*) // 2)::int as bit from v group by all), p as (select label as "of", list(bit order by i) as bits from m group by 1)
 select vec_id, label, "of", d from (select vec_id, label, "of", d, row_number() over (partition by vec_id, label order by d, "of" nulls first) as rn from (select vec_id, label, "of", list_sum(list_transform(list_zip(embedding, bits), lambda z: ((z[1] > 0) <> (z[2] = 1))::int))::bigint as d from embeddings, p)) where rn = 1""")
def prototype_lookup(spark, d):
    """Every print cleaned to the nearest of all labels' majority prints, ties to the first label. The least pair is kept
    per task before the shuffle."""
    p = _prints(spark, d)
    m = search.majority(p, ["label"]).select(F.col("label").alias("of"), "majority")
    pairs = search.pair_with(p, m).select("vec_id", "label", F.struct(V.hamming(F.col("fp"), F.col("majority")).alias("d"), "of").alias("near"))
    return pairs.groupBy("vec_id", "label").agg(F.min("near").alias("near")).select("vec_id", "label", "near.of", "near.d")


@query(f"""with v as (select label, generate_subscripts(embedding, 1) as i, (unnest(embedding) > 0)::int as bit from embeddings), m as (select label, i, (sum(bit) > count(*) // 2)::int as bit from v group by all), p as (select label as "of", list(bit order by i) as bits from m group by 1),
 d as (select label, vec_id, "of", list_sum(list_transform(list_zip(embedding, bits), lambda z: ((z[1] > 0) <> (z[2] = 1))::int)) as d from embeddings, p), n as (select label, "of", d from d qualify row_number() over (partition by vec_id, label order by d, "of" nulls first) = 1)
 select label, "of", count(*) as n, sum(d)::bigint as d from n group by all""")
def nearest_prototype(spark, d):
    """Which label's majority print is nearest to the prints of each label: a confusion table with the distances' sums."""
    near = prototype_lookup(spark, d)
    return near.groupBy("label", "of").agg(F.count("*").alias("n"), F.sum("d").alias("d"))


@query("select event_type, round(avg(value), 4) as mean, count(*) as n, round(exp(-min(2592000 - date_diff('second', timestamp '2024-01-01', ts)) / 3600.0), 9) as recency from events group by 1")
def recency(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return e.groupBy("event_type").agg(_r(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"), _r(F.exp(-F.min(F.lit(2592000) - seconds) / 3600.0), 9).alias("recency"))


@query(f"""select b.vec_id, {_H} as d, case when {_H} <= 8 then 'Foveal' when {_H} <= 16 then 'Near' when {_H} <= 24 then 'Good' when {_H} <= 32 then 'Weak' else 'Reject' end as band, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::double - z[2]::double))), 5) as l1,
 round(1 / (1 + exp(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)))), 6) as affinity, (b.vec_id + 7) // 2 as revised, (b.vec_id // 4) % 8 as field from embeddings a, embeddings b where a.vec_id = 0""")
def sql_functions(spark, d):
    from spindrift.functions import sql

    sql.register(spark)
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), V.sign_word(F.col("embedding")).alias("fp"))
    q = p.where("vec_id = 0").first()
    vector = F.array(*[F.lit(x) for x in q["v"]])
    p = p.select("vec_id", "v", vector.alias("q"), F.call_function("sp_hamming", F.col("fp"), F.lit(q["fp"])).alias("d"))
    return p.selectExpr("vec_id", "d", "sp_band(d, 32L) as band", "round(sp_l1(v, q), 5) as l1", "round(sp_sigmoid(sp_dot(v, q)), 6) as affinity", "sp_revise(vec_id, 7L) as revised", "sp_field(vec_id, 2, 3) as field")
