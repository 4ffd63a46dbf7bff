"""Queries on quantised vectors, 17-number codes and palettes, packed codes, bytes, edges and planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import bits, palette
from spindrift.functions import vectors as V
from spindrift.operators import search, spo, truth

from .codes import _BYTES, _bytes
from .numeric import _r
from .registry import query, table
from .search import _BYTES as _EDGE_BYTES
from .search import _S, _edges, _first, _prints

_TOP = "list_max(list_transform(embedding, lambda x: abs(x::double)))"


@query(f"""with q as (select vec_id, embedding::double[] as e, {_TOP} as top from embeddings) select vec_id, list_transform(e, lambda x: round(round(x / (top / 127)) * (top / 127), 6) + 0.0) as i8, list_transform(e, lambda x: round(greatest(-8, least(7, round(x / (top / 7)))) * (top / 7), 6) + 0.0) as i4,
 list_transform(e, lambda x: round(round(x / top) * top, 6) + 0.0) as i2, list_transform(range(32), lambda i: ((round(e[2 * i + 1] / (top / 7))::int + 16) % 16 + 16 * ((round(e[2 * i + 2] / (top / 7))::int + 16) % 16))) as i4_bytes,
 list_transform(range(16), lambda i: (round(e[4 * i + 1] / top)::int + 1 + 4 * (round(e[4 * i + 2] / top)::int + 1) + 16 * (round(e[4 * i + 3] / top)::int + 1) + 64 * (round(e[4 * i + 4] / top)::int + 1))) as i2_bytes from q""")
def dequantize(spark, d):
    """Vectors from their 8-, 4- and 2-bit codes, the latter two by way of packed bytes."""
    e = table(spark, d, "embeddings").select("vec_id", V.quantize_i8(F.col("embedding")).alias("a"), V.quantize_i4(F.col("embedding")).alias("b"), V.quantize_i2(F.col("embedding")).alias("c"))
    e = e.select("*", V.pack_i4(F.col("b.codes")).alias("i4_bytes"), V.pack_i2(F.col("c.codes")).alias("i2_bytes"))
    r6 = lambda v: F.transform(v, lambda x: _r(x))
    return e.select(
        "vec_id", r6(V.dequantize(F.col("a.codes"), F.col("a.scale"))).alias("i8"), r6(V.dequantize(V.unpack_i4(F.col("i4_bytes"), 64), F.col("b.scale"))).alias("i4"),
        r6(V.dequantize(V.unpack_i2(F.col("i2_bytes"), 64), F.col("c.scale"))).alias("i2"), "i4_bytes", "i2_bytes",
    )


@query("""with r as (select vec_id, i, list_transform(range(16), lambda j: embedding[16 * i + j + 1]::double) as e from embeddings, range(4) t(i)), s as (select *, list_max(list_transform(e, lambda x: abs(x))) / 127 as s from r)
 select vec_id, i as channel, round(s, 9) as scale, list_transform(e, lambda x: round(x / s)::int) as codes from s""")
def quantize_channels(spark, d):
    """Every channel of 16 numbers with a scale of its own."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))).alias("channel", "e"))
    q = rows.select("vec_id", F.col("channel").cast("bigint").alias("channel"), V.quantize_i8(F.col("e")).alias("q"))
    return q.select("vec_id", "channel", _r("q.scale", 9).alias("scale"), "q.codes")


_CODE = "list_transform(range(17), lambda b: round(list_avg(list_transform(list_filter(range(64), lambda i: i % 17 = (b * 11) % 17), lambda i: embedding[i + 1]::double)) * 256)::int)"
_C = f"(select vec_id, {_CODE} as c from embeddings)"
_GAP = "list_sum(list_transform(list_zip(a.c, b.c), lambda z: abs(z[1] - z[2])))::bigint"


def _codes17(spark, d):
    return table(spark, d, "embeddings").select("vec_id", palette.project(F.col("embedding").cast("array<double>")).alias("c"))


@query(f"""select a.vec_id, a.c as code, {_GAP} as l1, list_sum(list_transform(range(17), lambda i: abs(a.c[i + 1] - b.c[i + 1]) * case when i = 0 then 20 when i < 7 then 3 else 1 end))::bigint as weighted, list_sum(list_transform(list_zip(a.c, b.c), lambda z: ((z[1] >= 0) = (z[2] >= 0))::int))::bigint as signs, true as triangle
 from {_C} a, {_C} b where b.vec_id = 0""")
def base17_codes(spark, d):
    """17-number codes of all vectors, three distances to the first one's, and the triangle inequality by way of the reversed code."""
    c = _codes17(spark, d)
    q = F.array(*[F.lit(x) for x in _first(c, "c")])
    a = F.col("c")
    return c.select("vec_id", a.alias("code"), palette.l1(a, q).alias("l1"), palette.l1_weighted(a, q).alias("weighted"), palette.sign_agreement(a, q).alias("signs"), palette.triangle_holds(a, F.reverse(a), q).alias("triangle"))


_PAL = f"(select vec_id as k, c from {_C} where vec_id < 16)"
_NEAR = f"(select a.vec_id, b.k, {_GAP} as d from {_C} a, {_PAL} b qualify row_number() over (partition by a.vec_id order by {_GAP}, b.k) = 1)"


def _palette(spark, d):
    """The codes of the first 16 vectors, in order."""
    return [r["c"] for r in _codes17(spark, d).where("vec_id < 16").orderBy("vec_id").collect()]


@query(f"""with n as {_NEAR}, t as (select a.k as x, b.k as y, ({_GAP} * 65535) // 1114095 as v from {_PAL} a, {_PAL} b), q as (select k from n where vec_id = 3) select n.vec_id, n.k::int as entry, n.d as gap, t.v as d from n, q join t on t.x = q.k where t.y = n.k order by t.v, n.vec_id limit 20""")
def palette_topk(spark, d):
    """Every vector's nearest palette entry, and the 20 rows nearest to row 3 by the table of distances between entries."""
    entries = _palette(spark, d)
    c = _codes17(spark, d).withColumn("entry", palette.nearest(F.col("c"), entries))
    gap = palette.l1(F.col("c"), F.get(F.array(*[F.array(*[F.lit(x) for x in e]) for e in entries]), F.col("entry")))
    q = c.where("vec_id = 3").first()["entry"]
    near = c.select("vec_id", "entry", gap.alias("gap"), palette.table_distance(palette.distance_table(entries), F.lit(q), F.col("entry")).alias("d"))
    return search.top_k(near, "d", "vec_id", 20)


@query(f"""with t as (select a.k as x, b.k as y, ({_GAP} * 65535) // 1114095 as v from {_PAL} a, {_PAL} b), e as (select o_orderkey, o_orderkey % 16 as s, o_custkey % 16 as p, (o_orderkey * 7 + o_custkey) % 16 as o from orders) select o_orderkey, (a.v + b.v + c.v)::bigint as d from e, t a, t b, t c where a.x = 1 and a.y = s and b.x = 2 and b.y = p and c.x = 3 and c.y = o""")
def spo_table_distance(spark, d):
    tables = [palette.distance_table(_palette(spark, d))] * 3
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    edge = [(x % 16).cast("int") for x in (k, c, k * 7 + c)]
    return table(spark, d, "orders").select("o_orderkey", palette.spo_distance(tables, [F.lit(1), F.lit(2), F.lit(3)], edge).alias("d"))


@query()
def palette_fit(spark, d):
    """A palette fitted on a sample: how far codes are from their nearest entry, and how many entries are used."""
    c = _codes17(spark, d)
    entries = palette.build_palette(c, "c", 32)
    near = c.withColumn("entry", palette.nearest(F.col("c"), entries))
    gap = palette.l1(F.col("c"), F.get(F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in entries]), F.col("entry")))
    return near.agg(F.countDistinct("entry").alias("entries"), _r(F.avg(gap)).alias("mean_gap"), F.max(gap).alias("widest"))


@query(f"""with b as (select vec_id, list_transform({_BYTES}, lambda x: (x % 32)) as c from embeddings) select vec_id, c as codes, list_transform(range(6), lambda w: list_reduce(list_prepend(0::ubigint, list_transform(range(least(12, 64 - 12 * w)), lambda j: (c[12 * w + j + 1]::ubigint << (5 * j)::ubigint))), lambda a, x: a + x)::varchar) as five,
 list_transform(range(8), lambda w: list_reduce(list_prepend(0::ubigint, list_transform(range(8), lambda j: (c[8 * w + j + 1]::ubigint << (8 * j)::ubigint))), lambda a, x: a + x)::varchar) as eight from b""")
def pack_indices(spark, d):
    """Codes of 5 bits in words of 64, and the same words transcoded to 8 bits."""
    b = _bytes(spark, d).select("vec_id", F.transform("b", lambda x: x % 32).alias("c"))
    five = bits.pack_indices(F.col("c"), 5)
    b = b.withColumn("five", five).withColumn("eight", bits.transcode(F.col("five"), 5, 8, F.lit(64)))
    shown = lambda c: F.transform(c, lambda w: F.conv(F.hex(w), 16, 10))
    return b.select("vec_id", bits.unpack_indices(F.col("eight"), 8, F.lit(64)).alias("codes"), shown("five").alias("five"), shown("eight").alias("eight"))


@query(f"""with b as (select vec_id, {_BYTES} as b from embeddings), n as (select vec_id, b, list_transform(range(64), lambda i: case when i % 2 = 0 then b[i // 2 + 1] % 16 else b[i // 2 + 1] // 16 end) as n from b)
 select vec_id, list_transform(range(32), lambda i: greatest(n[2 * i + 1] - 3, 0) + 16 * greatest(n[2 * i + 2] - 3, 0)) as less, list_filter(range(64)::int[], lambda i: n[i + 1] > 9) as above, list_transform(b, lambda x: (256 - x) % 256) as inverse, list_filter(range(63)::int[], lambda i: b[i + 1] = b[1] and b[i + 2] = b[2]) as pairs,
 case when list_position(b, 0) > 0 then (list_position(b, 0) - 1)::int end as first_zero, list_sum(list_transform(list_zip(list_sort(list_transform(b, lambda x: case when x > 127 then x - 256 else x end)), list_sort(list_transform(list_reverse(b), lambda x: (case when x > 127 then x - 256 else x end) + 5))), lambda z: abs(z[1] - z[2])))::bigint as signed_w1 from n""")
def byte_work(spark, d):
    b = _bytes(spark, d).withColumn("half", F.slice("b", 1, 32))
    pair = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: (F.get("b", i) == F.get("b", 0)) & (F.get("b", i + 1) == F.get("b", 1)))
    signed = bits.signed_bytes(F.col("b"))
    return b.select(
        "vec_id", bits.nibbles_less(F.col("half"), 3).alias("less"), bits.nibbles_above(F.col("half"), 9).alias("above"), bits.phase_inverse(F.col("b")).alias("inverse"), pair.alias("pairs"),
        bits.find_first(F.col("b"), 0).cast("int").alias("first_zero"), bits.wasserstein(signed, F.transform(F.reverse(signed), lambda x: x + 5)).alias("signed_w1"),
    )


@query(f"with b as (select vec_id, {_BYTES} as b from embeddings) select vec_id, list_filter(range(63)::int[], lambda i: b[i + 1] = 18 and b[i + 2] = 52) as at, list_sum(list_transform(b, lambda x: bit_count(x & 85)))::bigint as masked from b")
def byte_patterns(spark, d):
    """Places of the pattern 0x1234, and set bits under the mask 0x55 of every byte."""
    b = _bytes(spark, d)
    return b.select("vec_id", bits.find_pairs(F.col("b"), 0x1234).alias("at"), bits.masked_popcount(F.transform("b", lambda x: x.cast("bigint")), F.lit(0x55).cast("bigint")).alias("masked"))


_E = f"(select o_orderkey, {', '.join(f'({b})::bigint as b{i}' for i, b in enumerate(_EDGE_BYTES))} from {_S})"


@query(f"""with e as {_E}, q as (select * from e order by o_orderkey limit 1) select e.o_orderkey, e.b3 as third, bit_count(xor(e.b0, q.b0))::bigint as scent_hamming, abs(e.b0 - q.b0) + abs(e.b1 - q.b1) + abs(e.b2 - q.b2) as progressive, (e.b0 | 128) as signed, e.b0 as plain,
 (not (e.o_orderkey % 128 & 8) > 0 or ((e.o_orderkey % 128 & 1) > 0 and (e.o_orderkey % 128 & 2) > 0)) and (not (e.o_orderkey % 128 & 16) > 0 or ((e.o_orderkey % 128 & 1) > 0 and (e.o_orderkey % 128 & 4) > 0)) and (not (e.o_orderkey % 128 & 32) > 0 or ((e.o_orderkey % 128 & 2) > 0 and (e.o_orderkey % 128 & 4) > 0)) and (not (e.o_orderkey % 128 & 64) > 0 or (e.o_orderkey % 128 & 56) = 56) as legal from e, q""")
def edge_bytes(spark, d):
    e = _edges(spark, d)
    q = F.lit(e.orderBy("o_orderkey").first()["code"])
    c = F.col("code")
    signed = spo.with_sign(c, F.lit(True))
    return e.select("o_orderkey", spo.byte_of(c, 3).alias("third"), spo.scent_hamming(c, q).alias("scent_hamming"), spo.code_distance(c, q, 2).alias("progressive"), spo.byte_of(signed, 0).alias("signed"), spo.byte_of(spo.with_sign(signed, F.lit(False)), 0).alias("plain"), spo.is_legal_scent(F.col("o_orderkey") % 128).alias("legal"))


@query("""with e as (select o_orderkey, o_orderkey % 64 as block, o_custkey % 16 as projection, o_orderkey % 3 as verb, o_custkey % 65536 as row, least(65535, floor(o_totalprice))::bigint as l1, round((o_orderkey % 100) / 99.0::double * 1023)::bigint as f, round((o_custkey % 50) / 49.0::double * 1023)::bigint as c from orders)
 select o_orderkey, block, projection, verb, row, l1, round(f / 1023.0::double, 9) as f, round(c / 1023.0::double, 9) as c, (block::hugeint * 288230376151711744 + projection::hugeint * 18014398509481984 + verb::hugeint * 4503599627370496 + row::hugeint * 68719476736 + l1::hugeint * 1048576 + f::hugeint * 1024 + c)::varchar as word from e""")
def weight_edges(spark, d):
    """Edges packed into one word of seven fields, shown as an unsigned number, and the fields read back."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = {"block": k % 64, "projection": c % 16, "verb": k % 3, "row": c % 65536, "l1": F.floor("o_totalprice"), "f": (k % 100) / 99, "c": (c % 50) / 49}
    w = table(spark, d, "orders").select("o_orderkey", spo.pack_weight_edge(fields).alias("w"))
    back = spo.unpack_weight_edge(F.col("w"))
    return w.select("o_orderkey", *[(_r(v, 9) if n in ("f", "c") else v).alias(n) for n, v in back.items()], F.conv(F.hex("w"), 16, 10).alias("word"))


@query("""with t as (select label, count(*) as n, sum(vec_id % 50 + 1) as e, sum((vec_id * 37 % 65536) * (vec_id % 50 + 1)) as f, sum((vec_id * 91 % 65536) * (vec_id % 50 + 1)) as c from embeddings group by 1) select label, (f // e)::bigint as f, (c // e)::bigint as c, e::bigint as evidence,
 greatest(0, least(65535, trunc((c // e) * ((f // e) - 32768) / 65535.0) + 32768))::bigint as expectation from t""")
def evidence_revision(spark, d):
    """Fixed-point truths of a label weighted by their evidence, and the expectation of the outcome."""
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select("label", (v * 37 % 65536).alias("f"), (v * 91 % 65536).alias("c"), (v % 50 + 1).alias("evidence"))
    r = truth.evidence_revision(e, ["label"])
    return r.withColumn("expectation", truth.plane_expectation(F.col("f"), F.col("c")))


@query("""with b as (select vec_id, i, embedding[i + 1] > 0 as up, abs(embedding[i + 1]) > 0.12 as known from embeddings, range(64) t(i)), p as (select vec_id, sum((known)::int) as known, sum((known and up)::int) as pos from b group by 1) select vec_id, case when known = 0 then 32768 else pos * 65535 // known end::bigint as f, (known * 65535 // 64)::bigint as c, (vec_id % 9)::bigint as evidence from p""")
def plane_truths(spark, d):
    mask = F.aggregate(F.transform("embedding", lambda x, i: F.when(F.abs(x) > F.lit(0.12), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    e = table(spark, d, "embeddings").select("vec_id", V.sign_word(F.col("embedding")).alias("fp"), mask.alias("mask"))
    return e.select("vec_id", truth.plane_truth(F.col("fp"), F.col("mask"), 64, F.col("vec_id") % 9).alias("t")).select("vec_id", "t.*")


@query("""with p as (select vec_id, [list_sum(list_transform(range(64), lambda i: ((embedding[i + 1] > 0) <> (q[i + 1] > 0) and i % 3 = k)::int)) for k in [0, 1, 2]] as d from embeddings, (select embedding as q from embeddings where vec_id = 0)), x as (select vec_id, d[1] as s, d[2] as p, d[3] as o from p)
 select vec_id, list_transform([[s, 22, 42], [p, 21, 43], [o, 21, 43], [s + p, 43, 85], [s + o, 43, 85], [p + o, 42, 86], [s + p + o, 64, 128]], lambda z: round((z[1] + z[3])::double / (z[2] + z[3]), 6)) as normalized from x""")
def plane_projections(spark, d):
    """Distances in all seven choices of three planes, each of which knows every third bit."""
    e = _prints(spark, d)
    q = F.lit(_first(e, "fp"))
    masks = [F.lit(sum(1 << i for i in range(64) if i % 3 == k) - (1 << 64 if k == 63 % 3 else 0)).cast("bigint") for k in range(3)]
    planes = [spo.plane_distance(F.col("fp"), m, q, m) for m in masks]
    return e.select("vec_id", F.transform(spo.project_all(*planes), lambda x: _r(spo.normalized(x))).alias("normalized"))
