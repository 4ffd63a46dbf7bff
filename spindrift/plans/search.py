"""Queries on fingerprints, similarity search, masks, space, truth values and snapshots."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import blockwise, search, spatial, spo, truth

from .numeric import _r
from .registry import query, table

_H = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::int))::bigint"
_H2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > 0) and (z[2] > 0))::int))::bigint"
_ONES = "list_sum(list_transform({0}.embedding, lambda x: (x > 0)::int))::bigint"
_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


def _prints(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", V.sign_word(F.col("embedding")).alias("fp"))


def _queries(frame, **names):
    """The query set of searches: every row whose id is divisible by 100."""
    return frame.where(F.col("vec_id") % 100 == 0).select(*[F.col(c).alias(n) for n, c in names.items()])


def _first(frame, column):
    return frame.where("vec_id = 0").select(column).first()[0]


@query(f"select b.vec_id, {_H} as d from embeddings a, embeddings b where a.vec_id = 0 order by d, b.vec_id limit 10")
def hamming_topk(spark, d):
    p = _prints(spark, d)
    return search.hamming_top_k(p, _first(p, "fp"), 10)


@query(f"select q as query_id, vec_id, dist as d, rn as rank from (select *, row_number() over (partition by q order by dist, vec_id) as rn from (select a.vec_id as q, b.vec_id, {_H} as dist from embeddings a, embeddings b where a.vec_id % 100 = 0)) where rn <= 10")
def hamming_knn_join(spark, d):
    p = _prints(spark, d)
    pairs = search.pair_with(p.select("vec_id", "fp"), _queries(p, query_id="vec_id", q="fp")).select("query_id", "vec_id", V.hamming(F.col("fp"), F.col("q")).alias("d"))
    return search.top_k_per(pairs, "query_id", "d", "vec_id", 10)


@query(f"select a.vec_id as query_id, b.vec_id, {_H} as d from embeddings a, embeddings b where a.vec_id % 100 = 0 and {_H} <= 20")
def hamming_radius(spark, d):
    p = _prints(spark, d)
    pairs = search.pair_with(p.select("vec_id", "fp"), _queries(p, query_id="vec_id", q="fp")).select("query_id", "vec_id", V.hamming(F.col("fp"), F.col("q")).alias("d"))
    return pairs.where("d <= 20")


@query(f"select b.vec_id, {_H} as d from embeddings a, embeddings b where a.vec_id = 0 and {_H} <= 24")
def pivot_radius(spark, d):
    p = _prints(spark, d)
    pivots = [r["fp"] for r in p.where("vec_id < 8").orderBy("vec_id").select("fp").collect()]
    return search.pivot_radius(p, _first(p, "fp"), 24, pivots)


@query(f"""select case when d <= 8 then 'Foveal' when d <= 16 then 'Near' when d <= 24 then 'Good' when d <= 32 then 'Weak' else 'Reject' end as band, count(*) as n
 from (select {_H} as d from embeddings a, embeddings b where a.vec_id = 0) group by 1""")
def cascade_bands(spark, d):
    p = _prints(spark, d)
    dist = p.select(V.hamming(F.col("fp"), F.lit(_first(p, "fp"))).alias("d"))
    return dist.groupBy(search.band(F.col("d"), 32).alias("band")).agg(F.count("*").alias("n"))


@query(f"select round(avg(d), 6) as mean, round(stddev_pop(d), 6) as deviation, floor(avg(d) + 3 * stddev_pop(d))::bigint as threshold from (select {_H} as d from embeddings a, embeddings b where a.vec_id = 0)")
def cascade_calibrate(spark, d):
    p = _prints(spark, d)
    c = search.calibrate(p.select(V.hamming(F.col("fp"), F.lit(_first(p, "fp"))).alias("d")))
    return c.select(_r("mean").alias("mean"), _r("deviation").alias("deviation"), "threshold")


@query(f"""select q as query_id, vec_id, conflict, energy_a, energy_b, agreement, case when conflict < 16 then 3 when conflict < 24 then 2 when conflict < 32 then 1 else 0 end as grade, (32 - conflict) / 4.0::double as z
 from (select a.vec_id as q, b.vec_id, {_H} as conflict, {_ONES.format('b')} as energy_a, {_ONES.format('a')} as energy_b, {_H2} as agreement from embeddings a, embeddings b where a.vec_id % 100 = 0)""")
def kernel_scores(spark, d):
    p = _prints(spark, d)
    pairs = search.pair_with(p.select("vec_id", "fp"), _queries(p, query_id="vec_id", q="fp"))
    return search.kernel_scores(pairs, "fp", "q").drop("fp", "q")


@query(f"""select label, i, (2 * sum(bit) > n)::int as bit from (select label, generate_subscripts(embedding, 1) - 1 as i, (unnest(embedding) > 0)::int as bit, count(*) over (partition by label) as n from embeddings) group by label, i, n""".replace("(2 * sum(bit) > n)", "(sum(bit) > n // 2)").replace("count(*) over (partition by label) as n from embeddings", "n from embeddings join (select label as l2, count(*) as n from embeddings group by 1) on label = l2"))
def bundle_majority(spark, d):
    m = search.majority(_prints(spark, d), ["label"])
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("majority"), i).bitwiseAND(F.lit(1)).cast("int"))
    return m.select("label", F.posexplode(bits).alias("i", "bit")).select("label", F.col("i").cast("bigint").alias("i"), "bit")


@query(f"select b.vec_id, round({_COS}, 6) as similarity from embeddings a, embeddings b where a.vec_id = 0 order by {_COS} desc, b.vec_id limit 10")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _first(e, "embedding")])
    s = e.select("vec_id", V.cosine(F.col("embedding"), q).alias("s"))
    return s.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", _r("s").alias("similarity"))


@query(f"select a.vec_id as query_id, b.vec_id, round({_COS}, 6) as similarity from embeddings a, embeddings b where a.vec_id % 100 = 0 qualify row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) <= 5")
def cosine_knn_join(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = blockwise.nearest_cosines(e, _queries(e, query_id="vec_id", q="embedding"), "vec_id", "embedding", 5)
    return search.top_k_per(found, "query_id", "cost", "vec_id", 5).select("query_id", "vec_id", _r(-F.col("cost")).alias("similarity"))


@query("""select sum((embedding[1] > 0 and embedding[2] > 0)::int)::bigint as both, sum((embedding[1] > 0 and not embedding[4] > 0)::int)::bigint as one, sum((embedding[5] > 0 and not embedding[6] > 0 and embedding[7] > 0 and not embedding[8] > 0)::int)::bigint as field from embeddings""")
def mask_count_multi(spark, d):
    masks = {"both": search.Mask(require=3), "one": search.Mask(require=1, forbid=8), "field": search.Mask(value_mask=0xF0, value=0x50)}
    return search.count_masks(_prints(spark, d), "fp", masks)


@lru_cache(maxsize=1)
def _planes():
    return search.hyperplanes(1024, 64)


@query(f"select vec_id, {_ONES.format('embeddings')} as ones, round({_ONES.format('embeddings')} / 64.0::double, 6) as density from embeddings")
def popcount_density(spark, d):
    p = _prints(spark, d)
    return p.select("vec_id", F.bit_count("fp").cast("bigint").alias("ones"), _r(F.bit_count("fp") / 64).alias("density"))


@query()
def simhash_topk(spark, d):
    s = search.simhash(table(spark, d, "embeddings"), "vec_id", "embedding")
    q = F.array(*[F.lit(w) for w in _first(s, "words")])
    return search.top_k(s.select("vec_id", V.hamming_words(F.col("words"), q).alias("d")), "d", "vec_id", 10)


@query()
def cascade_exact(spark, d):
    s = search.simhash(table(spark, d, "embeddings"), "vec_id", "embedding")
    return search.cascade(s, F.array(*[F.lit(w) for w in _first(s, "words")]), 480, [(0, 2), (2, 4), (6, 10)])


@query()
def cascade_statistical(spark, d):
    s = search.simhash(table(spark, d, "embeddings"), "vec_id", "embedding")
    return search.cascade(s, F.array(*[F.lit(w) for w in _first(s, "words")]), 480, [(0, 2), (2, 4), (6, 10)], statistical=True)


@query()
def lsh_topk(spark, d):
    s = search.simhash(table(spark, d, "embeddings"), "vec_id", "embedding")
    q = s.where(F.col("vec_id") % 100 == 0)
    c = search.lsh_candidates(s, q, band_bits=8).join(s, "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("words").alias("q")), "query_id")
    return search.top_k_per(c.select("query_id", "vec_id", V.hamming_words(F.col("words"), F.col("q")).alias("d")), "query_id", "d", "vec_id", 10)


@query()
def pq_adc_topk(spark, d):
    """The ten nearest rows of every query: a tenth of the rows (500 at least) by codes of 6 parts x 256 words, then by
    exact distance over all dimensions. A shortlist of fixed length loses recall as the table grows."""
    e = table(spark, d, "embeddings")
    shortlist = max(500, e.count() // 10)
    near = search.adc_knn(e, e.where(F.col("vec_id") % 100 == 0), "embedding", search.train_codebooks(e, "embedding"), 10, shortlist)
    return near.select("query_id", "vec_id", _r("d").alias("d"), "rank")


_P = "(select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)"
_D2 = "((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"


def _points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])


@query(f"select q.id as query_id, p.id, round({_D2}, 6) as d2 from {_P} p, {_P} q where q.id % 100 = 0 and {_D2} <= 0.0625")
def spatial_radius(spark, d):
    p = _points(spark, d)
    return spatial.radius_join(p, p.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 0.25).select("query_id", "id", _r("d2").alias("d2"))


@query(f"select q.id as query_id, p.id, round({_D2}, 6) as d2, row_number() over (partition by q.id order by {_D2}, p.id) as rank from {_P} p, {_P} q where q.id % 100 = 0 qualify rank <= 5")
def spatial_knn(spark, d):
    p = _points(spark, d)
    near = spatial.knn_join(p, p.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 5, 0.1)
    return near.select("query_id", "id", _r("d2").alias("d2"), "rank")


_B = "(select id, x - 0.05 as min_x, x + 0.05 as max_x, y - 0.1 as min_y, y + 0.1 as max_y, z - 0.02 as min_z, z + 0.08 as max_z from " + _P + ")"


def _boxes(spark, d):
    sides = {"x": (0.05, 0.05), "y": (0.1, 0.1), "z": (0.02, 0.08)}
    p = _points(spark, d)
    return p.select("id", *[c for a, (lo, hi) in sides.items() for c in ((F.col(a) - lo).alias(f"min_{a}"), (F.col(a) + hi).alias(f"max_{a}"))])


@query(f"select a.id, b.id as query_id from {_B} a, {_B} b where b.id % 100 = 0 and a.min_x <= b.max_x and b.min_x <= a.max_x and a.min_y <= b.max_y and b.min_y <= a.max_y and a.min_z <= b.max_z and b.min_z <= a.max_z")
def aabb_join(spark, d):
    b = _boxes(spark, d)
    return spatial.box_join(b, b.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 0.3)


@query(f"""select id, round(pow(greatest(min_x, 0, -max_x), 2) + pow(greatest(min_y, 0, -max_y), 2) + pow(greatest(min_z, 0, -max_z), 2), 6) as d2, round((max_x - min_x) * (max_y - min_y) * (max_z - min_z), 9) as volume,
 (min_x <= 0.1 and max_x >= 0.1 and min_y <= 0.1 and max_y >= 0.1 and min_z <= 0.1 and max_z >= 0.1) as holds from {_B}""")
def aabb_distance(spark, d):
    holds = F.expr(" and ".join(f"min_{a} <= 0.1 and max_{a} >= 0.1" for a in "xyz"))
    return _boxes(spark, d).select("id", _r(spatial.box_distance2((0.0, 0.0, 0.0))).alias("d2"), _r(spatial.volume(), 9).alias("volume"), holds.alias("holds"))


@query(f"""with t as (select id, greatest(least(min_x + 1, max_x + 1), least((min_y + 0.5) / 0.5, (max_y + 0.5) / 0.5), least((min_z + 0.25) / 0.25, (max_z + 0.25) / 0.25), 0) as lo,
 least(greatest(min_x + 1, max_x + 1), greatest((min_y + 0.5) / 0.5, (max_y + 0.5) / 0.5), greatest((min_z + 0.25) / 0.25, (max_z + 0.25) / 0.25)) as hi from {_B}) select id, round(lo, 6) as t from t where lo <= hi""")
def ray_boxes(spark, d):
    hit = spatial.ray_entry((-1.0, -0.5, -0.25), (1.0, 0.5, 0.25))
    return _boxes(spark, d).select("id", _r(hit).alias("t")).where(F.col("t").isNotNull())


_EV = "(select user_id, event_type, sum((value >= 100)::int)::double as p, sum((value < 100)::int)::double as n from events group by all)"
_T = f"(select user_id, event_type, case when p + n > 0 then p / (p + n) else 0.5 end as f, (p + n) / (p + n + 1) as c from {_EV})"


def _truths(spark, d):
    ev = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 100).cast("double").alias("p"), F.count_if(F.col("value") < 100).cast("double").alias("n"))
    f, c = truth.from_evidence(F.col("p"), F.col("n"))
    return ev.select("user_id", "event_type", f.alias("f"), c.alias("c"))


@query(f"select user_id, event_type, round(f, 6) as f, round(c, 6) as c, round(c * (f - 0.5) + 0.5, 6) as expectation from {_T}")
def truth_from_evidence(spark, d):
    t = _truths(spark, d)
    return t.select("user_id", "event_type", _r("f").alias("f"), _r("c").alias("c"), _r(truth.expectation(F.col("f"), F.col("c"))).alias("expectation"))


@query(f"""with w as (select event_type, least(c, 0.9999) / (1 - least(c, 0.9999)) as w, f from {_T}), s as (select event_type, count(*) as k, sum(w * f) as p, sum(w * (1 - f)) as n from w group by 1)
 select event_type, k, round(p / (p + n), 6) as f, round(least((p + n) / (p + n + 1), 0.9999), 6) as c from s""")
def truth_revision(spark, d):
    r = truth.revise(_truths(spark, d), ["event_type"], "f", "c")
    return r.select("event_type", "k", _r("f").alias("f"), _r("c").alias("c"))


@query(f"""select a.user_id, a.event_type as left_type, b.event_type as right_type, round(a.f * b.f, 6) as deduction_f, round(a.f * b.f * a.c * b.c, 6) as deduction_c, round(a.f, 6) as abduction_f, round(b.f * a.c * b.c / (b.f * a.c * b.c + 1), 6) as abduction_c,
 round(b.f, 6) as induction_f, round(a.f * a.c * b.c / (a.f * a.c * b.c + 1), 6) as induction_c, round(case when a.f + b.f - a.f * b.f > 0 then a.f * b.f / (a.f + b.f - a.f * b.f) else 0 end, 6) as comparison_f,
 round(a.f * b.f * a.c * b.c / (a.f * b.f * a.c * b.c + 1), 6) as comparison_c, round(a.f * b.f, 6) as analogy_f, round(a.c * b.c * b.f, 6) as analogy_c, round(a.f * b.f, 6) as resemblance_f, round(a.c * b.c * (a.f + b.f - a.f * b.f), 6) as resemblance_c
 from {_T} a join {_T} b on a.user_id = b.user_id and a.event_type < b.event_type""")
def truth_rules(spark, d):
    t = _truths(spark, d)
    b = t.select("user_id", F.col("event_type").alias("right_type"), F.col("f").alias("f2"), F.col("c").alias("c2"))
    pairs = t.withColumnRenamed("event_type", "left_type").join(b, "user_id").where("left_type < right_type")
    out = []
    for name, rule in truth.RULES.items():
        f, c = rule(F.col("f"), F.col("c"), F.col("f2"), F.col("c2"))
        out += [_r(f).alias(f"{name}_f"), _r(c).alias(f"{name}_c")]
    return pairs.select("user_id", "left_type", "right_type", *out)


@query(f"select a.user_id, a.event_type as left_type, b.event_type as right_type, round(abs(a.f - b.f), 6) as gap from {_T} a join {_T} b on a.user_id = b.user_id and a.event_type < b.event_type where a.c > 0.5 and b.c > 0.5 and abs(a.f - b.f) > 0.1")
def contradictions(spark, d):
    t = _truths(spark, d)
    b = t.select("user_id", F.col("event_type").alias("right_type"), F.col("f").alias("f2"), F.col("c").alias("c2"))
    pairs = t.withColumnRenamed("event_type", "left_type").join(b, "user_id").where("left_type < right_type")
    return pairs.where(truth.contradicts(F.col("f"), F.col("c"), F.col("f2"), F.col("c2"), 0.1)).select("user_id", "left_type", "right_type", _r(F.abs(F.col("f") - F.col("f2"))).alias("gap"))


@query("""with recursive h as (select user_id, row_number() over (partition by user_id order by event_id) as i, (floor(value)::bigint * 7) % 65536 as f, event_id % 65536 as c from events), r as (
 select user_id, i, f, c from h where i = 1 union all select r.user_id, h.i, (r.f + h.f) // 2, (r.c + h.c) // 2 from r join h on h.user_id = r.user_id and h.i = r.i + 1)
 select user_id, arg_max(f, i) as f, arg_max(c, i) as c from r group by 1""")
def integer_revision(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.floor("value").cast("bigint") * 7 % 65536).alias("f"), (F.col("event_id") % 65536).alias("c"))
    return truth.fold_revision(e, ["user_id"], "event_id", "f", "c")


_S = "(select o_orderkey, (o_custkey * 2654435761) % 16385 as ds, (o_orderkey * 40503) % 16385 as dp, (o_custkey * 31 + o_orderkey * 17) % 16385 as dobj from orders)"
_BYTES = ["(ds < 8192)::bigint + 2 * (dp < 8192)::bigint + 4 * (dobj < 8192)::bigint + 8 * (ds < 8192 and dp < 8192)::bigint + 16 * (ds < 8192 and dobj < 8192)::bigint + 32 * (dp < 8192 and dobj < 8192)::bigint + 64 * (ds < 8192 and dp < 8192 and dobj < 8192)::bigint"] + [
    f"least(255, {v} * 255 // 16384)" for v in ("greatest(ds, dp, dobj)", "greatest(dp, dobj)", "greatest(ds, dobj)", "greatest(ds, dp)", "dobj", "dp", "ds")
]


def _edges(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(k, (c * 2654435761 % 16385).alias("ds"), (k * 40503 % 16385).alias("dp"), ((c * 31 + k * 17) % 16385).alias("do"))
    return o.select("o_orderkey", spo.edge_code(F.col("ds"), F.col("dp"), F.col("do")).alias("code"))


@query(f"select o_orderkey, {', '.join(f'({b})::bigint as b{i}' for i, b in enumerate(_BYTES))} from {_S}")
def edge_code(spark, d):
    return _edges(spark, d).select("o_orderkey", *[spo.byte_of(F.col("code"), i).alias(f"b{i}") for i in range(8)])


@query(f"with e as (select o_orderkey, {', '.join(f'({b})::bigint as b{i}' for i, b in enumerate(_BYTES))} from {_S}) select x.o_orderkey, {' + '.join(f'abs(x.b{i} - q.b{i})' for i in range(8))} as d from e x, (select * from e order by o_orderkey limit 1) q order by d, x.o_orderkey limit 10")
def edge_code_topk(spark, d):
    e = _edges(spark, d)
    q = e.orderBy("o_orderkey").first()["code"]
    return search.top_k(e.select("o_orderkey", spo.code_distance(F.col("code"), F.lit(q)).alias("d")), "d", "o_orderkey", 10)


@query(f"""select case when c = '' then 'none' else c end as class, count(*) as n from (select (case when ds < 8192 then 'S' else '' end) || (case when dp < 8192 then 'P' else '' end) || (case when dobj < 8192 then 'O' else '' end) as c from {_S}) group by 1""")
def cross_plane_classes(spark, d):
    b = spo.byte_of(F.col("code"), 0)
    return _edges(spark, d).groupBy(spo.plane_class(b.bitwiseAND(F.lit(1)) > 0, b.bitwiseAND(F.lit(2)) > 0, b.bitwiseAND(F.lit(4)) > 0).alias("class")).agg(F.count("*").alias("n"))


_KNOWN = "((vec_id * 7 + i * i) % 11 < vec_id % 9)"
_Q = "(abs(e[i + 1]) > 0.05 and i < 48)"


@query(f"""with v as (select vec_id, embedding::double[] as e from embeddings), q as (select e from v where vec_id = 0),
 b as (select vec_id, i, v.e[i + 1] > 0 as a, q.e[i + 1] > 0 as b, {_KNOWN} as ka, {_Q.replace("e[", "q.e[")} as kb from v, q, range(64) t(i)),
 s as (select vec_id, sum((ka and kb and a <> b)::int)::bigint as disagreement, sum((ka and kb)::int)::bigint as overlap, sum((not ka)::int)::bigint as penalty from b group by 1)
 select vec_id, case when overlap > 0 then disagreement end as disagreement, case when overlap > 0 then overlap end as overlap, case when overlap > 0 then penalty end as penalty, case when overlap > 0 then round((disagreement + penalty)::double / (overlap + penalty), 6) end as normalized from s""")
def plane_distance(spark, d):
    """Prints with partly known bits; those that know nothing that the query knows are incomparable."""
    bit = lambda test: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(test(i), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), V.sign_word(F.col("embedding")).alias("fp"))
    e = e.withColumn("known", bit(lambda i: (F.col("vec_id") * 7 + i * i) % 11 < F.col("vec_id") % 9)).withColumn("kq", bit(lambda i: (F.abs(F.get("e", i)) > 0.05) & (i < 48)))
    q = e.where("vec_id = 0").first()
    x = e.select("vec_id", spo.plane_distance(F.col("fp"), F.col("known"), F.lit(q["fp"]), F.lit(q["kq"])).alias("x"))
    return x.select("vec_id", "x.*", _r(spo.normalized(F.col("x"))).alias("normalized"))


_E2 = "(select vec_id, label, list_transform(embedding, lambda x: round(x::double, 1)) as v from embeddings where vec_id % 7 <> 3)"


def _snapshots(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e, e.where("vec_id % 7 <> 3").withColumn("v", F.transform("v", lambda x: F.round(x, 1)))


_L1 = "list_sum(list_transform(list_zip(a.embedding::double[], b.v), lambda z: abs(z[1] - z[2])))"


@query(f"select a.label, a.vec_id, round({_L1}, 6) as l1 from embeddings a join {_E2} b on a.label = b.label and a.vec_id = b.vec_id where {_L1} > 1.6")
def tensor_diff(spark, d):
    a, b = _snapshots(spark, d)
    return spo.snapshot_diff(a, b, ["label", "vec_id"], V.l1(F.col("v"), F.col("b_v")), 1.6).select("label", "vec_id", _r("l1").alias("l1"))


@query("select label, vec_id from embeddings where vec_id % 7 = 3")
def diff_unmatched(spark, d):
    a, b = _snapshots(spark, d)
    return spo.unmatched(a, b, ["label", "vec_id"]).select("label", "vec_id")


@query(f"select a.label, count(*) as n, max(a.vec_id) + 1 as rows, round(avg({_L1}), 6) as mean_l1 from embeddings a join {_E2} b on a.label = b.label and a.vec_id = b.vec_id where {_L1} > 1.5 group by 1")
def diff_groups(spark, d):
    a, b = _snapshots(spark, d)
    m = spo.snapshot_diff(a, b, ["label", "vec_id"], V.l1(F.col("v"), F.col("b_v")), 1.5)
    return m.groupBy("label").agg(F.count("*").alias("n"), (F.max("vec_id") + 1).alias("rows"), _r(F.avg("l1")).alias("mean_l1"))


@query("""select l_returnflag, sum((l_linestatus = 'O')::int)::bigint as o, sum((l_linestatus = 'F')::int)::bigint as f from lineitem group by 1 having avg((l_linestatus = 'O')::int) > 0.4 and avg((l_linestatus = 'F')::int) < 0.6""")
def scaffold_having(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().na.fill(0)
    n = F.col("O") + F.col("F")
    return p.where((F.col("O") / n > 0.4) & (F.col("F") / n < 0.6)).select("l_returnflag", F.col("O").alias("o"), F.col("F").alias("f"))


@query("select s, p, o, count(*) as n from (select o_orderstatus = 'F' as s, o_totalprice > 200000 as p, o_custkey % 2 = 0 as o from orders) group by cube(s, p, o) having s is not null or p is not null or o is not null")
def mask_cube(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("s"), (F.col("o_totalprice") > 200000).alias("p"), (F.col("o_custkey") % 2 == 0).alias("o"))
    return o.cube("s", "p", "o").agg(F.count("*").alias("n")).where("s is not null or p is not null or o is not null")


_W = "(select event_type, date_trunc('day', ts) as day, case when value < 50 then 0 when value < 100 then 1 when value < 200 then 2 when value < 300 then 3 when value < 400 then 4 else 5 end as stripe, count(*) as n from events group by all)"


@query(f"""with c as (select event_type, day, sum(stripe * n)::double / sum(n) as centre, sum(n)::double as total from {_W} group by all), l as (select *, centre - lag(centre) over w as moved, total / lag(total) over w - 1 as grown from c window w as (partition by event_type order by day))
 select event_type, day, round(centre, 6) as centre, round(moved, 6) + 0.0 as moved, case when moved is null then 'first' when moved > 0.1 then 'up' when moved < -0.1 then 'down' when abs(grown) > 0.15 then 'volume' else 'stable' end as shift from l""")
def window_shift(spark, d):
    from spindrift.streaming import drift

    s = drift.daily_shift(table(spark, d, "events"), "event_type", "ts", "value", [50, 100, 200, 300, 400])
    return s.select("event_type", "day", _r("centre").alias("centre"), _r("moved").alias("moved"), "shift")


@query("""with s as (select user_id, ts, event_id, (lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 21600000000)::int as fresh from events window w as (partition by user_id order by ts, event_id)), n as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
 select user_id, min(ts) as started, max(ts) as ended, count(*) as n from n group by user_id, session""")
def sessionize(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    e = table(spark, d, "events").withColumn("fresh", F.coalesce((gap > 21_600_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session")


@query("""select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') + o * interval 6 hours - interval 18 hours as started, event_type, count(*) as n, round(sum(value), 4) as total from events, (values (0), (1), (2), (3)) t(o) group by all""")
def sliding_counts(spark, d):
    e = table(spark, d, "events")
    w = e.groupBy(F.window("ts", "24 hours", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), _r(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("started"), "event_type", "n", "total")


@query(f"""with recursive l as (select a.vec_id as x, b.vec_id as y from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and {_H} <= 10), e as (select x, y from l union all select y, x from l),
 r as (select vec_id as x, vec_id as y from embeddings union select r.x, e.y from r join e on r.y = e.x) select x as vec_id, min(y) as component from r group by 1""")
def redundancy_components(spark, d):
    """Prints of one label within 10 bits, linked."""
    from spindrift.operators.graph import connected

    p = _prints(spark, d)
    links = search.close_pairs(p, ["label"], "vec_id", "fp", 10)
    found = connected(links)
    return p.select("vec_id").join(found, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))
