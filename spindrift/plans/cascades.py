"""Queries on search cascades over prints of many words, cluster trees, and beliefs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import kernels, search, trees, truth

from .numeric import _r
from .registry import query, table
from .search import _EV, _T, _first, _H, _prints, _queries, _truths

#: Prints of 16 words: bit i of word j says whether element i is above the j-th of 16 levels.
_LEVELS = [round(-0.3 + 0.04 * j, 2) for j in range(16)]
_APART = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > {t}) <> (z[2] > {t}))::int))"
_WORDS = "[" + ", ".join(_APART.format(t=f"{x}::float") for x in _LEVELS) + "]"
_WIDE = f"(select a.vec_id as query_id, b.vec_id, {_WORDS} as w from embeddings a, embeddings b where a.vec_id % 100 = 0)"
_ENERGY = "list_sum(list_transform({}.embedding, lambda x: " + " + ".join(f"(x > {x}::float)::int" for x in _LEVELS) + "))"
_BOTH = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: " + " + ".join(f"(z[1] > {x}::float and z[2] > {x}::float)::int" for x in _LEVELS) + "))"


def _wide(spark, d):
    above = lambda t: F.transform("embedding", lambda x: x - F.lit(t).cast("float"))
    words = [V.sign_word(above(t)) for t in _LEVELS]
    return table(spark, d, "embeddings").select("vec_id", F.array(*words).alias("words"))


def _wide_pairs(spark, d):
    p = _wide(spark, d)
    return search.pair_with(p, _queries(p, query_id="vec_id", q="words"))


#: Shares as by default, except for grades: these prints are far more alike than random ones.
_GATE = kernels.SliceGate(1024, hot=0.10, mid=0.14, cold=0.16, anti=0.30, margin=1.5)
_K0, _K1 = _GATE.reject(64), _GATE.reject(512)
_SIGMA = kernels.SigmaGate.of_bits(1024)


@query(f"""with p as (select query_id, vec_id, w[1] as d0, list_sum(w[1:8]) as d1, list_sum(w) as d, e.a as energy_a, e.b as energy_b, e.both as agreement from {_WIDE} join (select a.vec_id as query_id, b.vec_id, {_ENERGY.format('b')} as a, {_ENERGY.format('a')} as b, {_BOTH} as both from embeddings a, embeddings b where a.vec_id % 100 = 0) e using (query_id, vec_id))
 select query_id, vec_id, d::bigint as conflict, energy_a::bigint as energy_a, energy_b::bigint as energy_b, agreement::bigint as agreement, (case when d < {_GATE.below(0.10)} then 3 else 0 end + case when d < {_GATE.below(0.14)} then 2 else 0 end + 1)::int as grade, round(({_SIGMA.mu} - d) / {_SIGMA.sigma}.0::double, 6) as z,
 case when d < {_SIGMA.discovery} then 'Discovery' when d < {_SIGMA.strong} then 'Strong' when d < {_SIGMA.evidence} then 'Evidence' when d < {_SIGMA.hint} then 'Hint' else 'Noise' end as level, 3e-7::double as p_value from p where d0 <= {_K0} and d1 <= {_K1} and d < {_GATE.below(0.16)}""")
def kernel_pipeline(spark, d):
    """Matches of all queries with all rows that pass the probes of one and of eight words."""
    out = kernels.kernel_pipeline(_wide_pairs(spark, d), "words", "q", _GATE)
    return out.select("query_id", "vec_id", "conflict", "energy_a", "energy_b", "agreement", "grade", _r("z").alias("z"), "level", "p_value")


@query(f"""with p as (select w[1] as d0, list_sum(w[1:8]) as d1, list_sum(w) as d from {_WIDE}) select count(*) as total, count_if(d0 > {_K0})::bigint as k0_rejected, count_if(d0 <= {_K0} and d1 > {_K1})::bigint as k1_rejected, count_if(d0 <= {_K0} and d1 <= {_K1})::bigint as k2_promoted,
 count_if(d0 <= {_K0} and d1 <= {_K1} and d < {_GATE.below(0.16)})::bigint as matches, count_if(d0 <= {_K0} and d1 <= {_K1} and d > {int(np.ceil(0.30 * 1024))})::bigint as opposites from p""")
def kernel_stats(spark, d):
    return kernels.pipeline_stats(_wide_pairs(spark, d), "words", "q", _GATE)


@query(f"select query_id, vec_id, w as conflicts, (list_max(w) - list_min(w)) as spread from {_WIDE}")
def word_histogram(spark, d):
    """Differing bits per word: where in the print two rows differ."""
    pairs = _wide_pairs(spark, d).withColumn("conflicts", kernels.word_conflicts(F.col("words"), F.col("q")))
    return pairs.select("query_id", "vec_id", "conflicts", (F.array_max("conflicts") - F.array_min("conflicts")).alias("spread"))


_ONE = f"(select b.vec_id, {_WORDS} as w from embeddings a, embeddings b where a.vec_id = 0)"


@query(f"with s as (select vec_id, list_sum(w[1:2]) as s1, list_sum(w[1:6]) as s12, list_sum(w) as d from {_ONE}) select vec_id, d::bigint as d from s where s1 <= 40 and s12 <= 140 order by d, vec_id limit 25")
def packed_cascade(spark, d):
    """Strokes of 2, 4 and 10 words with explicit thresholds for the first and the first two."""
    p = _wide(spark, d)
    return kernels.packed_search(kernels.pack_strokes(p, "words", 2, 4), _first(p, "words"), 2, 4, 40, 140, 25)


@query(f"""with s as (select vec_id, list_sum(w[1:2]) as s1, list_sum(w[1:6]) as s12, list_sum(w) as d from {_ONE}) select vec_id, d::bigint as d, case when d <= 75 then 'Foveal' when d <= 150 then 'Near' when d <= 225 then 'Good' else 'Weak' end as band from s where floor(s1 * 8.0) <= 375 and floor(s12 * 16.0 / 6) <= 300 and d <= 300 order by d, vec_id limit 25""")
def estimated_cascade(spark, d):
    p = _wide(spark, d)
    return kernels.estimated_search(kernels.pack_strokes(p, "words", 2, 4), _first(p, "words"), 2, 4, 300, 25)


_SUB = "list_sum(list_transform(range(10), lambda j: pow({x}[{p} * 10 + j + 1]::double - {y}[{p} * 10 + j + 1]::double, 2)))"
_WORDS6 = f"(select a.vec_id, p, c.vec_id as k, {_SUB.format(x='a.embedding', y='c.embedding', p='p')} as d from embeddings a, (select * from embeddings where vec_id < 16) c, range(6) t(p))"
_CODES6 = f"(select vec_id, p, k from {_WORDS6} qualify row_number() over (partition by vec_id, p order by d, k) = 1)"


def _books(spark, d):
    """Code words taken from the first 16 vectors: 6 parts of 10 numbers."""
    rows = table(spark, d, "embeddings").where("vec_id < 16").orderBy("vec_id").collect()
    x = np.asarray([r["embedding"][:60] for r in rows], float)
    return x.reshape(len(rows), 6, 10).transpose(1, 0, 2)


@query(f"""with c as {_CODES6}, t as (select vec_id as q, p, k, d from {_WORDS6} where vec_id % 100 = 0), s as (select t.q, c.vec_id, sum(case when c.p = 0 then d else 0 end) as heel, sum(case when c.p < 2 then d else 0 end) as two, sum(d) as d from c join t on t.p = c.p and t.k = c.k group by all)
 select q as query_id, vec_id, round(d, 6) as d, row_number() over (partition by q order by d, vec_id) as rank from s where heel < 0.25 and two < 0.5 qualify rank <= 10""")
def code_cascade(spark, d):
    """Quantised codes: the first part below a threshold, then the first two, then all; the ten nearest per query."""
    e, books = table(spark, d, "embeddings"), _books(spark, d)
    pairs = search.pair_with(search.pq_encode(e, "vec_id", "embedding", books), search.adc_tables(e.where("vec_id % 100 = 0"), "vec_id", "embedding", books), block_rows=1_000)
    hits = kernels.code_cascade(pairs, "tables", "codes", 6, 0.25, 0.5).select("query_id", "vec_id", "d")
    return search.top_k_per(hits, "query_id", "d", "vec_id", 10).select("query_id", "vec_id", _r("d").alias("d"), "rank")


@query(f"""with c as {_CODES6}, e as (select c.vec_id, sum({_SUB.format(x='a.embedding', y='b.embedding', p='p')}) as d from c join embeddings a on a.vec_id = c.vec_id join embeddings b on b.vec_id = c.k group by 1) select round(avg(d), 6) as mean_error, round(max(d), 6) as worst, count(*) as n from e""")
def code_errors(spark, d):
    """Squared distances of vectors from what their codes decode to."""
    e, books = table(spark, d, "embeddings"), _books(spark, d)
    back = search.pq_decode(search.pq_encode(e, "vec_id", "embedding", books), "vec_id", "codes", books)
    both = back.join(e.select("vec_id", F.slice("embedding", 1, 60).cast("array<double>").alias("x")), "vec_id").select(V.squared_l2(F.col("x"), F.col("v")).alias("d"))
    return both.agg(_r(F.avg("d")).alias("mean_error"), _r(F.max("d")).alias("worst"), F.count("*").alias("n"))


@query(f"select a.vec_id as query_id, b.vec_id, {_H} as d, row_number() over (partition by a.vec_id order by {_H}, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 100 = 0 qualify rank <= 12")
def tree_knn(spark, d):
    """Exact nearest neighbours by way of a tree of clusters."""
    p = _prints(spark, d)
    return trees.knn(trees.build(p, depth=4, least=8), _queries(p, query_id="vec_id", q="fp"), 12)


@query(f"select a.vec_id as query_id, b.vec_id, {_H} as d, case when {_H} <= 5 then 'Foveal' when {_H} <= 11 then 'Near' when {_H} <= 16 then 'Good' else 'Weak' end as band from embeddings a, embeddings b where a.vec_id % 100 = 0 and {_H} <= 22")
def tree_radius(spark, d):
    """Rows within a radius by way of the tree, with their band."""
    p = _prints(spark, d)
    hits = trees.radius_search(trees.build(p, depth=4, least=8), _queries(p, query_id="vec_id", q="fp"), 22)
    return hits.withColumn("band", search.band(F.col("d"), 22))


@query("select count(*) as n, count(*) as placed, true as within, true as prefix from embeddings")
def tree_shape(spark, d):
    """Every row is in one leaf; children's sizes add up to their parent's, and no row is beyond its leaf's radius."""
    t = trees.build(_prints(spark, d), depth=4, least=8)
    leaf = trees.leaves(t)
    inside = t.rows.join(leaf, "path").withColumn("d", V.hamming(F.col("fp"), F.col("center")))
    parts = t.clusters.where("depth > 0").groupBy(F.expr("substring(path, 1, length(path) - 1)").alias("path")).agg(F.sum("n").alias("m"))
    fits = t.clusters.join(parts, "path").agg(F.coalesce(F.bool_and(F.col("n") == F.col("m")), F.lit(True)).alias("prefix"))
    return t.rows.agg(F.count("*").alias("n")).crossJoin(inside.agg(F.count("*").alias("placed"), F.bool_and(F.col("d") <= F.col("radius")).alias("within"))).crossJoin(fits)


@query(f"with h as (select b.vec_id, {_H} as d from embeddings a, embeddings b where a.vec_id = 0) select vec_id, d, case when d <= 20 then 'exact' when d <= 28 then 'near' when d <= 34 then 'far' else 'noise' end as class, case when d <= 10 then 'exact' when d <= 20 then 'near' when d <= 40 then 'far' else 'noise' end as by_band, case when d / 64.0 < 0.2 then 'Foveal' when d / 64.0 < 0.5 and vec_id % 10 / 10.0 < 0.3 then 'Near' when vec_id % 10 / 10.0 < 0.5 then 'Good' else 'Weak' end as resolution from h")
def sigma_classes(spark, d):
    p = _prints(spark, d)
    h = p.select("vec_id", V.hamming(F.col("fp"), F.lit(_first(p, "fp"))).alias("d"))
    return h.select("vec_id", "d", kernels.sigma_class(F.col("d"), (20, 28, 34)).alias("class"), kernels.band_class(F.col("d"), 40).alias("by_band"), kernels.adaptive_band(F.col("d") / 64, F.col("vec_id") % 10 / 10).alias("resolution"))


@query(f"""select a.user_id, a.event_type as left_type, b.event_type as right_type, round(a.c * b.c * abs(a.f - b.f), 6) as severity from {_T} a join {_T} b on a.user_id = b.user_id and a.event_type < b.event_type where a.c > 0.5 and b.c > 0.5 and abs(a.f - b.f) > 0.05""")
def contradiction_severity(spark, d):
    t = _truths(spark, d)
    b = t.select("user_id", F.col("event_type").alias("right_type"), F.col("f").alias("f2"), F.col("c").alias("c2"))
    pairs = t.withColumnRenamed("event_type", "left_type").join(b, "user_id").where("left_type < right_type")
    s = truth.severity(F.col("f"), F.col("c"), F.col("f2"), F.col("c2"), 0.05)
    return pairs.select("user_id", "left_type", "right_type", _r(s).alias("severity")).where("severity is not null")


@query(f"""with p as (select a.user_id, a.event_type as left_type, b.event_type as right_type, abs(a.f - b.f) as gap, a.c / (1 - a.c) as wa, b.c / (1 - b.c) as wb, a.f as fa, b.f as fb from {_T} a join {_T} b on a.user_id = b.user_id and a.event_type < b.event_type where (a.user_id % 10) / 5.0 > 0.7 and abs(a.f - b.f) > 0.02)
 select user_id, left_type, right_type, round(gap, 6) as conflict, round((wa * fa + wb * fb) / (wa + wb), 6) as f, round((wa + wb) / (wa + wb + 1), 6) as c from p""")
def detect_conflicts(spark, d):
    """Beliefs of similar structure and opposing truth, and what they resolve to."""
    t = _truths(spark, d)
    b = t.select("user_id", F.col("event_type").alias("right_type"), F.col("f").alias("f2"), F.col("c").alias("c2"))
    pairs = t.withColumnRenamed("event_type", "left_type").join(b, "user_id").where("left_type < right_type")
    x = truth.conflict(F.col("f"), F.col("c"), F.col("f2"), F.col("c2"), F.col("user_id") % 10 / 5, 0.02)
    return pairs.withColumn("x", x).where("x is not null").select("user_id", "left_type", "right_type", *[_r(f"x.{n}").alias(n) for n in ("conflict", "f", "c")])


@query(f"""with t as (select * from {_T}) select user_id, event_type, 'negation' as kind, round(1 - f, 6) as f, round(c * 0.9, 6) as c, c * (f - 0.5) + 0.5 > c * 0.9 * (0.5 - f) + 0.5 as survives from t union all select user_id, event_type, 'dependency', round(f, 6), round(c * 0.5, 6), c > 0.5 from t""")
def self_critique(spark, d):
    t = _truths(spark, d).select("user_id", "event_type", F.explode(truth.critique(F.col("f"), F.col("c"))).alias("x"))
    return t.select("user_id", "event_type", "x.kind", _r("x.f").alias("f"), _r("x.c").alias("c"), "x.survives")


@query(f"select user_id, event_type, round(f, 6) as f, round(c, 6) as c from {_T} qualify row_number() over (partition by user_id order by c * (f - 0.5) + 0.5 desc, event_type) = 1")
def best_belief(spark, d):
    return truth.best_belief(_truths(spark, d), ["user_id"], "event_type", "f", "c").select("user_id", "event_type", _r("f").alias("f"), _r("c").alias("c"))


@query(f"""with b as (select user_id, p / (p + n) as priority, n / (p + n) as durability, (p + n) / (p + n + 1) as quality from {_EV}) select user_id, round(max(priority) * 0.5, 6) as priority, round(avg(durability) * 0.5, 6) as durability, round(max(quality), 6) as quality from b group by 1""")
def budgets(spark, d):
    """Budgets of a user merged, then decayed by half."""
    ev = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 100).alias("p"), F.count("*").alias("w"))
    b = ev.select("user_id", (F.col("p") / F.col("w")).alias("priority"), ((F.col("w") - F.col("p")) / F.col("w")).alias("durability"), (F.col("w") / (F.col("w") + 1)).alias("quality"))
    out = truth.budget_decay(truth.budget_merge(b, ["user_id"]), F.lit(0.5))
    return out.select("user_id", *[_r(c).alias(c) for c in ("priority", "durability", "quality")])
