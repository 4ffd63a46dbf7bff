"""Queries on binary nets, masks of sections and synapse registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import blockwise, nets, search

from .cascades import _GATE, _K0, _K1, _wide_pairs, _WIDE
from .numeric import _r
from .registry import query, table
from .search import cross_plane_classes, _queries, _S

_SCORE = "round(2 * (1024 - d) / 1024.0::double - 1, 6)"


@query(f"select query_id, vec_id, d::bigint as conflict, {_SCORE} as score, row_number() over (partition by query_id order by d, vec_id) as rank from (select query_id, vec_id, w[1] as d0, list_sum(w[1:8]) as d1, list_sum(w) as d from {_WIDE}) where d0 <= {_K0} and d1 <= {_K1} and d < {_GATE.below(0.16)} qualify rank <= 10")
def binary_cascade(spark, d):
    """The ten best neurons of each query among those that pass the probes."""
    return nets.cascade_search(_wide_pairs(spark, d), "words", "q", _GATE, 1024, 10).withColumn("score", _r("score"))


@query(f"select query_id, vec_id, d::bigint as conflict, {_SCORE} as score, row_number() over (partition by query_id order by d, vec_id) as rank from (select query_id, vec_id, list_sum(w) as d from {_WIDE}) where d <= 200 qualify rank <= 10")
def binary_threshold(spark, d):
    """The ten best neurons within 200 bits, of which the first four words alone rule most rows out."""
    return nets.threshold_search(_wide_pairs(spark, d), "words", "q", 4, 200, 1024, 10).withColumn("score", _r("score"))


@query(f"select query_id, vec_id, round(2 * (768 - list_sum(w[1:4]) - list_sum(w[5:8]) - list_sum(w[9:12])) / 768.0::double - 1, 6) as score from {_WIDE} where vec_id % 3 = 1")
def channel_convolution(spark, d):
    """Every third print, from the second on, against each query over three channels of four words."""
    pairs = _wide_pairs(spark, d).where("vec_id % 3 = 1")  # the operator's stride
    part = lambda c, i: F.slice(c, 4 * i + 1, 4)
    return pairs.select("query_id", "vec_id", _r(nets.channel_score([(part("words", i), part("q", i)) for i in range(3)], 256)).alias("score"))


_U8 = "list_transform({0}.embedding, lambda x: greatest(0, least(255, floor(x::double * 256 + 128)))::int)"


@query(f"select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip({_U8.format('a')}, {_U8.format('b')}), lambda z: abs(z[1] - z[2])))::bigint as d from embeddings a, embeddings b where a.vec_id % 100 = 0 and list_sum(list_transform(list_zip({_U8.format('a')}, {_U8.format('b')}), lambda z: abs(z[1] - z[2]))) <= 1900")
def byte_work_search(spark, d):
    """Vectors as bytes within 1,900 of each query."""
    code = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 256 + 128))).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", code.alias("c"))
    return blockwise.within_work(e, _queries(e, query_id="vec_id", q="c"), "vec_id", "c", 1900)


_PASS = "(o_orderkey % 256 & 5) = 5 and (o_orderkey % 256 & 64) = 0"


@query(f"select o_orderpriority, o_custkey // 64 as word, (bit_or(case when {_PASS} then case when o_custkey % 64 = 63 then -(1::hugeint << 63) else 1::hugeint << (o_custkey % 64)::int end else 0::hugeint end))::bigint as bits, bit_count(bit_or(case when {_PASS} then case when o_custkey % 64 = 63 then -(1::hugeint << 63) else 1::hugeint << (o_custkey % 64)::int end else 0::hugeint end)::bigint)::bigint as n from orders group by all")
def section_bitmaps(spark, d):
    """Orders' states at their customers' places: which pass a mask, by priority, as words of 64."""
    o = table(spark, d, "orders").withColumn("state", F.col("o_orderkey") % 256)
    return nets.section_bitmaps(o, ["o_orderpriority"], "o_custkey", "state", search.Mask(require=5, forbid=64))


_SYN = "(select l_returnflag, (l_partkey * 31 + l_suppkey * 7) % 256 - 128 as e, l_quantity::bigint * 2 as t, l_linenumber * 3 as m from lineitem)"
_STRONG = "abs(e) > t and m >= 8"


@query(f"""select l_returnflag, count(*) as n, round(avg(abs(e)), 6) as mean_efficacy, round(avg((abs(e) > 100)::int), 6) as saturated, count_if(abs(e) > t // 2 and e <= 0 and {_STRONG})::bigint as "StrongNeg", count_if(abs(e) > t // 2 and e <= 0 and not ({_STRONG}))::bigint as "WeakNeg", count_if(abs(e) <= t // 2)::bigint as "Silent", count_if(abs(e) > t // 2 and e > 0 and not ({_STRONG}))::bigint as "WeakPos", count_if(abs(e) > t // 2 and e > 0 and {_STRONG})::bigint as "StrongPos" from {_SYN} group by 1""")
def synapse_statistics(spark, d):
    s = table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % 256 - 128).alias("efficacy"), (F.col("l_quantity").cast("bigint") * 2).alias("theta"), (F.col("l_linenumber") * 3).alias("maturity"))
    return nets.synapse_stats(s, ["l_returnflag"], 100).withColumn("mean_efficacy", _r("mean_efficacy")).withColumn("saturated", _r("saturated"))


@query(f"""with c as (select (ds < 8192)::int + (dp < 8192)::int + (dobj < 8192)::int as i from {_S}) select level, round(count(c.i) / greatest(1, (select count(*) from c))::double, 6) as share from (values (0, 'noise'), (1, 'free'), (2, 'pair'), (3, 'core')) l(i, level) left join c on c.i = l.i group by level""")
def lattice_levels(spark, d):
    """The shares of edges that none, one, two or all three planes survive in."""
    return nets.level_fractions(cross_plane_classes(spark, d)).withColumn("share", _r("share"))
