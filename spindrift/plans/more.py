"""Queries on clusters, palettes, snapshots, diffs, JSON properties and word features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import clusters, lineage, search, words

from .numeric import _r
from .registry import query, table
from .search import _first, _H, _prints, _queries

_PAIRS = f"(select a.vec_id as q, b.vec_id, {_H} as d from embeddings a, embeddings b where a.vec_id % 100 = 0)"


def _pairs(spark, d):
    p = _prints(spark, d)
    return search.pair_with(p.select("vec_id", "fp"), _queries(p, q="vec_id", w="fp")).select("q", "vec_id", V.hamming(F.col("fp"), F.col("w")).alias("d"))


_LFD = f"(select q, sum((d <= 30)::int) as o, sum((d <= 15)::int) as i from {_PAIRS} group by 1)"


@query(f"select q, o::bigint as outer, i::bigint as inner, round(case when o > 0 and i > 0 then log2(o::double / i) else 0 end, 6) as lfd from {_LFD}".replace("as outer", 'as "outer"').replace("as inner", 'as "inner"'))
def local_dimension(spark, d):
    return clusters.local_dimension(_pairs(spark, d), "q", "d", 30).withColumn("lfd", _r("lfd"))


@query(f"""with l as (select q, case when o > 0 and i > 0 then log2(o::double / i) else 0 end as lfd from {_LFD}), s as (select q, case when max(lfd) over () > min(lfd) over () then (lfd - min(lfd) over ()) / (max(lfd) over () - min(lfd) over ()) else 0 end as s from l)
 select q, round(s, 6) as score, case when s < 1.0/3 then 'normal' when s < 2.0/3 then 'uncertain' else 'anomalous' end as state from s""")
def anomaly_scores(spark, d):
    lfd = clusters.local_dimension(_pairs(spark, d), "q", "d", 30)
    return clusters.anomaly_scores(lfd, "lfd").select("q", _r("score").alias("score"), "state")


@query(f"""with r as (select q, d, row_number() over (partition by q order by d) - 1 as i, count(*) over (partition by q) as n from {_PAIRS})
 select q, max(n) as n, min(d) as low, max(d) as high, max(case when i = n * 25 // 100 then d end) as p25, max(case when i = n * 50 // 100 then d end) as p50, max(case when i = n * 75 // 100 then d end) as p75, round(avg(d), 6) as mean, round(stddev_pop(d), 6) as deviation from r group by 1""")
def cluster_percentiles(spark, d):
    c = clusters.index_percentiles(_pairs(spark, d), ["q"], "d")
    return c.withColumn("mean", _r("mean")).withColumn("deviation", _r("deviation"))


@query(f"""with l as (select 0 as g, case when o > 0 and i > 0 then log2(o::double / i) else 0 end as lfd from {_LFD}), r as (select g, lfd, row_number() over (order by lfd) - 1 as i, count(*) over () as n from l)
 select max(n) as n, {', '.join(f"round(max(case when i = (n - 1) * {q} // 100 then lfd end), 6) as p{q}" for q in (5, 25, 50, 75, 95))}, round(min(lfd), 6) as low, round(max(lfd), 6) as high, round(avg(lfd), 6) as mean from r""")
def dimension_percentiles(spark, d):
    lfd = clusters.local_dimension(_pairs(spark, d), "q", "d", 30).withColumn("g", F.lit(0))
    p = clusters.index_percentiles(lfd, ["g"], "lfd", (5, 25, 50, 75, 95), last=True)
    return p.select("n", *[_r(c).alias(c) for c in ("p5", "p25", "p50", "p75", "p95", "low", "high", "mean")])


@query(f"""select q, round(avg(d), 6) as mean, round(stddev_pop(d), 6) as deviation, min(d) as low, max(d) as high, round(avg((abs(d - 32) <= 4)::int), 6) as within, round(avg((abs(d - 32) > 12)::int), 6) as discriminative from {_PAIRS} group by 1""")
def matrix_stats(spark, d):
    apart = F.abs(F.col("d") - 32)
    return _pairs(spark, d).groupBy("q").agg(_r(F.avg("d")).alias("mean"), _r(F.stddev_pop("d")).alias("deviation"), F.min("d").alias("low"), F.max("d").alias("high"), _r(F.avg((apart <= 4).cast("int"))).alias("within"), _r(F.avg((apart > 12).cast("int"))).alias("discriminative"))


_MERGE = "(select o_custkey as k, max(o_totalprice) as v from orders where o_orderpriority like '1%' group by 1)"


@query(f"select coalesce(a.k, c_custkey) as k, coalesce(a.v, c_acctbal) as v from {_MERGE} a full join customer c on a.k = c.c_custkey")
def merge_snapshots(spark, d):
    a = table(spark, d, "orders").where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return clusters.merge_snapshots(a, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k", "v")


_COSD = "1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"select vec_id, round(min(d), 6) as d from (select b.vec_id, {_H} / 64.0::double as d from embeddings a, embeddings b where a.vec_id = 0 union all select b.vec_id, {_COSD} from embeddings a, embeddings b where a.vec_id = 0) group by 1 order by min(d), vec_id limit 15")
def merge_and_rerank(spark, d):
    e, p = table(spark, d, "embeddings"), _prints(spark, d)
    q = F.array(*[F.lit(float(x)) for x in _first(e, "embedding")])
    paths = [p.select("vec_id", (V.hamming(F.col("fp"), F.lit(_first(p, "fp"))) / 64).alias("d")), e.select("vec_id", (1 - V.cosine(q, F.col("embedding"))).alias("d"))]
    return clusters.merge_hits(paths, "vec_id", "d", 15).select("vec_id", _r("d").alias("d"))


@query("""select l_returnflag, l_linestatus, coalesce(sum(case when l_shipdate < timestamp '1995-01-01' then l_quantity end), 0) as early, coalesce(sum(case when l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1998-01-01' then l_quantity end), 0) as middle,
 coalesce(sum(case when l_shipdate >= timestamp '1998-01-01' then l_quantity end), 0) as late, case when coalesce(sum(case when l_shipdate >= timestamp '1998-01-01' then l_quantity end), 0) > coalesce(sum(case when l_shipdate < timestamp '1995-01-01' then l_quantity end), 0) then 'GOOD' else 'BAD' end as verdict from lineitem group by all""")
def quality_map(spark, d):
    ship = F.col("l_shipdate").cast("timestamp")
    first, second = F.lit("1995-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp")
    parts = {"early": ship < first, "middle": (ship >= first) & (ship < second), "late": ship >= second}
    l = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    j = clusters.join_diffs({n: l.where(c) for n, c in parts.items()}, ["l_returnflag", "l_linestatus"], "l_quantity")
    return j.withColumn("verdict", F.when(F.col("late") > F.col("early"), "GOOD").otherwise("BAD"))


@query()
def reverse_trace(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    start = [float(x) for x in _first(e, "v")]
    rows = clusters.greedy_trace(start, e, "vec_id", "v", lambda c, q: V.l1(c, F.array(*[F.lit(float(x)) for x in q])), 4, 1e9)
    return spark.createDataFrame(rows, "step bigint, vec_id bigint, d double").withColumn("d", _r("d", 4))


@query("select event_type, (props::json ->> 'k')::bigint % 10 as k, count(*) as n, round(sum(value), 3) as total from events group by all")
def json_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"), _r(F.sum("value"), 3).alias("total"))


def _words_sql(key, source):
    return f"(select {key}, regexp_replace(unnest(regexp_split_to_array(lower(text), '[{words.WHITE}]+')), '[^\\p{{L}}]', '', 'g') as word from {source})"


def _vocabulary_sql(tag, source, least):
    n = f"(select word, {tag}, count(*) as n from {_words_sql(tag, source)} where word <> '' and {tag} is not null group by all)"
    return f"(select word, prime, weight from (select word, {tag} as prime, floor(10 * n::double / sum(n) over (partition by word))::bigint as weight from {n}) where weight >= {least})"


def _decomposed_sql(vocabulary):
    return f"(select doc_id, prime, sum(weight)::bigint as weight from {_words_sql('doc_id', 'documents')} w join {vocabulary} v on w.word = v.word group by all)"


_BY_ROLE = _vocabulary_sql("role", "conversations", 1)


def _by_role(spark, d):
    return words.tag_vocabulary(table(spark, d, "conversations"), "role")


def _decomposed(spark, d):
    return words.decompose(table(spark, d, "documents").select("doc_id", "text"), _by_role(spark, d), "doc_id")


@query(f"select doc_id, prime, weight as n, round(weight::double / sum(weight) over (partition by doc_id), 6) as weight from {_decomposed_sql(_vocabulary_sql('lang', 'documents', 10))}")
def prime_weights(spark, d):
    """Documents by the words that only one language has, whose vocabulary the documents' own languages give."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    found = words.decompose(docs, words.tag_vocabulary(docs, "lang", least=10), "doc_id")
    return found.select("doc_id", "prime", F.col("weight").alias("n"), _r("share").alias("weight"))


@query(f"select doc_id, prime, weight as tenths, round(weight::double / sum(weight) over (partition by doc_id), 6) as weight from {_decomposed_sql(_BY_ROLE)}")
def prime_decompose(spark, d):
    """Documents by the roles that say their words in conversations, in tenths, so that sums are exact."""
    return _decomposed(spark, d).select("doc_id", "prime", F.col("weight").alias("tenths"), _r("share").alias("weight"))


@query(f"""with w as {_decomposed_sql(_BY_ROLE)}, n as (select doc_id, sqrt(sum(weight * weight)) as norm from w group by 1)
 select q.doc_id as query, b.doc_id, round(sum(q.weight * b.weight)::double / any_value(m.norm * n.norm), 6) as similarity from w q join w b on q.prime = b.prime join n on n.doc_id = b.doc_id join n m on m.doc_id = q.doc_id where q.doc_id % 100 = 0 group by q.doc_id, b.doc_id""")
def prime_similarity(spark, d):
    """Cosines of prime weights, every document whose id is divisible by 100 against all."""
    w = lineage.cut(_decomposed(spark, d).drop("share"))
    return words.similarity(w, w.where("doc_id % 100 = 0"), "doc_id").withColumn("similarity", _r("similarity"))


@query(f"select p.event_type, v.prime, v.weight, count(*) as n from (select event_type, event_type as word from events) p join {_BY_ROLE} v on v.word = p.word group by all union all select l.n_name, v.prime, v.weight, 1 from nation l join {_BY_ROLE} v on v.word = lower(l.n_name) union all select 'documents', v.prime, v.weight, count(*) from {_words_sql('doc_id', 'documents')} w join {_BY_ROLE} v on v.word = w.word group by all")
def prime_lookup(spark, d):
    """Primes of words: of event types, of nations, and of all words of the documents, counted."""
    v = _by_role(spark, d)
    of = lambda t: words.lookup(t, v).groupBy("event_type", "prime", "weight").agg(F.sum("c").alias("n"))
    events = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("c")).withColumn("word", F.col("event_type"))
    nations = table(spark, d, "nation").select(F.col("n_name").alias("event_type"), F.lit(1).alias("c"), F.col("n_name").alias("word"))
    texts = words.word_counts(table(spark, d, "documents"), ["doc_id"]).groupBy("word").agg(F.sum("n").alias("c")).withColumn("event_type", F.lit("documents"))
    return of(events.unionByName(nations).unionByName(texts))


_LEAF = "('0x' || substr(sha256(o_orderkey || '|' || {}), 1, 15))::bigint"


@query(f"""with a as (select o_orderkey % 8 as branch, sum({_LEAF.format("o_orderstatus")})::varchar as digest, count(*) as n from orders group by 1),
 b as (select o_orderkey % 8 as branch, sum({_LEAF.format("case when o_orderkey % 40 = 3 then 'X' else o_orderstatus end")})::varchar as digest from orders where o_orderkey % 8 <> 6 group by 1),
 x as (select * from a union all select -1, (select sum({_LEAF.format("o_orderstatus")})::varchar from orders), (select count(*) from orders)),
 y as (select * from b union all select -1, (select sum({_LEAF.format("case when o_orderkey % 40 = 3 then 'X' else o_orderstatus end")})::varchar from orders where o_orderkey % 8 <> 6))
 select branch::int as branch, x.digest, x.n, x.digest is distinct from y.digest as differs from x full join y using (branch)""")
def hash_tree(spark, d):
    """The orders' hash tree, and which branches differ from that of a table with changed rows and a branch less."""
    o = table(spark, d, "orders")
    changed = o.where("o_orderkey % 8 <> 6").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 40 == 3, "X").otherwise(F.col("o_orderstatus")))
    one, two = (clusters.hash_tree(t, F.col("o_orderkey"), "o_orderkey", F.col("o_orderstatus")) for t in (o, changed))
    return one.join(clusters.diff_trees(one, two), "branch")


@query(f"select label, round(avg(x) / greatest(stddev_pop(x), 1e-9), 4) as signal, round(min(x), 6) as low, round(max(x), 6) as high from (select label, unnest(list_transform(range(64), lambda i: round((embedding[i + 1]::double - list_min(embedding)) / ((list_max(embedding) - list_min(embedding))::double / 255)) * ((list_max(embedding) - list_min(embedding))::double / 255) + list_min(embedding))) as x from embeddings) group by 1")
def approx_moments(spark, d):
    """Moments after 8-bit quantisation."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("low", F.array_min("v")).withColumn("step", (F.array_max("v") - F.array_min("v")) / 255)
    x = e.select("label", F.explode(F.transform("v", lambda y: F.round((y - F.col("low")) / F.col("step")) * F.col("step") + F.col("low"))).alias("x"))
    return x.groupBy("label").agg(_r(F.avg("x") / F.greatest(F.stddev_pop("x"), F.lit(1e-9)), 4).alias("signal"), _r(F.min("x")).alias("low"), _r(F.max("x")).alias("high"))


@query("""with b as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings) select vec_id, case when i < 4 then 0 when i < 8 then 1 when i < 16 then 2 when i < 32 then 3 else 4 end as band, round(sqrt(sum(v * v)), 6) as energy from b group by all""")
def band_energies(spark, d):
    edges = [4, 8, 16, 32]
    i = F.col("i")
    band = reduce(lambda acc, x: F.when(i < x[1], x[0]).otherwise(acc), reversed(list(enumerate(edges))), F.lit(len(edges)))
    b = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return b.groupBy("vec_id", band.alias("band")).agg(_r(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("energy"))


@query("select user_id, event_type, ts, event_type <> lag(event_type) over w as changed, round(value - lag(value) over w, 4) + 0.0 as step, round(value - lag(value, 2) over w, 4) + 0.0 as step2 from events window w as (partition by user_id order by ts, event_id)")
def snapshot_transitions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return table(spark, d, "events").select("user_id", "event_type", "ts", (F.col("event_type") != F.lag("event_type").over(w)).alias("changed"), _r(v - F.lag(v).over(w), 4).alias("step"), _r(v - F.lag(v, 2).over(w), 4).alias("step2"))


@query("""with x as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), g as (select vec_id, label, i, c, abs(x - p) as gap from x, (values (0, -0.4::double), (1, 0.0::double), (2, 0.4::double)) t(c, p)),
 n as (select vec_id, label, i, c from g qualify row_number() over (partition by vec_id, label, i order by gap, c) = 1) select vec_id, label, list(c order by i) as codes from n group by vec_id, label""")
def palette_all(spark, d):
    """Nearest of the palette values -0.4, 0, 0.4 in every dimension by distance alone; a tie goes to the first."""
    x = F.col("embedding").cast("array<double>")
    codes = F.transform(x, lambda v: F.array_min(F.array(*[F.struct(F.abs(v - F.lit(p)).alias("gap"), F.lit(i).alias("c")) for i, p in enumerate((-0.4, 0.0, 0.4))]))["c"])
    return table(spark, d, "embeddings").select("vec_id", "label", codes.alias("codes"))


@query("""with x as (select vec_id, label, embedding[1]::double as x from embeddings), g as (select vec_id, label, c, abs(x - p) as gap from x, (values (0, -0.4::double), (1, 0.0::double), (2, 0.4::double)) t(c, p)),
 n as (select label, c from g qualify row_number() over (partition by vec_id, label order by gap, c) = 1) select label, c as code, count(*) as n from n group by all""")
def palette_codes(spark, d):
    """How often each palette value is the nearest to the first dimension, by label; a tie goes to the first value."""
    x = F.get("embedding", 0).cast("double")
    near = clusters.nearest_code([F.abs(x - F.lit(p)) for p in (-0.4, 0.0, 0.4)])
    return table(spark, d, "embeddings").select("label", near.alias("code")).groupBy("label", "code").agg(F.count("*").alias("n"))
