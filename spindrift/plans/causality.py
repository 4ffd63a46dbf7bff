"""Queries on compositions, inference, precedence and snapshots over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import inference, snapshots

from .numeric import _r
from .registry import query, table
from .search import _prints, _queries

_PLANE = "case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 4 end"
_FACTS = f"(select a, b, mask, min(cost) as cost from (select user_id as a, lead(user_id) over (partition by event_type order by ts, event_id) as b, {_PLANE} as mask, floor(abs(value))::bigint as cost from events where event_type in ('view', 'click', 'purchase')) where b is not null and cost <= 20 group by all)"
_LEVEL = "case bit_count(mask) when 1 then 'Free' when 2 then 'Pair' else 'Core' end"


@query(f"with recursive f as {_FACTS}, r as (select * from f union select r.a, f.b, r.mask | f.mask, r.cost + f.cost from r join f on r.b = f.a and r.mask & f.mask = 0 and r.cost + f.cost <= 50) select a, b, mask, {_LEVEL} as level, min(cost) as cost from r group by all")
def composed_bindings(spark, d):
    """Chains of users by who follows whom in views, clicks and purchases, composed until all three planes are bound."""
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    after = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    mask = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(4)
    facts = e.select(F.col("user_id").alias("a"), after.alias("b"), mask.alias("mask"), F.floor(F.abs("value")).cast("bigint").alias("cost")).where("b is not null and cost <= 20")
    return inference.compose(facts, limit=50).withColumn("level", inference.level(F.col("mask")))


_WORD = "list_sum(list_transform(range(64), lambda i: case when embedding[i + 1] > 0 then case when i = 63 then -(1::hugeint << 63) else 1::hugeint << i end else 0::hugeint end))::bigint"


@query(f"""with p as (select vec_id, {_WORD} as fp from embeddings), q as (select s.vec_id as query_id, s.fp as s, p.fp as p, o.fp as o, a.fp & b.fp & c.fp as noise from p s join p p on p.vec_id = s.vec_id + 1 join p o on o.vec_id = s.vec_id + 2 join p a on a.vec_id = s.vec_id + 3 join p b on b.vec_id = s.vec_id + 4 join p c on c.vec_id = s.vec_id + 5 where s.vec_id % 100 = 0),
 m as (select query_id, 'Forward' as mode, xor(xor(p, o), xor(p, noise)) as x from q union all select query_id, 'Backward', xor(xor(s, p), xor(p, noise)) from q union all select query_id, 'Abduction', xor(xor(s, p), xor(s, noise)) from q)
 select query_id, mode, min_by(vec_id, [bit_count(xor(x, fp))::bigint, vec_id]) as entry, min(bit_count(xor(x, fp)))::bigint as d from m, p group by all""")
def inferred_slots(spark, d):
    """Three neighbouring prints are subject, predicate and object; one of them is found from the bindings and a noisy other."""
    prints = _prints(spark, d).select("vec_id", "fp")
    q = _queries(prints, query_id="vec_id", s="fp")
    for name, step in (("p", 1), ("o", 2), ("n1", 3), ("n2", 4), ("n3", 5)):
        q = q.join(prints.select((F.col("vec_id") - step).alias("query_id"), F.col("fp").alias(name)), "query_id")
    noise = F.col("n1").bitwiseAND(F.col("n2")).bitwiseAND(F.col("n3"))
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    known = q.select("query_id", xor("s", "p").alias("sp"), xor("p", "o").alias("po"), F.col("p").bitwiseXOR(noise).alias("p"), F.col("s").bitwiseXOR(noise).alias("s"))
    modes = reduce(lambda a, b: a.unionByName(b), [known.withColumn("mode", F.lit(m)) for m in ("Forward", "Backward", "Abduction")])
    return inference.infer(modes, prints.withColumnRenamed("vec_id", "entry"))


_EDGES = "(select a.vec_id, a.embedding as s, b.embedding as t, 1 + a.label as shift from embeddings a join embeddings b on b.vec_id = case when a.vec_id % 10 = 0 then a.vec_id else a.vec_id + 1 end)"
_ASYMMETRY = "list_sum(list_transform(range(64), lambda i: (((s[i + 1] > 0) <> (t[(i - shift + 64) % 64 + 1] > 0)) <> ((t[i + 1] > 0) <> (s[(i - shift + 64) % 64 + 1] > 0)))::int)) / 64.0::double"


def _edges(spark, d):
    p = _prints(spark, d)
    ends = p.select(F.col("vec_id").alias("to"), F.col("fp").alias("target"))
    to = F.when(F.col("vec_id") % 10 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 1)
    return p.select("vec_id", F.col("fp").alias("source"), (1 + F.col("label")).alias("shift"), to.alias("to")).join(ends, "to")


@query(f"select vec_id, round({_ASYMMETRY}, 6) as asymmetry from {_EDGES}")
def edge_asymmetry(spark, d):
    """How far each edge differs from its reverse; an edge to itself has no direction."""
    return _edges(spark, d).select("vec_id", _r(inference.asymmetry(F.col("source"), F.col("shift"), F.col("target"))).alias("asymmetry"))


@query(f"select vec_id, round({_ASYMMETRY}, 6) as asymmetry from {_EDGES} where {_ASYMMETRY} < 0.4")
def non_causal_edges(spark, d):
    return inference.non_causal(_edges(spark, d), 0.4).select("vec_id", _r("asymmetry").alias("asymmetry"))


@query("""with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as mark_id, max_by(value, event_id) as mark_value from events where event_type = 'view' group by all)
 select p.event_id, mark_id, round(abs(p.value - mark_value), 6) as distance, round(sqrt(exp(-(epoch_us(p.ts) - epoch_us(v.ts)) / 1e6 / 86400.0)), 6) as weight from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def preceding_views(spark, d):
    """Each purchase with the user's last view before it: how far apart in value, and how near in time."""
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    v = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark_id"), F.max_by("value", "event_id").alias("mark_value"))
    both = inference.asof(p, v.withColumn("mark_ts", F.col("ts")), ["user_id"], ["ts"], ["mark_id", "mark_value", "mark_ts"])
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    near = inference.temporal_similarity(F.col("value"), inference.recency(seconds("ts"), seconds("ts"), 86400.0), F.col("mark_value"), inference.recency(seconds("mark_ts"), seconds("ts"), 86400.0), lambda a, b: F.abs(a - b))
    return both.select("event_id", "mark_id", near.alias("x")).select("event_id", "mark_id", _r("x.distance").alias("distance"), _r("x.weight").alias("weight"))


_STEPS = [("true", "x::double"), ("vec_id % 7 <> 0", "x::double + case when label % 3 = 0 then 0.05 else 0 end"), ("true", "x::double * case when vec_id % 5 = 0 then 1.25 else 1 end"), ("vec_id % 11 <> 0", "x::double")]
_MERGED = "(" + " union all ".join(f"select vec_id, label, vec_id % 3 as part, {i} as snapshot, list_transform(embedding, lambda x: {x}) as v from embeddings where {w}" for i, (w, x) in enumerate(_STEPS)) + ")"
_MOVED = f"(select *, d > 0.9 as moved from (select *, list_sum(list_transform(list_zip(v, lag(v) over w), lambda z: abs(z[1] - z[2]))) as d, lag(snapshot) over w as since from {_MERGED} window w as (partition by vec_id order by snapshot)) where since is not null)"


def _shifts(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("part"), F.col("embedding").cast("array<double>").alias("v"))
    third, fifth = F.when(F.col("label") % 3 == 0, 0.05).otherwise(0.0), F.when(F.col("vec_id") % 5 == 0, 1.25).otherwise(1.0)
    each = [e, e.where("vec_id % 7 <> 0").withColumn("v", F.transform("v", lambda x: x + third)), e.withColumn("v", F.transform("v", lambda x: x * fifth)), e.where("vec_id % 11 <> 0")]
    return snapshots.moved(snapshots.merged(each, ["vec_id", "label", "part"], "v"), V.l1, 0.9)


@query(f"""with p as (select label, part, snapshot, count(*) as n, count_if(moved) as k, sum(d) as s, sum(d * d) as s2 from {_MOVED} group by all), t as (select *, k::double / n as f, least(1 - 1.0::double / (1 + n), 0.99) as c from p),
 h as (select label, part, count(*) as snapshots, count_if(k > 0)::bigint as shifted, sum(n) as n, sum(s) as s, sum(s2) as s2, sum(c / (1 - c) * f) as pos, sum(c / (1 - c) * (1 - f)) as neg from t group by all)
 select label, part, snapshots, shifted, round(s / n, 6) as mean, round(sqrt(greatest(0, s2 / n - (s / n) * (s / n))), 4) as deviation, round(pos / (pos + neg), 6) as f, round(least((pos + neg) / (pos + neg + 1), 0.9999), 6) as c from h""")
def volatility_map(spark, d):
    """Which parts of each label's vectors moved over four snapshots, how far, and how surely."""
    v = snapshots.volatility(_shifts(spark, d), ["label", "part"])
    return v.select("label", "part", "snapshots", "shifted", _r("mean").alias("mean"), _r("deviation", 4).alias("deviation"), _r("f").alias("f"), _r("c").alias("c"))


_H2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::int))"


@query(f"""with s as (select label as block, avg(case when part = 0 then moved::int end) as q, avg(case when part = 1 then moved::int end) as o, avg(case when part = 2 then moved::int end) as k from {_MOVED} where label in (0, 3, 6) or part <> 2 or snapshot = 3 group by 1),
 b as (select block from s where coalesce(q, 0) > 0.1 and coalesce(o, 0) > 0.1 and coalesce(k, 0) < 0.9),
 g as (select a.label as block, count(*) as total_pairs, count_if({_H2} <= 30) as redundant_pairs from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and b.vec_id <= a.vec_id + 40 where a.label <> 6 group by 1)
 select block, coalesce(redundant_pairs::double / total_pairs, 0) > 0.5 as routing, round(coalesce(redundant_pairs::double / total_pairs, 0), 6) as redundancy from b left join g using (block)""")
def gate_scaffold(spark, d):
    """Blocks whose first two parts moved and whose third mostly didn't, with the redundancy of their nearby prints."""
    shifts = _shifts(spark, d).where("label in (0, 3, 6) or part <> 2 or snapshot = 3").withColumnRenamed("label", "block")
    blocks = snapshots.scaffold_by(shifts, "block", "part", {0: 0.1, 1: 0.1}, {2: 0.9})
    p = _prints(spark, d).where("label <> 6")
    near = p.withColumn("bucket", F.floor(F.col("vec_id") / 40))
    other = near.select("label", F.col("vec_id").alias("b"), F.col("fp").alias("fb"), F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"))
    pairs = near.join(other, ["label", "bucket"]).where("vec_id < b and b <= vec_id + 40")
    gates = pairs.groupBy(F.col("label").alias("block")).agg(F.count("*").alias("total_pairs"), F.count_if(V.hamming(F.col("fp"), F.col("fb")) <= 30).alias("redundant_pairs"))
    return snapshots.gate_scaffold(gates, blocks, "block").withColumn("redundancy", _r("redundancy"))
