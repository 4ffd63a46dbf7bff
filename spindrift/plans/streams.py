"""Queries on keyed state: the batch twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.streaming import stateful

from .numeric import _r
from .registry import query, table

_HELP = "case when value >= 100 then 1.0 else greatest(value, 0) / 100 end"
_PRINT = "((event_id * 2654435761 + user_id * 40503) % 65536)"
_JUMP = "(floor(value)::bigint % 5 + case when day(ts) > 20 then 5000 else 500 end)::double"


def _rows(spark, d):
    e = table(spark, d, "events")
    help_ = F.when(F.col("value") >= 100, 1.0).otherwise(F.greatest(F.col("value"), F.lit(0.0)) / 100)
    return e.select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), help_.alias("value"), ((F.col("event_id") * 2654435761 + F.col("user_id") * 40503) % 65536).alias("print"), (F.floor("value").cast("bigint") % 5 + F.when(F.dayofmonth("ts") > 20, 5000).otherwise(500)).cast("double").alias("distance"))


@query(f"""with s as (select event_type as key, event_id as seq, row_number() over w as rounds, 0.5 + 4 * sum({_HELP}) over w as p, 0.5 + 4 * sum(1 - {_HELP}) over w as n from events window w as (partition by event_type order by ts, event_id rows unbounded preceding)),
 t as (select key, seq, rounds, p / (p + n) as f, least((p + n) / (p + n + 1), 0.9999) as c from s) select key, seq, rounds, round(f, 6) as f, round(c, 6) as c, case when c <= 0.7 then 'Explore' when f > 0.6 then 'Reinforce' when f < 0.3 then 'Suppress' else 'Explore' end as action from t""")
def head_beliefs(spark, d):
    """Every event's feedback revises its type's truth."""
    return stateful.beliefs_twin(_rows(spark, d)).withColumn("f", _r("f")).withColumn("c", _r("c"))


@query(f"""with s as (select event_type as key, event_id as seq, row_number() over w as iteration, bit_count(xor({_PRINT}, lag({_PRINT}) over w))::bigint as d1, bit_count(xor({_PRINT}, lag({_PRINT}, 2) over w))::bigint as d2 from events window w as (partition by event_type order by ts, event_id))
 select *, case when d1 is null then 'first' when d1 = 0 then 'settled' when d2 < d1 then 'returning' else 'moving' end as phase from s""")
def print_trajectory(spark, d):
    """Prints of a type's events against the one before and the one before that."""
    return stateful.iterations_twin(_rows(spark, d))


@query(f"""with s as (select event_type as key, ts, event_id as seq, count(*) over w as n, avg({_JUMP}) over w as mean, stddev_pop({_JUMP}) over w as sigma from events window w as (partition by event_type order by ts, event_id rows unbounded preceding)),
 a as (select *, coalesce(n > 10 and lag(sigma) over w > 0 and abs(mean - lag(mean) over w) > 2 * lag(sigma) over w, false) as alert from s window w as (partition by key order by ts, seq))
 select key, seq, n, round(mean, 4) as mean, round(sigma, 4) as sigma, alert, coalesce(last_value(case when alert then floor(mean + 3 * sigma)::bigint end ignore nulls) over (partition by key order by ts, seq rows unbounded preceding), 1000) as threshold from a""")
def recalibrated_thresholds(spark, d):
    """Thresholds set anew where distances jump, at the end of the month."""
    rows = _rows(spark, d).withColumn("value", F.col("distance"))
    return stateful.recalibration_twin(rows, 1000).withColumn("mean", _r("mean", 4)).withColumn("sigma", _r("sigma", 4))


@query(f"""with f as (select event_type as key, ts, {_PRINT} as print, row_number() over (partition by event_type order by ts, event_id) as turn from events),
 b as (select key, max(ts) as moment, count(*) as n, list(print) as ps from f where turn <= 25 group by 1 having count(*) = 25),
 v as (select key, moment, list_sum(list_transform(range(16), lambda i: case when 2 * len(list_filter(ps, lambda p: (p >> i) & 1 = 1)) > n then 1 << i else 0 end))::bigint as print from b)
 select key, 'Flow' as gate, moment as "at", print from v union all select key, 'Freeze', moment + interval 1 day, print from v where moment + interval 1 day < (select max(ts) from events)""")
def crystallized_prints(spark, d):
    """The majority of a type's first 25 prints, frozen a day later."""
    return stateful.crystallize_twin(_rows(spark, d), 16, 25, 86_400_000)
