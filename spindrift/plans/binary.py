"""Queries on tagged trees and block matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import blocks, tagged

from .registry import query, table
from .search import _prints


def _trees(spark, d):
    c = table(spark, d, "customer")
    inner = tagged.compound("at", tagged.long_tag("nation", F.col("c_nationkey")))
    return c.select("c_custkey", tagged.compound("", tagged.string_tag("name", F.col("c_name")), inner, tagged.long_tag("key", F.col("c_custkey"))).alias("data"))


_N = "strlen(c_name)"


@query(f"select c_custkey, 0 as entry, 3::bigint as tag_offset, 10::bigint as payload_offset from customer union all select c_custkey, 1, 12 + {_N} + 5 + 9 + 8 + 1, 12 + {_N} + 5 + 9 + 8 + 1 + 6 from customer union all select c_custkey, 2, 12 + {_N} + 5, 12 + {_N} + 5 + 9 from customer")
def tagged_places(spark, d):
    """Three named tags in trees of bytes: where they stand, and where what they hold begins."""
    return tagged.scan(_trees(spark, d), "c_custkey", "data", [(8, "name"), (4, "key"), (4, "nation")])


@query(f"""select c_custkey, '' as path, 10 as tag, 3::bigint as payload_offset, 0 as depth from customer union all select c_custkey, '/name', 8, 10, 1 from customer union all select c_custkey, '/at', 10, 12 + {_N} + 5, 1 from customer
 union all select c_custkey, '/at/nation', 4, 12 + {_N} + 5 + 9, 2 from customer union all select c_custkey, '/key', 4, 12 + {_N} + 5 + 9 + 8 + 1 + 6, 1 from customer""")
def tagged_trees(spark, d):
    """All tags of the trees with their paths and depths."""
    return tagged.tags(_trees(spark, d), "c_custkey", "data")


@query("""with x as (select i, (i * 7 % 13 - 6)::double as x from range(256) t(i)), e as (select vec_id, k, list_sum(list_transform(list_filter(range(64), lambda c: embedding[c + 1] > 0), lambda c: ((4 * c + k) * 7 % 13 - 6)::double)) as v from embeddings, range(4) u(k))
 select vec_id // 64 as bi, (vec_id % 64) * 4 + k as i, coalesce(v, 0) as v from e where vec_id // 64 < (select max(vec_id) // 64 from embeddings)""")
def block_product(spark, d):
    """Prints as rows of blocks of a sparse matrix, 64 to a tile, times a vector of 256 numbers; the last tile isn't whole."""
    p = _prints(spark, d).select(F.floor(F.col("vec_id") / 64).alias("bi"), (F.col("vec_id") % 64).alias("r"), "fp")
    tiles = p.groupBy("bi").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "fp"))), lambda s: s["fp"]).alias("masks")).withColumn("bj", F.lit(0).cast("bigint"))
    x = spark.range(1).select(F.col("id").alias("bj"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (i * 7 % 13 - 6).cast("double")).alias("x"))
    last = p.agg(F.max("bi").alias("last"))
    y = blocks.product(tiles.crossJoin(F.broadcast(last)).where("bi < last").drop("last"), x)  # one row
    return y.select("bi", F.posexplode("y").alias("i", "v")).select("bi", F.col("i").cast("bigint").alias("i"), "v")


@query("""with t as (select vec_id // 64 as bi, vec_id % 64 as r, embedding from embeddings where vec_id // 64 < (select max(vec_id) // 64 from embeddings)), q as (select vec_id as query_id, embedding from embeddings where vec_id % 100 = 0),
 s as (select query_id, bi, r, list_sum(list_transform(list_zip(t.embedding, q.embedding), lambda z: (z[1] > 0 and z[2] > 0)::int)) as score from t, q) select query_id, bi, min_by(r, [-score, r])::int as best, (64 - max(score))::int as distance, count_if(score >= 20)::bigint as fired from s group by all""")
def block_attention(spark, d):
    """Which row of each tile has most in common with each query, and how many rows have 20 bits or more."""
    from spindrift.operators import search

    p = _prints(spark, d)
    rows = p.select(F.floor(F.col("vec_id") / 64).alias("bi"), (F.col("vec_id") % 64).alias("r"), "fp")
    tiles = rows.groupBy("bi").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "fp"))), lambda s: s["fp"]).alias("masks")).where(F.size("masks") == 64)
    last = rows.agg(F.max("bi").alias("last"))
    tiles = tiles.crossJoin(F.broadcast(last)).where("bi < last").drop("last")  # one row
    pairs = search.pair_with(tiles, p.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q")))
    a = pairs.select("query_id", "bi", blocks.attend(F.col("masks"), F.col("q"), 20).alias("a"))
    return a.select("query_id", "bi", "a.best", "a.distance", F.bit_count("a.fires").cast("bigint").alias("fired"))
