"""Hard negatives against brute force, with blocks and leaves small enough that the whole tree is used."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<float>, row string, query string, block string"


def expected(rows, anchor=lambda k: k % 50 == 0):
    """rows: (vec_id, label, vector)."""
    usable = [(k, label, [math.floor(256 * float(np.float32(x))) for x in v]) for k, label, v in rows if None not in (k, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (k, label, v) in enumerate(usable):
        if not anchor(k):
            continue
        others = [(-dot(v, w), o, m) for j, (o, m, w) in enumerate(usable) if j != i]
        for s, p, _ in sorted(x for x in others if x[2] == label)[:5]:
            inside = sorted(x for x in others if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(k, p, r + 1, o, -s, -t) for r, (t, o, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, anchors=None):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    found = hn.hard_negatives(frame, F.col("vec_id") % 50 == 0 if anchors is None else anchors)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK_ROWS", 40), ("LEAF_ROWS", 4), ("SAMPLE_ROWS", 100), ("MOST_LEVELS", 3), ("QUERIES", 3)):
        monkeypatch.setattr(hn, name, n)


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_equals_brute_force(spark, small, kind):
    rnd = np.random.default_rng(7)
    n = 400
    at = rnd.normal(size=(8, 6)) * 3
    v = {"clusters": lambda: at[rnd.integers(8, size=n)] + rnd.normal(size=(n, 6)) * 0.2, "noise": lambda: rnd.normal(size=(n, 6)), "ties": lambda: rnd.integers(-1, 2, size=(n, 6)) / 4}[kind]()
    rows = [(i, int(rnd.integers(0, 2 if i % 3 else 1)), [float(x) for x in v[i]]) for i in range(n)]
    got = run(spark, rows, F.col("vec_id") % 20 == 0)
    assert got == expected(rows, lambda k: k % 20 == 0) and len(got) > 30


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.4, 0.4]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [None, 1.0]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (None, 2, [0.5, 0.5])]
    rows += [(50, 3, []), (100, 1, [1.0]), (150, 2, [0.6, 0.4, 0.1]), (9, 2, [0.5, 0.5]), (200, 9, [5.0, 5.0]), (10, 1, [-1.0, -1.0])]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == [] and run(spark, [(50, 1, [1.0])]) == []
    # Rows that repeat a vec_id stay rows.
    twice = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5])]
    got = run(spark, twice)
    assert got == expected(twice) and len(got) > 4


def test_large_components(spark, small):
    rnd = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rnd.normal(size=4) * 1e5]) for i in range(120)]
    assert run(spark, rows) == expected(rows) and len(expected(rows)) > 5
    assert run(spark, [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 0.0]), (2, 2, [3e38, 3e38])]) == []


def test_visits_few_leaves_where_vectors_cluster(spark, small):
    """Bounds leave out (query, block) pairs of clustered vectors."""
    rnd = np.random.default_rng(3)
    at = rnd.normal(size=(16, 8)) * 4
    rows = [(i, i % 2, [float(x) for x in at[i % 16] + rnd.normal(size=8) * 0.05]) for i in range(1600)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    ix = hn.index(hn.quantised(frame, "embedding"))
    assert ix.top.levels == 3 and sum(ix.subs) > 30
    no_bound = F.array(F.struct(F.lit(0).alias("w"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")))
    asked = ix.rows.where("vec_id % 100 = 0").select(F.col("row").alias("query"), "label", "v", F.lit(True).alias("same"), no_bound.alias("windows"))
    near = hn._visit(ix, hn._routed(ix, asked, True), 5)
    caps = hn._ranked(near, 5).where("rank = 5").select("query", "score")
    narrowed = asked.join(caps, "query").withColumn("windows", F.array(F.struct(F.lit(0).alias("w"), F.col("score").alias("lo"), F.lit(None).cast("bigint").alias("hi")))).drop("score")
    pairs = hn._routed(ix, asked, True).count() + hn._routed(ix, narrowed, False).count()
    assert pairs < 0.75 * asked.count() * sum(ix.subs)


def test_equals_sql(spark):
    import duckdb

    from spindrift.llm import oracle, queries

    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("sf0.1 isn't here")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    found = queries.op13_hard_negatives(spark, sf)
    names = sorted(found.columns)
    want = con.execute(f"select {', '.join(names)} from ({oracle.HARD_NEGATIVES})").fetchall()
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want)
