"""Arrays, palettes and searches where SQL has no say: errors, repeatability, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import bits, palette
from spindrift.functions import vectors as V
from spindrift.operators import linalg, search, shapes


def test_shapes_that_do_not_fit(spark):
    flat = spark.range(5).select(F.col("id").alias("i0"), F.lit(1.0).alias("v"))
    with pytest.raises(ValueError):
        shapes.from_flat(flat, (2, 3))
    with pytest.raises(ValueError):
        shapes.reshape(flat, (5,), (2, 2))
    with pytest.raises(ValueError):
        shapes.multi_slice(flat, 0, [(0, 3), (2, 4)])
    assert shapes.element(flat, 9).first()["v"] is None
    none = flat.where("i0 > 9")
    assert shapes.ends(none).first() == (None, None) and shapes.any_of(none, F.lit(True)).first()[0] is False


def test_random_arrays_repeat(spark):
    a, b = (shapes.random(spark, (40, 25), 3, normal=True).orderBy("i0", "i1").collect() for _ in range(2))
    assert a == b and a != shapes.random(spark, (40, 25), 4, normal=True).orderBy("i0", "i1").collect()
    v = np.asarray([r["v"] for r in a])
    assert abs(v.mean()) < 0.1 and abs(v.std() - 1) < 0.1
    drawn = shapes.sample_axis(shapes.random(spark, (40, 25), 3), 0, 40, 12, 1)
    assert drawn.count() == 12 * 25 and drawn.select("i0").distinct().count() == 12


def test_fitted_palette_is_no_worse_than_its_seeds(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes = e.select(palette.project(F.col("embedding").cast("array<double>")).alias("c"))
    x = np.asarray([r["c"] for r in codes.collect()], np.int64)
    gap = lambda p: np.abs(x[:, None] - np.asarray(p, np.int64)[None]).sum(2).min(1).mean()
    seeds, fitted = palette.build_palette(codes, "c", 24, rounds=0), palette.build_palette(codes, "c", 24, rounds=5)
    assert len(fitted) == 24 and gap(fitted) < gap(seeds)
    assert palette.build_palette(codes.where("c is null"), "c", 4) == []


def test_singular_and_indefinite_matrices(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 2.0, 4.0]), (2, [0.0, 1.0, 1.0, 0.0])], "k bigint, a array<double>")
    lu = {r["k"]: r for r in linalg.lu(rows, "k", "a", 2).collect()}
    assert lu[1]["upper"][3] == 0 and lu[2]["pivots"] == [1.0, 0.0]
    low = {r["k"]: r["lower"] for r in linalg.cholesky(rows, "k", "a", 2).collect()}
    assert np.isnan(low[2]).any()


def test_difference_codes_decode_distances(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, *[rnd.integers(0, 256, 24).tolist() for _ in range(2)]) for i in range(20)]
    rows = [(i, c, [y if j % 3 == 0 else x for j, (x, y) in enumerate(zip(c, p))], rnd.integers(0, 256, 24).tolist()) for i, c, p in rows]
    frame = spark.createDataFrame(rows, "i bigint, c array<int>, p array<int>, q array<int>")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = frame.select(bits.hamming_to_difference(F.col("q"), F.col("c"), bits.xor_difference(F.col("c"), F.col("p")), apart(F.col("q"), F.col("c"))).alias("found"), apart(F.col("q"), F.col("p")).alias("d"))
    assert all(r["found"] == r["d"] for r in out.collect())


def test_recall_of_sign_prints_and_of_the_statistical_cascade(spark):
    """How many of the ten nearest rows by cosine are among the 30 nearest by 1,024 sign bits; how few the cascade loses."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    s = search.simhash(e, "vec_id", "embedding").cache()
    x = {r["vec_id"]: np.asarray(r["embedding"], float) for r in e.collect()}
    hits = total = 0
    for q in (0, 100, 200, 300, 400):
        words = s.where(F.col("vec_id") == q).first()["words"]
        near = search.top_k(s.select("vec_id", V.hamming_words(F.col("words"), F.array(*[F.lit(w) for w in words])).alias("d")), "d", "vec_id", 30)
        cosine = lambda v, q=q: float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q]))
        best = sorted(x, key=lambda i: (-cosine(x[i]), i))[:10]
        hits += len(set(best) & {r["vec_id"] for r in near.collect()})
        total += 10
        lit = F.array(*[F.lit(w) for w in words])
        exact = {r["vec_id"] for r in search.cascade(s, lit, 480, [(0, 2), (2, 4), (6, 10)]).collect()}
        some = {r["vec_id"] for r in search.cascade(s, lit, 480, [(0, 2), (2, 4), (6, 10)], statistical=True).collect()}
        assert some <= exact and len(some) >= 0.9 * len(exact)
    assert hits >= 0.9 * total


def test_nearest_points_of_far_and_undefined_queries(spark):
    from spindrift.operators import spatial

    rnd = np.random.default_rng(8)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rnd.random((30, 3)))], "id bigint, x double, y double, z double")
    asked = [(1, 0.5, 0.5, 0.5), (2, 1e6, 0.0, 0.0), (3, float("nan"), 0.0, 0.0)]
    queries = spark.createDataFrame(asked, "query_id bigint, x double, y double, z double")
    found = {}
    for r in spatial.knn_join(points, queries, 3, 0.1, rounds=4).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    x = {r["id"]: np.asarray([r["x"], r["y"], r["z"]]) for r in points.collect()}
    for q, *at in asked[:2]:
        assert found[q] == sorted(x, key=lambda i: (((x[i] - at) ** 2).sum(), i))[:3]
    assert found[3] == [0, 1, 2]
