"""Operators on small inputs: edge cases, brute force and round trips."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.functions import bits, halves
from spindrift.functions import vectors as V
from spindrift.operators import arrays, graph, linalg, search, spatial, truth, windows
from spindrift.plans.spec import ScanSpec
from spindrift.sources import tensors
from spindrift.streaming import drift


def test_pair_with_goes_by_bytes(spark, monkeypatch):
    """Few but large queries are dealt to blocks too; nulls and nested arrays are measured."""
    base = spark.range(5).toDF("a")
    rows = [(i, [[float(i)] * 40] * 3, "x" * i, None) for i in range(6)] + [(9, None, None, [1])]
    queries = spark.createDataFrame(rows, "q bigint, t array<array<double>>, s string, w array<int>")
    want = sorted((r["a"], r["q"]) for r in search.pair_with(base, queries).collect())
    monkeypatch.setattr(search, "BROADCAST_BYTES", 2_000)
    pairs = search.pair_with(base, queries)
    assert sorted((r["a"], r["q"]) for r in pairs.collect()) == want and len(want) == 35
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join Cross") >= 3


def test_pair_with_blocks_equals_broadcast(spark):
    base, queries = spark.range(40).toDF("a"), spark.range(7).toDF("q")
    assert sorted(map(tuple, search.pair_with(base, queries, block_rows=2).collect())) == sorted(map(tuple, search.pair_with(base, queries).collect()))


@pytest.mark.parametrize("k", [0, 1, 3, 99])
def test_top_k_edges(spark, k):
    frame = spark.createDataFrame([(i, d) for i, d in enumerate([5, 3, 3, 0, 64])], "vec_id bigint, d int")
    assert [r["vec_id"] for r in search.top_k(frame, "d", "vec_id", k).collect()] == [3, 1, 2, 0, 4][:k]


def test_sign_word_uses_the_top_bit(spark):
    v = [1.0] * 64
    row = spark.createDataFrame([(v, [-x for x in v], None)], "a array<double>, b array<double>, c array<double>").select(V.sign_word(F.col("a")).alias("a"), V.sign_word(F.col("b")).alias("b"), V.sign_word(F.col("c")).alias("c")).first()
    assert row["a"] == -1 and row["b"] == 0 and row["c"] is None


def test_exact_cascade_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    words = rnd.integers(-(2**63), 2**63 - 1, (60, 16))
    words[1:30] = words[0] ^ (1 << rnd.integers(0, 60, (29, 16)))
    frame = spark.createDataFrame([(i, [int(x) for x in w]) for i, w in enumerate(words)], "vec_id bigint, words array<bigint>")
    q = F.array(*[F.lit(int(x)) for x in words[0]])
    found = {r["vec_id"]: r["d"] for r in search.cascade(frame, q, 100, [(0, 2), (2, 4), (6, 10)]).collect()}
    d = {i: sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(w, words[0])) for i, w in enumerate(words)}
    assert found == {i: x for i, x in d.items() if x <= 100}


def test_pivot_radius_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    fps = [int(x) for x in rnd.integers(-(2**63), 2**63 - 1, 80)]
    frame = spark.createDataFrame(list(enumerate(fps)), "vec_id bigint, fp bigint")
    found = {r["vec_id"] for r in search.pivot_radius(frame, fps[0], 28, fps[:5]).collect()}
    assert found == {i for i, x in enumerate(fps) if bin((x ^ fps[0]) & (2**64 - 1)).count("1") <= 28}


def test_majority_ties_clear_the_bit(spark):
    frame = spark.createDataFrame([("a", 0b11), ("a", 0b01), ("b", 0b10)], "g string, fp bigint")
    assert {r["g"]: r["majority"] for r in search.majority(frame, ["g"]).collect()} == {"a": 0b01, "b": 0b10}


def test_lsh_and_pq_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    s = search.simhash(e, "vec_id", "embedding").cache()
    q = s.where("vec_id % 100 = 0")
    every = search.pair_with(s, q.select(F.col("vec_id").alias("query_id"), F.col("words").alias("q"))).select("query_id", "vec_id", V.hamming_words(F.col("words"), F.col("q")).alias("d"))
    exact = {(r["query_id"], r["vec_id"]) for r in search.top_k_per(every, "query_id", "d", "vec_id", 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in search.lsh_candidates(s, q, band_bits=8).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("scale", ["sf0.1", "check_s"])
def test_pq_recall_of_all_queries(spark, scale):
    from spindrift.plans import catalog

    if not os.path.exists(f"/root/testdata/{scale}/embeddings.parquet"):
        pytest.skip(f"{scale} isn't here")
    rows = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.asarray([r["embedding"] for r in rows], np.float64), np.asarray([r["vec_id"] for r in rows])
    found = {}
    for r in catalog.QUERIES["pq_adc_topk"](spark, f"/root/testdata/{scale}").collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["d"]
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, near in found.items():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        best = np.lexsort((ids, d))[:10]
        hits += len(near.keys() & {int(i) for i in ids[best]})
        at = {int(i): float(v) for i, v in zip(ids, d)}
        assert len(near) == 10 and all(abs(at[i] - v) < 1e-5 for i, v in near.items())
    print("recall", hits / (10 * len(found)), len(ids))
    assert hits >= 0.9 * 10 * len(found)


def test_spatial_joins_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    p = rnd.random((120, 3)) * 4
    frame = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id bigint, x double, y double, z double")
    queries = frame.where("id < 15").withColumnRenamed("id", "query_id")
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = {(r["query_id"], r["id"]) for r in spatial.radius_join(frame, queries, 0.9).collect()}
    assert near == {(q, i) for q in range(15) for i in range(120) if d2[q, i] <= 0.81}
    knn = {(r["query_id"], r["rank"]): r["id"] for r in spatial.knn_join(frame, queries, 4, 0.05).collect()}
    assert knn == {(q, n + 1): int(i) for q in range(15) for n, i in enumerate(np.argsort(d2[q], kind="stable")[:4])}


def test_truth_revision_adds_evidence(spark):
    frame = spark.createDataFrame([("a", 0.9, 0.5), ("a", 0.1, 0.5), ("b", 0.8, 0.8)], "g string, f double, c double")
    got = {r["g"]: (round(r["f"], 6), round(r["c"], 6)) for r in truth.revise(frame, ["g"], "f", "c").collect()}
    assert got == {"a": (0.5, round(2 / 3, 6)), "b": (0.8, 0.8)}


def test_windows_and_chunks(spark):
    series = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "g string, i int, v double")
    assert sorted(r["total"] for r in windows.sliding(series, ["g"], "i", "v", 4, 3).collect()) == [6.0, 18.0, 30.0]
    assert windows.sliding(series, ["g"], "i", "v", 11).count() == 0
    assert [r["n"] for r in windows.chunks(series, ["g"], "i", "v", 4, exact=False).orderBy("chunk").collect()] == [4, 4, 2]
    assert windows.chunks(series, ["g"], "i", "v", 4).count() == 2
    with pytest.raises(ValueError):
        windows.sliding(series, ["g"], "i", "v", 0)


def test_shapes(spark):
    with pytest.raises(ValueError):
        arrays.reshape(spark.createDataFrame([(0, 0, 1.0)], "i0 bigint, i1 bigint, v double"), (1, 1), (2, 2))
    with pytest.raises(ValueError):
        arrays.geomspace(spark, -1.0, 2.0, 3)
    a = arrays.indices(spark, 3, 4).withColumn("v", (F.col("i0") * 4 + F.col("i1")).cast("double"))
    back = arrays.reshape(arrays.reshape(a, (3, 4), (6, 2)), (6, 2), (3, 4))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, a.collect()))


def test_factorisations(spark):
    rnd = np.random.default_rng(4)
    m = rnd.random((5, 3, 3))
    m = m @ m.transpose(0, 2, 1) + np.eye(3)
    x = rnd.random((5, 3))
    rows = [(i, a.reshape(-1).tolist(), (a @ b).tolist()) for i, (a, b) in enumerate(zip(m, x))] + [(9, [0.0] * 9, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "id bigint, a array<double>, b array<double>")
    for method in ("lu", "cholesky", "qr"):
        got = {r["id"]: r["v"] for r in linalg.solve(frame, "id", "a", "b", 3, method).collect()}
        assert got[9] is None
        assert all(np.allclose(got[i], x[i]) for i in range(5))


def test_bit_vectors(spark):
    rnd = np.random.default_rng(5)
    words = [int(x) for x in rnd.integers(-(2**63), 2**63 - 1, 4)]
    whole = sum((w & (2**64 - 1)) << (64 * i) for i, w in enumerate(words))
    frame = spark.createDataFrame([(words,)], "w array<bigint>")
    for shift in (0, 1, 63, 64, 100, 255, -1, -70):
        got = frame.select(bits.rotate(F.col("w"), 4, shift).alias("r")).first()["r"]
        s = shift % 256
        assert sum((w & (2**64 - 1)) << (64 * i) for i, w in enumerate(got)) == ((whole << s) | (whole >> (256 - s))) & (2**256 - 1)
    odd = spark.createDataFrame([([1, 2, 15],), ([],)], "c array<int>").select("c", bits.nibble_pack(F.col("c")).alias("p")).select("c", bits.nibble_unpack(F.col("p"), F.size("c")).alias("u"))
    assert all(r["c"] == r["u"] for r in odd.collect())
    for width in (2, 4, 8, 16):
        codes = spark.createDataFrame([([3, 0, 1, 2, 3],)], "c array<int>").select(V.unpack_codes(V.pack_codes(F.col("c"), width), width, F.lit(5)).alias("u")).first()["u"]
        assert codes == [3, 0, 1, 2, 3]


def test_bf16_rounds_to_even():
    x = np.asarray([1.0, 1.00390625, 1.01171875, -2.5, 3.4e38, np.inf, np.nan], np.float32)
    back = halves.from_bf16(halves.to_bf16(x))
    assert back[0] == 1.0 and back[1] == 1.0 and back[2] == np.float32(1.015625) and back[3] == -2.5 and np.isinf(back[5]) and np.isnan(back[6])


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 41), (41, 42), (40, 42)]
    found = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(21)}, 40: 40, 41: 40, 42: 40}


def test_safetensors_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(6)
    data = {f"blk.{b}.attn_q.weight": rnd.random((7, 5)).astype(np.float32) for b in range(2)}
    rows = [(n, i, [float(x) for x in r]) for n, m in data.items() for i, r in enumerate(m)]
    folder = f"file://{tmp_path}/weights"
    tensors.write_safetensors(spark.createDataFrame(rows, "name string, row bigint, v array<double>"), folder)
    directory = tensors.list_tensors(spark, folder)
    assert {(r["name"], tuple(r["shape"]), r["dtype"]) for r in directory.collect()} == {(n, (7, 5), "F32") for n in data}
    got = tensors.tensor_rows(tensors.find_tensors(directory, "blk.1"), block_bytes=48).collect()
    assert len(got) == 7 and all(np.allclose(r["v"], data["blk.1.attn_q.weight"][r["row"]]) for r in got)
    assert directory.select(tensors.layer_type().alias("t")).distinct().first()["t"] == "query"


def test_gguf(spark, tmp_path):
    a, b = np.arange(12, dtype="<f4").reshape(3, 4), np.zeros(1, np.dtype([("d", "<f2"), ("q", "i1", 32)]))
    b["d"], b["q"] = 0.5, np.arange(32) - 16
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    head = b"GGUF" + struct.pack("<IQQ", 3, 2, 2) + text("general.name") + struct.pack("<I", 8) + text("x") + text("list") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 1, 2)
    head += text("a") + struct.pack("<IQQIQ", 2, 4, 3, 0, 0) + text("b") + struct.pack("<IQIQ", 1, 32, 8, 64)
    head += bytes(-len(head) % 32)
    (tmp_path / "m.gguf").write_bytes(head + a.tobytes() + bytes(64 - a.nbytes) + b.tobytes())
    directory = tensors.list_tensors(spark, f"file://{tmp_path}")
    got = {(r["name"], r["row"]): r["v"] for r in tensors.tensor_rows(directory).collect()}
    assert got["a", 2] == [8.0, 9.0, 10.0, 11.0] and got["b", 0][:2] == [-8.0, -7.5]


def test_scan_specs():
    for bad in ({"version": 2, "kernel": "hamming"}, {"version": 1, "kernel": "none"}, {"version": 1, "kernel": "dot", "scan": {"top_k": -1}}):
        with pytest.raises(ValueError):
            ScanSpec.parse(json.dumps(bad))


def test_drift_alerts():
    state, alerts = (0, 0.0, 0.0), []
    for v in [500 + (i % 3) for i in range(20)] + [5000] * 2:
        state, alert = drift.observe(state, v)
        alerts.append(alert)
    assert not any(alerts[:20]) and alerts[20]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select("ts", "event_type", "user_id", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, user_id bigint, value double").parquet(str(tmp_path / "in"))
    edges = [50.0, 100.0, 200.0]

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    hist = run(drift.window_histogram(stream, "event_type", "ts", "value", edges), "hist", "complete")
    assert sorted(map(tuple, hist.collect())) == sorted(map(tuple, drift.window_histogram(events, "event_type", "ts", "value", edges).collect()))
    seen = run(drift.beliefs(stream, "event_type", "ts", "value", 100.0), "beliefs", "complete")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, drift.beliefs(events, "event_type", "ts", "value", 100.0).collect()))
    alerts = run(drift.detect(stream, "event_type"), "alerts", "append")
    assert alerts.count() == events.count() and alerts.where("n = 1").count() == events.select("event_type").distinct().count()


def test_prototype_lookup_asks_all_labels(spark, tmp_path):
    """A print that lies nearer to another label's prototype than to its own is given that one."""
    from spindrift.plans import catalog

    one, two = [1.0] * 64, [-1.0] * 64
    rows = [(0, one, 1), (1, one, 1), (2, [-1.0] * 3 + [1.0] * 61, 1), (3, two, 2), (4, two, 2), (5, [1.0] * 60 + [-1.0] * 4, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: (r["of"], r["d"]) for r in catalog.QUERIES["prototype_lookup"](spark, str(tmp_path)).collect()}
    assert found == {0: (1, 0), 1: (1, 0), 2: (1, 3), 3: (2, 0), 4: (2, 0), 5: (1, 4)}


def test_words_of_a_vocabulary(spark):
    from spindrift.operators import words

    vocabulary = spark.createDataFrame([("my", "own", 8), ("friend", "person", 7), ("friend", "good", 5), ("not", "no", 10)], "word string, prime string, weight bigint")
    texts = spark.createDataFrame([(1, "My\u00a0friend, MY -friend-; xyz 12"), (2, "xyz"), (3, None), (4, "not my")], "doc_id bigint, text string")
    found = words.decompose(texts, vocabulary, "doc_id")
    assert {(r["doc_id"], r["prime"]): r["weight"] for r in found.collect()} == {(1, "own"): 16, (1, "person"): 14, (1, "good"): 10, (4, "no"): 10, (4, "own"): 8}
    assert {(r["doc_id"], r["prime"]) for r in words.dominant(found, 2).collect()} == {(4, "no")}
    like = {(r["query"], r["doc_id"]): r["similarity"] for r in words.similarity(found, found.where("doc_id = 1"), "doc_id").collect()}
    norm = lambda *x: sum(v * v for v in x) ** 0.5
    assert like == {(1, 1): pytest.approx(1.0), (1, 4): pytest.approx(16 * 8 / norm(16, 14, 10) / norm(10, 8))}
    prints = {r["doc_id"]: r["fp"] for r in words.fingerprint(found, "doc_id").collect()}
    one = {r["prime"]: r["fp"] for r in words.fingerprint(found.select(F.col("prime").alias("k"), "prime", "weight").dropDuplicates(["k"]), "k").withColumnRenamed("k", "prime").collect()}
    assert prints[1] == [a ^ b ^ c for a, b, c in zip(one["own"], one["person"], one["good"])] and len(prints[1]) == 16
    tagged = spark.createDataFrame([("a", "x x y"), ("b", "x"), (None, "x x x x"), ("b", None)], "tag string, text string")
    assert {tuple(r) for r in words.tag_vocabulary(tagged, "tag").collect()} == {("x", "a", 6), ("x", "b", 3), ("y", "a", 10)}




def test_order_statistic(spark):
    from spindrift.operators import norms

    x = [3.0, -1.5, 3.0, 0.1, 7.25, 3.0, -1e9, 2.5e8, 0.1]
    frame = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "x double")
    assert [norms.order_statistic(frame, "x", i, 4) for i in range(len(x))] == sorted(x)
    assert norms.order_statistic(frame, "x", len(x)) is None and norms.order_statistic(frame.where("x = 4"), "x", 0) is None


def test_norm_bounds_read_few_rows(spark):
    """Rows of norms that fall fast: exact answers from a small part of the rows; nulls, ties and k beyond the table."""
    from spindrift.operators import norms

    rnd = np.random.default_rng(2)
    v = np.round(rnd.normal(size=(600, 5)) * np.exp(-np.arange(600) / 60)[:, None] * 1000)
    v[10] = v[11]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 5), (902, [float("inf")] + [0.0] * 4)]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    index = norms.norm_index(frame, "id", "v")
    queries = frame.where("id in (0, 10, 300, 901)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    base = {i: np.array(x) for i, x in rows[:600]} | {901: np.zeros(5)}
    for k in (3, 1000):
        best, reads = norms.max_product(index, queries, k)
        found = {}
        for r in best.collect():
            found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["id"]))
        for q in (0, 10, 300, 901):
            want = sorted((-float(x @ base[q]), i) for i, x in base.items())[:k]
            assert [(a, b) for _, a, b in sorted(found[q])] == want
        read = {r["query_id"]: r["rows_read"] for r in reads.collect()}
        assert all(read[q] <= (150 if k == 3 else 601) for q in (0, 10, 300)) and read[901] == 601
    best, reads = norms.max_product(norms.norm_index(frame.where("id < 0"), "id", "v"), queries, 3)
    assert best.count() == 0 and reads.count() == 0


def test_hamming_rings(spark):
    from spindrift.operators import norms

    rnd = np.random.default_rng(8)
    rows = [(i, [int(x) - 2**63 for x in rnd.integers(0, 2**64, 4, dtype=np.uint64)]) for i in range(200)] + [(500, [0] * 4), (501, [-1] * 4), (502, None)]
    frame = spark.createDataFrame(rows, "id bigint, words array<bigint>")
    queries = frame.where("id in (3, 500, 501)").select(F.col("id").alias("query_id"), F.col("words").alias("q"))
    best, reads = norms.hamming_candidates(norms.ones_index(frame, "id", "words"), queries, 5)
    found = sorted((r["query_id"], r["rank"], r["d"], r["id"]) for r in best.collect())
    count = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    at = {i: w for i, w in rows if w}
    want = [(q, n + 1, *x) for q in (3, 500, 501) for n, x in enumerate(sorted((count(w, at[q]), i) for i, w in at.items())[:5])]
    assert found == want
    assert {r["query_id"]: r["rows_read"] for r in reads.collect()}[3] <= 202


def test_approximate_norms(spark):
    from spindrift.operators import norms

    frame = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, []), (3, None), (4, [-1e6, 1.0])], "id bigint, v array<double>")
    found = {r["id"]: r["n"] for r in frame.select("id", norms.approx_norm(F.col("v")).alias("n")).collect()}
    assert abs(found[0] - 5) < 0.05 and found[1] == found[2] == 0 and found[3] is None and found[4] == pytest.approx(1e6)
    assert [r["id"] for r in norms.top_by_norm(frame, "id", "v", 2).collect()] == [4, 0]


def _prints_of(rnd, centers, n, noise, words=4):
    """n prints around centres, with a few bits flipped."""
    at = [[int(x) for x in rnd.integers(0, 2**63, words)] for _ in range(centers)]
    rows = []
    for i in range(n):
        w = list(at[i % centers])
        for b in rnd.integers(0, 64 * words, rnd.integers(0, noise + 1)):
            w[b // 64] ^= 1 << int(b % 64)
        rows.append((i, [x - 2**64 if x >= 2**63 else x for x in w]))
    return rows


@pytest.mark.parametrize("coded", [False, True])
def test_sieve_of_many_words(spark, monkeypatch, coded):
    """Equal to brute force, and clusters are left out unseen; leaves in several parts; k beyond the table; a lone row."""
    from spindrift.operators import descent, trees

    monkeypatch.setattr(descent, "PART_ROWS", 10)
    rows = _prints_of(np.random.default_rng(5), 12, 480, 6)
    frame = spark.createDataFrame([*rows, (900, None)], "id bigint, words array<bigint>")
    tree = trees.build(frame, "id", "words", depth=6, least=10, distance=V.hamming_words)
    shelf = descent.shelves(tree, coded)
    queries = frame.where("id in (0, 7, 100, 333)").select(F.col("id").alias("query_id"), F.col("words").alias("q"))
    apart = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    at = dict(rows)
    for k in (5, 1000):
        found = descent.sieve(tree, queries, k, shelf)
        got = sorted((r["query_id"], r["rank"], r["d"], r["id"]) for r in found.hits.collect())
        assert got == [(q, i + 1, *x) for q in (0, 7, 100, 333) for i, x in enumerate(sorted((apart(w, at[q]), i) for i, w in rows)[:k])]
        stats = found.stats.collect()
        assert len(stats) == 4 and all(r["rows"] >= min(k, 480) for r in stats)
        if k == 5:
            nodes = tree.clusters.count()
            assert all(r["rows"] <= 160 and r["nodes"] < nodes and r["pruned"] > 0 for r in stats)
    near = descent.within(tree, queries, 9, shelf)
    assert sorted((r["query_id"], r["id"], r["d"]) for r in near.hits.collect()) == sorted((q, i, apart(w, at[q])) for q in (0, 7, 100, 333) for i, w in rows if apart(w, at[q]) <= 9)
    both = descent.within_cascade(tree, queries, 9, 4, 3, shelf)
    hits = both.hits.collect()
    assert all(r["d"] <= 4 and r["rank"] <= 3 for r in hits) and {r["band"] for r in hits} <= {"Foveal", "Near", "Good", "Weak"}
    for r in both.stats.collect():
        assert r["candidates"] == sum(apart(w, at[r["query_id"]]) <= 9 for _, w in rows) and r["survivors"] == sum(apart(w, at[r["query_id"]]) <= 4 for _, w in rows)


def test_trees_of_any_metric(spark):
    """A tree over arrays of numbers with the sum of absolute differences."""
    from spindrift.operators import descent, trees

    rnd = np.random.default_rng(6)
    x = np.round(rnd.normal(size=(5, 3))[rnd.integers(5, size=200)] * 50 + rnd.normal(size=(200, 3)))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    tree = trees.build(frame, "id", "v", depth=4, least=10, distance=V.l1)
    q = frame.where("id < 3").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = sorted((r["query_id"], r["rank"], r["d"], r["id"]) for r in descent.sieve(tree, q, 4).hits.collect())
    assert got == [(i, n + 1, *t) for i in range(3) for n, t in enumerate(sorted((float(abs(x[j] - x[i]).sum()), j) for j in range(200))[:4])]


def test_compositions_reach_the_fixpoint(spark):
    """Longer ways that are cheaper, planes that can't meet twice, and cycles."""
    from spindrift.operators import inference

    facts = [(1, 2, 1, 5), (2, 3, 2, 5), (3, 4, 4, 5), (1, 3, 3, 50), (2, 1, 2, 1), (1, 2, 1, 9), (1, 9, 2, 1), (9, 4, 5, 1)]
    found = {(r["a"], r["b"], r["mask"]): r["cost"] for r in inference.compose(spark.createDataFrame(facts, "a bigint, b bigint, mask int, cost bigint")).collect()}
    want = {}
    for a, b, m, c in facts:
        want[a, b, m] = min(c, want.get((a, b, m), c))
    while True:
        more = {}
        for (a, b, m), c in want.items():
            for (x, y, n), e in want.items():
                if b == x and not m & n and c + e < want.get((a, y, m | n), 10**9):
                    more[a, y, m | n] = min(c + e, more.get((a, y, m | n), 10**9))
        if not more:
            break
        want |= more
    assert found == want and found[1, 4, 7] == 2
    cheap = inference.compose(spark.createDataFrame(facts, "a bigint, b bigint, mask int, cost bigint"), limit=9)
    assert all(r["cost"] <= 9 or (r["a"], r["b"], r["mask"], r["cost"]) in facts for r in cheap.collect())


def test_asof_takes_the_last_mark(spark):
    from spindrift.operators import inference

    events = spark.createDataFrame([(1, "u", 5), (2, "u", 9), (3, "w", 1), (4, None, 3), (5, "u", 5)], "id bigint, who string, t bigint")
    marks = spark.createDataFrame([("u", 5, "a"), ("u", 7, "b"), ("w", 2, "c"), ("v", 0, "d")], "who string, t bigint, mark string")
    found = {r["id"]: r["mark"] for r in inference.asof(events, marks, ["who"], ["t"], ["mark"]).collect()}
    assert found == {1: "a", 5: "a", 2: "b", 3: None, 4: None}


def test_snapshots_with_gaps(spark):
    from spindrift.operators import snapshots

    s = lambda rows: spark.createDataFrame(rows, "k bigint, v array<double>")
    merged = snapshots.merged([s([(1, [0.0]), (2, [1.0])]), s([(2, [3.0])]), s([(1, [2.0]), (3, [1.0])])], ["k"], "v")
    found = {(r["k"], r["snapshot"]): (r["since"], r["d"], r["shifted"]) for r in snapshots.moved(merged, V.l1, 1.5).collect()}
    assert found == {(2, 1): (0, 2.0, True), (1, 2): (0, 2.0, True)}


def test_close_pairs_equal_all_pairs(spark):
    rnd = np.random.default_rng(11)
    rows = [(i, i % 2, int(rnd.integers(-(2**62), 2**62))) for i in range(20)]
    for i in range(20, 160):
        k, w = int(rnd.integers(0, 20)), None
        w = rows[k][2]
        for b in rnd.integers(0, 64, rnd.integers(0, 14)):
            w ^= 1 << int(b)
        rows.append((i, i % 2, w if w < 2**63 else w - 2**64))
    rows = [(i, g, (w + 2**63) % 2**64 - 2**63) for i, g, w in rows]
    frame = spark.createDataFrame(rows, "id bigint, g int, fp bigint")
    want = {(a, b) for a, g, x in rows for b, h, y in rows if a < b and g == h and bin((x ^ y) & (2**64 - 1)).count("1") <= 10}
    assert {tuple(r) for r in search.close_pairs(frame, ["g"], "id", "fp", 10).collect()} == want and len(want) > 100
    with pytest.raises(ValueError):
        search.close_pairs(frame, ["g"], "id", "fp", 12)


def test_pulses_are_placed_greedily(spark):
    from spindrift.operators import signals

    def plain(v, k):
        p = [0] * len(v)
        for _ in range(k if v else 0):
            at = max(range(len(v)), key=lambda d: (abs(abs(v[d]) - p[d]), abs(v[d]), -d))
            p[at] += 1
        return [n if x >= 0 else -n for n, x in zip(p, v)]

    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=5)]) for i in range(30)] + [(50, []), (51, [0.0, 0.0]), (52, [-1.0, 1.0, -1.0])]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    for k in (0, 1, 7):
        found = {r["id"]: r["p"] for r in frame.select("id", signals.pulses(F.col("v"), k).alias("p")).collect()}
        assert found == {i: plain(v, k) for i, v in rows}


def test_superposition_gives_its_parts_back(spark):
    from spindrift.functions import bits

    rnd = np.random.default_rng(9)
    rows = [(i, *([int(x) for x in rnd.integers(-(2**63), 2**63, 256)] for _ in range(3))) for i in range(5)]
    frame = spark.createDataFrame(rows, "id bigint, s array<bigint>, p array<bigint>, o array<bigint>").withColumn("b", bits.superpose(F.col("s"), F.col("p"), F.col("o"), 256, 5003))
    for i, c in enumerate("spo"):
        for r in frame.select((V.hamming_words(F.col(c), bits.recover(F.col("b"), i, 256, 5003)) / 16384).alias("x")).collect():
            assert abs(r["x"] - 0.25) < 0.02  # three random prints: each has three bits of four right
    same = frame.select(V.hamming_words(bits.superpose(F.col("s"), F.col("s"), F.col("s"), 256, 0), F.col("s")).alias("x"))
    assert {r["x"] for r in same.collect()} == {0}


def test_code_bounds_lose_nothing(spark):
    """Coarse codes of clustered vectors: exact answers; k beyond the table; a query set with a null."""
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(6, 13))[rnd.integers(6, size=300)] * 3 + rnd.normal(size=(300, 13)) * 0.3
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "vec_id bigint, v array<double>")
    books = search.train_codebooks(frame, "v", parts=3, k=5)
    for k in (4, 400):
        found = search.bounded_code_knn(frame, frame.where("vec_id in (0, 7, 900)"), "v", books, k, 6).collect()
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found)
        want = [(q, n + 1, i) for q in (0, 7) for n, (_, i) in enumerate(sorted((float(((x[i] - x[q]) ** 2).sum()), i) for i in range(300))[:k])]
        assert got == want
