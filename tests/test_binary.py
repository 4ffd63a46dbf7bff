"""Tagged trees and block matrices against plain Python."""

import struct

import numpy as np
from pyspark.sql import functions as F
from spindrift.operators import blocks, tagged


def _tree():
    name = lambda tag, n: bytes([tag]) + struct.pack(">H", len(n.encode())) + n.encode()
    inner = name(9, "list") + bytes([10]) + struct.pack(">i", 2) + (name(1, "b") + b"\x07\x00") + (name(8, "s") + struct.pack(">H", 3) + b"\x08\x00\x01" + b"\x00")
    arrays = name(7, "raw") + struct.pack(">i", 4) + b"abcd" + name(11, "ints") + struct.pack(">i", 1) + b"\0\0\0\1" + name(9, "empty") + b"\0" + struct.pack(">i", 0)
    return name(10, "root") + inner + arrays + name(6, "é") + struct.pack(">d", 1.5) + b"\0"


def test_walk_with_a_stack():
    raw = _tree()
    found = list(tagged.walk(raw))
    assert [(p, t, d) for p, t, _, d in found] == [("root", 10, 0), ("root/list", 9, 1), ("root/list[]", 10, 2), ("root/list[]/b", 1, 3), ("root/list[]", 10, 2), ("root/list[]/s", 8, 3), ("root/raw", 7, 1), ("root/ints", 11, 1), ("root/empty", 9, 1), ("root/é", 6, 1)]
    assert all(raw[at : at + 1] is not None for _, _, at, _ in found) and struct.unpack_from(">d", raw, found[-1][2])[0] == 1.5
    for n in range(len(raw)):  # cut short anywhere: a start of the same tags
        assert list(tagged.walk(raw[:n])) == found[: len(list(tagged.walk(raw[:n])))]
    assert list(tagged.walk(b"")) == [] and list(tagged.walk(b"\xff\x00")) == []


def test_scan_of_bytes_and_of_files_in_blocks(spark, tmp_path):
    raw = _tree() + b"pad" + tagged.pattern(1, "b") + tagged.pattern(8, "s") * 2
    schema = [(8, "s"), (1, "b"), (3, "none")]
    want = sorted((i, at, at + len(tagged.pattern(*s))) for i, s in enumerate(schema) for at in range(len(raw)) if raw.startswith(tagged.pattern(*s), at))
    frame = spark.createDataFrame([("x", bytearray(raw)), ("y", bytearray()), ("z", None)], "k string, data binary")
    assert sorted(tuple(r)[1:] for r in tagged.scan(frame, "k", "data", schema).collect()) == want and len(want) == 5
    (tmp_path / "one").write_bytes(raw)
    (tmp_path / "none").write_bytes(b"")
    for block in (1, 5, 4096):
        found = tagged.scan_files(spark, f"file://{tmp_path}", schema, block).collect()
        assert sorted((r["entry"], r["tag_offset"], r["payload_offset"]) for r in found) == want
    assert [r["path"] for r in tagged.tags(frame, "k", "data").orderBy("payload_offset").limit(2).collect()] == ["root", "root/list"]


def test_tiles_times_vectors(spark):
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 2**64, (6, 64), dtype=np.uint64) & rnd.integers(0, 2**64, (6, 64), dtype=np.uint64)
    words[3] = 0
    weights = rnd.integers(-3, 4, (64, 64)).astype(float)
    x = rnd.integers(-9, 10, (3, 256)).astype(float)
    dense = lambda m, w=None: np.kron(np.array([[(int(m[r]) >> c) & 1 for c in range(64)] for r in range(64)]) * (1 if w is None else w), np.eye(4))
    tiles = [(i // 3, i % 3, [int(v) for v in words[i].view(np.int64)]) for i in range(6)]
    frame = spark.createDataFrame(tiles, "bi bigint, bj bigint, masks array<bigint>")
    vector = spark.createDataFrame([(j, [float(v) for v in x[j]]) for j in range(3)], "bj bigint, x array<double>")
    got = {r["bi"]: r["y"] for r in blocks.product(frame, vector).collect()}
    for bi in (0, 1):
        assert np.allclose(got[bi], sum(dense(words[3 * bi + j]) @ x[j] for j in range(3)))
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    one = frame.where("bi = 0 and bj = 1").join(vector, "bj").select(blocks.tile_product(F.col("masks"), F.col("x"), w).alias("y")).first()["y"]
    assert np.allclose(one, dense(words[1], weights) @ x[1])
    q = int(words[0][5].view(np.int64))
    a = frame.where("bi = 0 and bj = 0").select(blocks.attend(F.col("masks"), F.lit(q), 12).alias("a"), blocks.active(F.col("masks"), F.lit(21)).alias("cols")).first()
    scores = [bin(int(v) & int(words[0][5])).count("1") for v in words[0]]
    assert (a["a"]["best"], a["a"]["distance"]) == (scores.index(max(scores)), 64 - max(scores))
    assert a["a"]["fires"] & (2**64 - 1) == sum(1 << i for i, v in enumerate(scores) if v >= 12)
    assert a["cols"] == [4 * c + k for c in range(64) if (int(words[0][5]) >> c) & 1 for k in range(4)]


def test_sections_synapses_and_levels(spark):
    from spindrift.operators import nets
    from spindrift.operators.search import Mask

    states = spark.createDataFrame([(0, 0, 1), (0, 63, 1), (0, 64, 3), (0, 65, 1), (1, 200, 2), (1, 5, None)], "s int, at bigint, state bigint")
    found = {(r["s"], r["word"]): (r["bits"] & (2**64 - 1), r["n"]) for r in nets.section_bitmaps(states, ["s"], "at", "state", Mask(require=1, forbid=2)).collect()}
    assert found == {(0, 0): (1 | 1 << 63, 2), (0, 1): (2, 1), (1, 3): (0, 0), (1, 0): (0, 0)}
    rows = [(0, 10, 9), (5, 10, 9), (6, 10, 9), (-6, 10, 9), (11, 10, 7), (11, 10, 8), (-128, 127, 8), (10, 10, 9)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, efficacy int, theta int, maturity int")
    got = [r["x"] for r in frame.orderBy("i").select(nets.synapse_state(F.col("efficacy"), F.col("theta"), F.col("maturity")).alias("x")).collect()]
    assert got == ["Silent", "Silent", "WeakPos", "WeakNeg", "WeakPos", "StrongPos", "StrongNeg", "WeakPos"]
    levels = nets.level_fractions(spark.createDataFrame([("none", 1), ("SP", 2), ("SPO", 1)], "class string, n bigint"))
    assert {r["level"]: r["share"] for r in levels.collect()} == {"noise": 0.25, "free": 0.0, "pair": 0.5, "core": 0.25}
    none = nets.level_fractions(spark.createDataFrame([], "class string, n bigint"))
    assert {r["share"] for r in none.collect()} == {0.0} and none.count() == 4


def test_layered_searches_lose_nothing(spark):
    from spindrift.operators import nets, search

    rnd = np.random.default_rng(6)
    rows = [(i, [int(x) for x in rnd.integers(0, 256, 40)]) for i in range(60)] + [(60, [0] * 40), (61, [255] * 40)]
    frame = spark.createDataFrame(rows, "id bigint, c array<int>")
    q = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("c").alias("q"))
    at = dict(rows)
    gap = lambda a, b: sum(abs(x - y) for x, y in zip(a, b))
    found = {(r["query_id"], r["id"]): r["d"] for r in nets.work_search(search.pair_with(frame, q), "c", "q", 3400).collect()}
    assert found == {(i, j): gap(at[i], at[j]) for i in (0, 20, 40, 60) for j in at if gap(at[i], at[j]) <= 3400} and len(found) > 20
