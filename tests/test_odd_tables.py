"""Queries against their SQL on small tables with what the smallest ones lack: ties, nulls, numbers next to a whole one."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spindrift.plans import catalog


def embeddings(folder, vectors, ids=None, labels=None):
    ids = list(range(len(vectors))) if ids is None else ids
    labels = [i % 10 for i in ids] if labels is None else labels
    frame = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(frame, folder / "embeddings.parquet")


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def both(spark, folder, name):
    """The query's rows and its SQL's, sorted."""
    frame = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    answer = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in answer.fetchall())
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect()), want


def vectors(n, seed=3):
    return np.random.default_rng(seed).normal(0, 0.125, (n, 64)).astype(np.float32)


def test_codes_next_to_whole_numbers(spark, tmp_path):
    """Thousandths: as floats their thousandfold is whole, as doubles it's just below."""
    v = (np.arange(640).reshape(10, 64) % 500 / 1000).astype(np.float32)
    embeddings(tmp_path, v.tolist())
    got, want = both(spark, tmp_path, "pack_round_trip")
    assert got == want


def test_ranks_of_equal_elements(spark, tmp_path):
    """Equal elements of a lane are one row each; nulls come last."""
    v = [[float(x) for x in r] for r in vectors(4)]
    v[0][20] = v[0][3] = v[0][50]
    v[1] = [0.5] * 64
    v[2][7] = v[2][9] = None
    v[3] = [0.25, -1.0, 0.25]
    embeddings(tmp_path, v)
    got, want = both(spark, tmp_path, "partition_sort")
    assert got == want


def test_cosines_of_primes_without_a_shuffle_of_pairs(spark, monkeypatch):
    from spindrift.operators import words

    rows = [(i, p, (7 * i + 3 * j) % 5 + 1) for i in range(40) for j, p in enumerate("abc") if (i + j) % 4]
    w = spark.createDataFrame(rows, "doc_id bigint, prime string, weight bigint")
    found = words.similarity(w, w.where("doc_id % 10 = 1"), "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(words, "COLUMNS", 2)
    by_prime = words.similarity(w, w.where("doc_id % 10 = 1"), "doc_id")
    key = lambda r: (r["query"], r["doc_id"])
    a, b = ({key(r): r["similarity"] for r in f.collect()} for f in (found, by_prime))
    assert a == pytest.approx(b) and len(a) > 100


def test_small_pieces_share_blocks(spark, tmp_path):
    """Every other row of a tensor: as many pieces as rows, but tasks by the block."""
    from spindrift.sources import codes

    rows = [(t, "norm", 64, i, [i % 100] * 17) for t in ("a", "b#3") for i in range(0, 400, 2)] + [("c", "skip", 8, i, [i] * 17) for i in range(130)]
    folder = f"file://{tmp_path}/c"
    codes.write_codes(spark.createDataFrame(rows, codes.SCHEMAS["container"]), folder, tasks=2)
    back = codes.read_codes(spark, folder, block=50)
    assert back.rdd.getNumPartitions() <= 530 / 50 + 2
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_entries_nearest_to_what_is_inferred(spark, tmp_path):
    """Equal prints and several blocks; no pair of a query and an entry reaches an aggregate."""
    v = vectors(350)
    v[200:260] = v[100:160]
    embeddings(tmp_path, v.tolist())
    got, want = both(spark, tmp_path, "inferred_slots")
    assert got == want and len(got) == 12
    plan = catalog.QUERIES["inferred_slots"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Words with their top bit set, blocks of a few rows, ties by id, rows that can't be compared."""
    from spindrift.operators import blockwise

    monkeypatch.setattr(blockwise, "BASE_ROWS", 7)
    monkeypatch.setattr(blockwise, "QUERY_ROWS", 2)
    rnd = np.random.default_rng(5)
    x = rnd.integers(-(2**63), 2**63 - 1, (50, 3))
    x[30:] = x[:20]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(90, None), (91, [1, None, 2]), (92, [1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, w array<bigint>")
    found = blockwise.nearest_prints(frame, frame.where("vec_id % 9 = 0").selectExpr("vec_id as query_id", "w as q"), "vec_id", "w", 4)
    best = {}
    for r in found.collect():
        best.setdefault(r["query_id"], []).append((r["cost"], r["vec_id"]))
    d = lambda a, b: sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(a, b))
    assert {q: sorted(f)[:4] for q, f in best.items()} == {q: sorted((d(x[q], y), i) for i, y in enumerate(x))[:4] for q in range(0, 50, 9)}


def test_rank_correlation_of_counted_pairs(spark):
    """Counts of pairs and their rank correlation as brute force has them; pairs of a row with itself don't count."""
    from spindrift.operators import blockwise, numerics

    rnd = np.random.default_rng(6)
    x = rnd.integers(-(2**63), 2**63 - 1, (40, 4))
    x[5] = x[9]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, w array<bigint>")
    cells = blockwise.counted_pairs(frame, frame.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "w as q"), "vec_id", "w", 1)
    bits = lambda a, b: sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(a, b))
    pairs = [(bits(x[q][:1], x[i][:1]), bits(x[q][1:], x[i][1:])) for q in range(0, 40, 5) for i in range(40) if i != q]
    assert sorted((r["a"], r["b"]) for r in cells.collect() for _ in range(r["n"])) == sorted(pairs)
    a, b = ([sum(w < v for w in c) + (c.count(v) + 1) / 2 for v in c] for c in map(list, zip(*pairs)))
    assert numerics.spearman_of_counts(cells, "a", "b").first()["rho"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_cosines_of_equal_and_empty_directions(spark, tmp_path):
    """Copies tie by id wherever their block ends; no cosine is summed pair by pair in the plan."""
    v = vectors(450)
    v[300:400] = v[:100]
    embeddings(tmp_path, v.tolist())
    got, want = both(spark, tmp_path, "cosine_knn_join")
    assert got == want and len(got) == 25
    assert "MapInArrow" in catalog.QUERIES["cosine_knn_join"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_work_of_bytes_block_by_block(spark, tmp_path, monkeypatch):
    from spindrift.operators import blockwise

    v = vectors(330) * 0.8
    v[7] = 3.0
    v[8] = -3.0
    v[100] = 3.0
    embeddings(tmp_path, v.tolist())
    got, want = both(spark, tmp_path, "byte_work_search")
    assert got == want and len(got) > 10
    rnd = np.random.default_rng(7)
    x = rnd.integers(0, 256, (30, 1030))  # more than a lane of 16 bits holds, and no multiple of eight
    x[0], x[1] = 0, 255
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, c array<int>")
    found = blockwise.within_work(frame, frame.where("vec_id < 4").selectExpr("vec_id as query_id", "c as q"), "vec_id", "c", 300_000)
    assert {(r["query_id"], r["vec_id"]): r["d"] for r in found.collect()} == {(q, i): int(np.abs(x[i] - x[q]).sum()) for q in range(4) for i in range(30)}


def test_nearest_by_codes_without_a_join_of_pairs(spark):
    """Copies tie by id; survivors of the bounds aren't joined with their vectors again."""
    from spindrift.operators import search

    x = vectors(120).astype(float)
    x[60:] = x[:60]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, v array<double>")
    books = search.train_codebooks(frame, "v", k=16)
    found = search.bounded_code_knn(frame, frame.where("vec_id % 40 = 0"), "v", books, 6, 10)
    want = [(q, n + 1, i) for q in (0, 40, 80) for n, (_, i) in enumerate(sorted((float(((x[i] - x[q]) ** 2).sum()), i) for i in range(120))[:6])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
