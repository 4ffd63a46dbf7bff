"""MinHash near-duplicates against brute force on full sets."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.llm import signature_join as sj
from spindrift.llm.jaccard_join import shingle_set


def expected(rows):
    sets = [brute.shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    component, least = brute.components(range(len(rows)), linked), {}
    for i, c in component.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted(((k, len(sets[i]), least.get(component[i], k), k == least.get(component[i], k)) for i, (k, _) in enumerate(rows)), key=repr)


def found(frame):
    out = sj.near_duplicates(frame)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_equals_brute_force(request, which):
    assert found(request.getfixturevalue(which)) == expected(request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which]))


def edits(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**9)}"
    return words


@pytest.mark.parametrize("long", [3, 256])
def test_groups_around_the_threshold(spark, monkeypatch, long):
    """Chains of edits, a template that many texts share to 0.7, copies, and pairs on both sides of 0.85."""
    monkeypatch.setattr(sj, "LONG", long)
    rnd, rows = random.Random(2), []
    for g in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([8, 60, 200]))]
        for _ in range(12):
            rows.append(" ".join(words))
            words = edits(words, rnd, rnd.choice([0, 1, 2, 3]))
    template = [f"t{i}" for i in range(100)]
    rows += [" ".join(template + [f"u{rnd.randrange(10**9)}" for _ in range(20)]) for _ in range(60)]
    rows += [" ".join(template + [f"v{i}" for i in range(20 + j % 3)]) for j in range(20)]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    want = expected(rows)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == want
    assert 30 < len({r[2] for r in want}) < len(rows) - 60


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, text + " x"), (5, text), (5, text + " y"), (5, "other words of the same id"), (None, "alone and without an id here"), (None, None), (7, ""), (8, " \n"), (9, "a b"), (10, "A b"), (11, "b a"), (12, text.upper())]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == expected(rows)
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []
    long = " ".join(f"w{i % 70_001}" for i in range(200_000))
    assert found(spark.createDataFrame([(1, long), (2, long + " more"), (3, long[: len(long) // 2])], "doc_id bigint, text string")) == expected([(1, long), (2, long + " more"), (3, long[: len(long) // 2])])
    with pytest.raises(ValueError):
        sj.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 80)


def test_signatures_agree_as_often_as_sets_are_alike():
    """The mean and the spread of collisions are those of independent draws."""
    rnd, n = np.random.default_rng(4), []
    for _ in range(400):
        all_ = rnd.integers(0, 2**63, 230, dtype=np.uint64)
        a, b = np.unique(all_[:215]), np.unique(all_[15:])
        n.append(int((sj.signature(a) == sj.signature(b)).sum()))
    s = 200 / 230
    assert abs(np.mean(n) - 64 * s) < 4 * (64 * s * (1 - s) / 400) ** 0.5 and 0.8 < np.std(n) / (64 * s * (1 - s)) ** 0.5 < 1.2
    assert (sj.signature(np.arange(10_000, dtype=np.uint64)) == sj.signature(np.arange(10_000, dtype=np.uint64)[::-1])).all()


def test_collisions_and_lists(spark):
    texts = [" ".join(f"w{i}" for i in range(a, a + 60)) for a in (0, 1, 3, 9, 30, 500)]
    sets = sj.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).withColumnRenamed("doc_id", "node")
    sig = {i: sj.signature(shingle_set(t)) for i, t in enumerate(texts)}
    pairs = sets.select(F.col("node").alias("a"), F.col("sig").alias("x")).crossJoin(sets.select(F.col("node").alias("b"), F.col("sig").alias("y")))
    got = {(r["a"], r["b"]): r["c"] for r in pairs.select("a", "b", sj.collisions("x", "y").alias("c")).collect()}
    assert got == {(i, j): int((sig[i] == sig[j]).sum()) for i in sig for j in sig}
    by_list = {}
    for r in sj.lists(sets).collect():
        by_list.setdefault(r["s"], set()).add(r["node"])
    for (i, j), c in got.items():
        assert i == j or c < sj.MATCHES or any({i, j} <= m for m in by_list.values())


def test_components_carry_few_links(spark, monkeypatch):
    """Many links to the same few nodes are gone after a round or two; all rounds together see few more than there are."""
    from spindrift.llm import graph

    carried, write = [], graph.stored

    def counted(frame, name):
        out = write(frame, name)
        if name == "links":
            carried.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    rnd = random.Random(5)
    links = [(100 + i, rnd.randrange(12)) for i in range(1000) for _ in range(9)] + [(2000 + i, 2001 + i) for i in range(50)]
    links += [(5000 + rnd.randrange(400), 5000 + rnd.randrange(400)) for _ in range(300)] + [(7000, 7000)]
    rnd.shuffle(links)
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute.components(sorted(nodes), [(a, b) for a, b in links if a != b])
    assert sum(carried) < 1.5 * carried[0]


def test_loose_group_makes_few_links(spark, monkeypatch):
    """Of 495 texts each is linked to some thirty others, few by a pivot: most links are left out, the components are whole."""
    import itertools

    measured, measure = [], sj.similarities

    def counted(pairs, docs):
        measured.append(pairs.count())
        return measure(pairs, docs)

    monkeypatch.setattr(sj, "similarities", counted)
    base, rows = [f"w{i}" for i in range(200)], []
    for edited in itertools.combinations(range(12), 4):  # linked if they share three
        words = list(base)
        for i in edited:
            words[10 + 15 * i] = f"e{i}"
        rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, " ".join([*base[:100], *(f"x{i}-{j}" for j in range(12))])) for i in range(20)]
    want = expected(rows)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == want
    links = 495 * 32 // 2
    assert len({r[2] for r in want}) == 21 and sum(measured[1:]) < links / 2


def test_texts_that_no_pair_asks_for_stay(spark, monkeypatch):
    """Of 600 texts 20 are in pairs: few of the others are handed to the joins that shuffle texts."""
    handed, measure = [], sj.similarities

    def counted(pairs, docs):
        handed.append(docs.count())
        return measure(pairs, docs)

    monkeypatch.setattr(sj, "similarities", counted)
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40))) for i in range(590)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(10)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == expected(rows)
    assert handed and max(handed) < 300


@pytest.mark.parametrize("most", [2**25, 64])
def test_asked_texts_are_all_there(spark, monkeypatch, most):
    monkeypatch.setattr(sj, "MOST_BITS", most)
    rows = [(None if i % 50 == 0 else i // 2, None if i % 70 == 0 else f"text {i}") for i in range(800)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id bigint, text string").withColumn("r1", F.lit("clash"))
    keyed = sj._texts(docs).select("doc_id", "text", "r1")
    every = [(r["r1"], (r["doc_id"], r["text"])) for r in keyed.collect()]
    asked = dict(every[:200])
    got = sj.asked_texts(docs, spark.createDataFrame([(r,) for r in asked], "r1 bigint"))
    assert got.columns == ["doc_id", "text"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(repr(x) for r, x in every if r in asked) == sorted(repr(x) for x in rows if x in asked.values())
    assert len(rows) < 400 or most == 64
    assert sj.asked_texts(docs, spark.createDataFrame([], "r1 bigint")).isEmpty()
