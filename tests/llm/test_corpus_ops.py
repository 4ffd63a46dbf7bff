"""Operators over the whole corpus against plain Python."""

import random

import brute
import pytest
from spindrift.llm import jaccard_join, line_dedup, repeats
from spindrift.llm.run_length import RunLengthIndex


def _family_rows():
    """Families around the threshold, chains, copies, short and empty texts, and a line that all share."""
    rnd = random.Random(5)
    rows, common = [], " ".join(f"c{i}" for i in range(14))
    for family in range(6):
        base = [f"f{family}w{rnd.randrange(400)}" for _ in range(60 + 40 * family)]
        for member in range(12):
            text = list(base)
            for _ in range(rnd.randrange(0, 7)):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
            if member % 4 == 3:
                text = text[: int(len(text) * rnd.uniform(0.75, 1))]
            rows.append(" ".join(text) + ("\n" + common if member % 2 else ""))
    rows += [common, common.upper(), common + " tail", "a b", "A  b", "", None, " ", "a b c d e", "solo"]
    rows += [" ".join(f"u{rnd.randrange(50)}" for _ in range(12)) + " " + common for _ in range(60)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_join_families(spark):
    rows = _family_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert found == brute.jaccard_components(rows)


def test_jaccard_join_splits_cells(spark, monkeypatch):
    """Small cells, so that windows are split around pivots again and again: no link is lost."""
    monkeypatch.setattr(jaccard_join, "CELL_MEMBERS", 6)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 3)
    monkeypatch.setattr(jaccard_join, "CELL_PIVOTS", 3)
    rnd = random.Random(7)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(70):  # half the text is common to all, so that regions hold unlike sets
        text = shared + [f"g{i // 3}x{j}" for j in range(30)]
        for _ in range(i % 3 * 2):
            text[rnd.randrange(len(text))] = f"y{rnd.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert found == brute.jaccard_components(rows)


def test_first_of_each_keeps_what_shares_a_doc_id(spark):
    a, b, c = ("one two three four five six seven", "other words stand in this text here", "same same but quite different words now")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, None), (8, None), (9, ""), (None, "a null id with words of its own"), (None, a)]
    frame = spark.createDataFrame([(k, t, "en", i) for i, (k, t) in enumerate(rows)], "doc_id bigint, text string, lang string, r1 int")
    out = jaccard_join.first_of_each(frame)
    assert out.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "a null id with words of its own"), (3, a), (5, b), (7, c), (8, ""), (9, "")]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_jaccard_join(request, which):
    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert found == brute.jaccard_components(rows)
    assert jaccard_join.near_duplicates(frame.where("doc_id < 0")).count() == 0


def test_run_length_index():
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"abcd") for _ in range(300))
    strings = [base[i : i + rnd.randrange(20, 90)] for i in (0, 10, 10, 55, 120, 121, 200)] + [b"", b"zzzzzzzzzzzzzzzzzzzzzz", bytes(rnd.choice(b"abcd") for _ in range(80))]
    index = RunLengthIndex(strings)
    for length in (1, 5, 12, 30):
        found, flat = index.repeated(length), [(s, i) for s, x in enumerate(strings) for i in range(len(x) - length + 1)]
        seen = {}
        for s, i in flat:
            seen.setdefault(strings[s][i : i + length], []).append((s, i))
        for s, i in flat:
            assert found[index.starts[s] + i] == (len(seen[strings[s][i : i + length]]) > 1), (length, s, i)


def _repeat_rows():
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh éü") for _ in range(n))
    passage, long_ = word(230), word(900)
    rows = [word(400) + passage + word(300), word(50) + passage, passage[:199] + word(100), passage[10:], "x" * 450, "x" * 199, word(150), None, ""]
    for _ in range(8):
        text = list(long_)
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(len(text))] = "#"
        rows.append("".join(text))
    rows += [long_ + long_, passage[:200], "é" * 99 + "ab", "é" * 99 + "ab", word(700) + "\n" + word(10)]
    rows += [rows[0], "ab" * 300]
    return list(enumerate(rows))


@pytest.mark.parametrize("counted", [False, True])
def test_repeats_planted(spark, monkeypatch, counted):
    if counted:
        monkeypatch.setattr(repeats, "INDEX_ENTRIES", 1)
    rows = _repeat_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(frame).collect()}
    assert found == brute.repeats(rows)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_repeats(request, which):
    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(frame).collect()}
    assert found == brute.repeats(rows)
    assert repeats.remove_repeats(frame.where("doc_id < 0")).count() == 0


def test_edit_distance_bound():
    rnd = random.Random(4)
    for _ in range(4000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 14)))
        b = list(a)
        for _ in range(rnd.randrange(0, 5)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b", "c"])
        b = "".join(b)
        for k in (1, 2, 3):
            assert line_dedup.within(a, b, k) == (brute.edit_distance(a, b) <= k), (a, b, k)


def test_near_lines_share_a_key():
    rnd = random.Random(6)
    for _ in range(1500):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(24, 40)))
        b = list(a)
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
        b = "".join(b)
        if brute.edit_distance(a, b) <= 2:
            low, high = sorted((a, b), key=len)
            own = {k for k, mine in line_dedup.signatures(low, 2) if mine}
            assert own & {k for k, _ in line_dedup.signatures(high, 2)}, (a, b)


def _deduped(rows, tau=2, min_chars=24):
    lines = [(k, i, x) for k, t in rows for i, x in enumerate((t or "").split("\n")) if brute.WS.search(x)]
    texts = sorted({x for _, _, x in lines})
    long = [i for i, x in enumerate(texts) if len(x) >= min_chars]
    linked = [(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if abs(len(texts[a]) - len(texts[b])) <= tau and line_dedup.within(texts[a], texts[b], tau)]
    classes, number = brute.components(range(len(texts)), linked), {x: i for i, x in enumerate(texts)}
    first, gone = {}, {k: set() for k, _ in rows}
    for k, i, x in sorted(lines):
        if first.setdefault(classes[number[x]], (k, i)) != (k, i):
            gone[k].add(i)
    return {k: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]), len(gone[k])) for k, t in rows}


def test_line_dedup_planted(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdef ") for _ in range(n)) for n in (23, 24, 30, 60, 200)]
    pool = [b for b in base]
    for b in base * 12:
        x = list(b)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(x))
            x[at : at + rnd.randrange(2)] = rnd.choice(["", "z", "yy"])
        pool.append("".join(x))
    rows = [(i, "\n".join(rnd.choice([*pool, "", " ", "short"]) for _ in range(rnd.randrange(1, 7)))) for i in range(60)] + [(98, None), (99, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.without_repeats(frame).select("source_row.*", "n_removed").collect()}
    assert found == _deduped(rows)


def test_line_dedup_passes_columns_of_any_name(spark):
    names = ["_uid", "_lines", "_removed", "_of", "_gone", "u1", "u2", "r1", "r2", "source_row", "n_lines", "removed", "h"]
    rows = [(1, "a b\na b\n\nc"), (2, "c\na b"), (None, "d\nd"), (2, "c\na b"), (3, "\n".join(f"line {i}" for i in range(40_000)) * 2)]
    frame = spark.createDataFrame([(k, t, *[i] * len(names)) for i, (k, t) in enumerate(rows)], ", ".join(["doc_id bigint", "text string", *(f"{n} int" for n in names)]))
    out = line_dedup.without_repeats(frame).select("source_row.*").collect()
    found = {r["_uid"]: r["text"] for r in out}
    assert out[0].__fields__ == frame.columns and all(r[n] == r["_uid"] for r in out for n in names)
    assert found[0] == "a b\n\nc" and found[2] == "d" and found[3] == found[1] == ""
    assert found[4].split("\n")[:2] == ["line 0", "line 1"] and found[4].count("\n") == 40_000


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_line_dedup(request, which):
    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.without_repeats(frame).select("source_row.*", "n_removed").collect()}
    assert found == _deduped(rows)
    assert line_dedup.without_repeats(frame.where("doc_id < 0")).count() == 0


def test_shingle_sets_of_a_batch(monkeypatch, rows):
    """A batch's sets are those of its texts; of its words each distinct one is hashed once."""
    import pyarrow as pa

    texts = ["", " ", " a", "A ", "a\x0bb\x1cc d\x85 e f", "A B c d", "\ta b c d e\n", "É é À", "\0 a\0b c", *(t or "" for _, t in rows)]
    for skip in range(9):
        found = jaccard_join.shingle_sets(pa.array(texts[:12] + texts).slice(skip))
        assert [s.tolist() for s in found] == [jaccard_join.shingle_set(t).tolist() for t in (texts[:12] + texts)[skip:]]
    assert jaccard_join.shingle_sets(pa.array([], pa.string())) == []
    hashed, digest = [], jaccard_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard_join.xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or digest(w))
    jaccard_join.shingle_sets(pa.array(["one two One three", " two\none "]))
    assert sorted(hashed) in ([b"", b"one", b"three", b"two"], [b"one", b"three", b"two"])


def test_line_keys_share_a_layout():
    """Lines of one length have their substrings laid out once; the keys are those of each substring alone."""
    line_dedup.layout.cache_clear()
    lines = ["the quick brown fox jumps over it", "the quick brown fox jumps over us", "Ünï quick brown fox jumps over it", "\udc80he quick brown fox jumps over it"[:33]]
    for line in lines:
        pairs = line_dedup.signatures(line, 2)
        assert [k for k, _ in pairs] == line_dedup.keys(line, 2).tolist() and sum(own for _, own in pairs) == 3
        places = {(line[p:q].encode("utf-8", "surrogatepass"), seed) for p, q, seed in line_dedup.layout(len(line), 2)[0]}
        wanted = {line_dedup.xxhash.xxh3_64_intdigest(piece, seed) for piece, seed in places}
        assert {k % 2**64 for k, _ in pairs} == wanted
    assert line_dedup.layout.cache_info().misses == 1
