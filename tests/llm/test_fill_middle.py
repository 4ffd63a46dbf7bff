"""The fill-in-middle transformation against plain Python, and its rope on random cuts."""

import hashlib
import random
import re

import pytest
from spindrift.llm import fill_middle as fm

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def expected(key, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    x, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (key, len(u), "plain", None, None, text)
    if h4 % 100 < 20:
        return (key, len(u), "spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}")
    return (key, len(u), "psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(frame, rows):
    order = lambda r: tuple((x is not None, x) for x in r)
    found = sorted((tuple(r) for r in fm.digests(frame).collect()), key=order)
    want = sorted(((*e[:5], sha(e[5]), sha(t or "")) for (k, t), e in ((r, expected(*r)) for r in rows)), key=order)
    assert found == want
    out = fm.fill_middle(frame, leaf=7)
    assert sorted((tuple(r) for r in out.select("doc_id", "form", "prefix_chars", "middle_chars", "text").collect()), key=order) == sorted(((e[0], *e[2:]) for e in (expected(*r) for r in rows)), key=order)
    assert sorted((tuple(r) for r in fm.restored(out, leaf=5).collect()), key=order) == sorted(((k, t or "") for k, t in rows), key=order)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_equals_plain_python(request, which):
    check(request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which]))


def test_odd_rows(spark):
    rows = [(None, "no id"), (None, None), (1, "twice"), (1, "twice"), (1, "other text of one id"), (-3, "x<P>y"), (4, "<M>"), (5, "<S"), (6, "a<"), (7, "<<P <S <M >"), (8, "é" * 50 + "abc"), (9, "a" * 9000), (10, "\n\t \r"), (11, "\U0001f600x\U0001f600")]
    rows += [(100 + i, "<P <S <M <" * 3) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows)
    assert fm.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_very_long_text(spark):
    rows = [(2, "word, " * 300_000), (3, "w" * 1_500_000), (4, ";" * 1_000_000)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_cuts_of_ropes():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice("ab ,é<") for _ in range(rnd.randrange(60)))
        rope, units = fm.build(text, rnd.choice([1, 2, 5, 100])), UNIT.findall(text)
        assert (rope.units, rope.chars) == (len(units), len(text))
        k = rnd.randrange(len(units) + 2)
        low, high = fm.cut_units(rope, k)
        assert ("".join(fm.pieces(low)), "".join(fm.pieces(high))) == ("".join(units[:k]), "".join(units[k:])) and low.units + high.units == len(units)
        c = rnd.randrange(len(text) + 1)
        low, high = fm.cut_chars(rope, c)
        assert ("".join(fm.pieces(low)), "".join(fm.pieces(high))) == (text[:c], text[c:])
        needle = rnd.choice(["ab", "a ", ",,a", "<"])
        after = rnd.randrange(len(text) + 1)
        if needle in text[after:]:
            assert fm.find(rope, needle, after) == text.find(needle, after)


def test_depth_is_logarithmic():
    rope, depth, level = fm.build("x " * 500_000, 64), 0, None
    level = [rope]
    while level:
        level, depth = [c for n in level if n.left is not None for c in (n.left, n.right)], depth + 1
    assert depth <= 16
