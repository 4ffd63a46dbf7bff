"""Fill-in-middle transformation of texts over a rope.

A rope is a balanced binary tree over pieces of a text. Leaves and inner nodes cache how many code points and how many
units lie under them; a unit is a run of A-Z and a-z, or any other single character, and belongs to the leaf in which it
starts. Cutting at a unit's or a code point's rank goes down one path; joining makes one node. A text is cut at two ranks
of units, its parts are joined again around the sentinels, and the output is turned back by cutting at the sentinels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_and_ids

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a leaf.
LEAF = 2048


class Rope:
    """A leaf (``text``) or an inner node (``left``, ``right``)."""

    __slots__ = ("text", "starts", "left", "right", "chars", "units")

    def __init__(self, text: str | None, starts: ArrayLike | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.starts, self.left, self.right = text, starts, left, right
        #: ``starts`` has the places in a leaf at which units start.
        self.chars = len(text) if left is None else left.chars + right.chars
        self.units = len(starts) if left is None else left.units + right.units


_EMPTY = np.zeros(0, np.int64)


def unit_starts(text: str) -> ArrayLike:
    """The places at which units start."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code | 32) - 97) < 26
    inner = np.zeros(len(code), bool)
    inner[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inner)


def build(text: str, leaf: int = LEAF) -> Rope:
    """The rope of a text; an empty one is an empty leaf."""
    starts = unit_starts(text)
    edges = np.arange(0, max(len(text), 1), leaf)
    at = [*np.searchsorted(starts, edges), len(starts)]
    nodes = [Rope(text[e : e + leaf], starts[at[i] : at[i + 1]] - e) for i, e in enumerate(edges.tolist())]
    while len(nodes) > 1:
        paired = [join(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = paired + nodes[len(paired) * 2 :]
    return nodes[0]


def join(a: Rope, b: Rope) -> Rope:
    return b if not a.chars else a if not b.chars else Rope(None, None, a, b)


def _cut_leaf(leaf: Rope, at: int) -> tuple[Rope, Rope]:
    k = int(np.searchsorted(leaf.starts, at))
    return Rope(leaf.text[:at], leaf.starts[:k]), Rope(leaf.text[at:], leaf.starts[k:] - at)


def _cut(rope: Rope, rank: int, by_units: bool) -> tuple[Rope, Rope]:
    above = []
    while rope.left is not None:
        size = rope.left.units if by_units else rope.left.chars
        right = rank >= size
        above.append((rope, right))
        rank, rope = (rank - size, rope.right) if right else (rank, rope.left)
    if by_units:
        rank = int(rope.starts[rank]) if rank < len(rope.starts) else rope.chars
    low, high = _cut_leaf(rope, min(rank, rope.chars))
    for node, right in reversed(above):
        low, high = (join(node.left, low), high) if right else (low, join(high, node.right))
    return low, high


def cut_units(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The rope before the unit of a rank and from it on; a unit that goes on over leaves is never cut."""
    return (rope, Rope("", _EMPTY)) if rank >= rope.units else _cut(rope, rank, True)


def cut_chars(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    return _cut(rope, rank, False)


def pieces(rope: Rope) -> Iterator[str]:
    """The texts of the leaves in order; the stack holds one path."""
    stack = [rope]
    while stack:
        node = stack.pop()
        if node.left is None:
            yield node.text
        else:
            stack += [node.right, node.left]


def digest(rope: Rope) -> str:
    h = hashlib.sha256()
    for piece in pieces(rope):
        h.update(piece.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def _sentinel(text: str) -> Rope:
    return Rope(text, unit_starts(text))


def transform(rope: Rope, low: int, high: int, form: str) -> tuple[Rope, int, int]:
    """The output, and the code points of prefix and middle, which end after ``low`` and ``high`` units."""
    head, suffix = cut_units(rope, high)
    prefix, middle = cut_units(head, low)
    order = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    out = Rope("", _EMPTY)
    for part in order:
        out = join(out, _sentinel(part) if isinstance(part, str) else part)
    return out, prefix.chars, middle.chars


def find(rope: Rope, needle: str, after: int = 0) -> int:
    """The first place of ``needle`` from ``after`` on, also over leaves' borders."""
    tail, base = "", 0
    for piece in pieces(rope):
        end, window = base + len(piece), tail + piece
        if end > after:
            first = base - len(tail)
            at = window.find(needle, max(0, after - first))
            if at >= 0:
                return first + at
        tail = window[-(len(needle) - 1) :]
        base = end
    raise ValueError(f"{needle} is missing")


def restore(output: Rope, form: str) -> Rope:
    """The text, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    rest = cut_chars(output, len(PREFIX))[1]
    one, rest = cut_chars(rest, find(rest, first))
    rest = cut_chars(rest, len(first))[1]
    two, rest = cut_chars(rest, find(rest, second))
    middle = cut_chars(rest, len(second))[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return join(join(prefix, middle), suffix)


def draws(key: object, seed: int = 1) -> list[int]:
    """Four numbers below 2^32 that belong to a document: its id's digits (none for null) after the seed, hashed."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def form_of(text: str, h3: int, h4: int, percent: int = 90, spm_percent: int = 20) -> str:
    if not text or h3 % 100 >= percent or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    return "spm" if h4 % 100 < spm_percent else "psm"


def _rows(docs: DataFrame, schema: str, make) -> DataFrame:
    """``make(text, id)`` -> a row, for each document."""
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids, texts = texts_and_ids(batch)
            rows = [make(t, key) for key, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields])

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return frame.mapInArrow(run, schema)


def _parts(text: str, key: object, seed: int, percent: int, spm_percent: int, leaf: int):
    h1, h2, h3, h4 = draws(key, seed)
    rope, form = build(text, leaf), form_of(text, h3, h4, percent, spm_percent)
    if form == "plain":
        return rope, form, rope, None, None
    low, high = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    return rope, form, *transform(rope, low, high, form)


def fill_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, leaf: int = LEAF) -> DataFrame:
    """One row per document: doc_id, form (plain, psm, spm), text (the output), prefix_chars, middle_chars.

    ``percent`` of the documents are rearranged, ``spm_percent`` of these with the suffix first. Null and empty texts, and
    texts that hold a sentinel, stay as they are (null as the empty text). Rows that repeat a doc_id are cut by the same
    numbers, each in its own text; a null doc_id hashes as no digits. Very long texts are cut on one path of their tree;
    an empty table gives no rows; columns other than doc_id and text aren't read.
    """

    def make(text, key):
        _, form, out, prefix, middle = _parts(text, key, seed, percent, spm_percent, leaf)
        return key, form, "".join(pieces(out)), prefix, middle

    return _rows(docs, "doc_id bigint, form string, text string, prefix_chars bigint, middle_chars bigint", make)


def restored(outputs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """doc_id, text: the documents that ``fill_middle`` was given, from its columns form and text alone."""
    frame = outputs.select(F.struct("doc_id", "form").alias("_key"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            keys, texts = texts_and_ids(batch)
            found = ["".join(pieces(restore(build(t, leaf), k["form"]))) for k, t in zip(keys, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([k["doc_id"] for k in keys], pa.int64()), pa.array(found, pa.string())], ["doc_id", "text"])

    return frame.mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, and the digests of the output and of the
    text that is restored from the output's characters. Odd rows as in :func:`fill_middle`."""

    def make(text, key):
        rope, form, out, prefix, middle = _parts(text, key, seed, 90, 20, LEAF)
        again = out if form == "plain" else restore(build("".join(pieces(out))), form)
        return key, rope.units, form, prefix, middle, digest(out), digest(again)

    return _rows(docs, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", make)
