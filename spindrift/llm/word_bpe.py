"""Ids of whole texts for a lower-casing BPE tokenizer with word ends, computed for a batch of texts at a time.

The batch becomes one array of code points. Tables, filled from the tokenizer itself as code points turn up, say what a
code point is lower-cased to and whether it is a letter, a number, another sign or white space; pieces are cut where the
kind changes. Distinct pieces are merged together, one merge per piece and round, and every piece takes its ids from
there. Texts with code points that combine with their neighbours or change into several go to the tokenizer's library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike

#: Code points that are looked at together, and the bytes of the longest piece that the rounds of merges take.
BLOCK_CHARS, LONGEST = 1 << 20, 64
_UNKNOWN, _SPACE, _LETTER, _NUMBER, _SIGN, _ODD = range(6)
_BREAK = re.compile(r"[\x20\t\n\r]")
_NEVER = np.int32(2**31 - 1)
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class WordTokenizer:
    """``encode_batch(texts)`` gives arrays of ids equal to the library's ``encode(text, add_special_tokens=False)``.

    With ``special_as_text``, as the tokenizer's own notes use it, the names of special tokens in a text are ordinary text, so
    that no document can forge a control token; without it they are those tokens."""

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.special_as_text = special_as_text
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        names = _byte_names()
        self.inner = np.asarray([vocab[c] for c in names], np.int32)
        self.final = np.asarray([vocab[c + "</w>"] for c in names], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._table([(vocab[a] << 16) | vocab[b] for a, b in merges], [vocab[a + b] for a, b in merges])
        self.lower, self.kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
        every = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(every.values()) + 1, bool)
        for name, number in every.items():
            self.ends[number] = name.removesuffix("</w>").endswith((".", "!", "?", "。", "！", "？"))

    def _table(self, keys: list[int], merged: list[int]) -> None:
        """Pairs of ids -> place in the list of merges, by open addressing; ``result`` has the id made there."""
        self.bits = 20
        self.slots = np.full(1 << self.bits, 2**32 - 1, np.uint32)
        self.ranks = np.full(1 << self.bits, _NEVER, np.int32)
        self.result = np.asarray([*merged, 0], np.int32)
        self.probes = 1
        for rank, key in enumerate(keys):
            at, step = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits), 1
            while self.slots[at] != 2**32 - 1:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            self.slots[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, step)

    def _rank(self, a: ArrayLike, b: ArrayLike) -> ArrayLike:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        held = self.slots[at]
        rank = np.where(held == key, self.ranks[at], _NEVER)
        open_ = np.flatnonzero((held != key) & (held != np.uint32(2**32 - 1)))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            held, key_ = self.slots[at[open_]], key[open_]
            rank[open_[held == key_]] = self.ranks[at[open_[held == key_]]]
            open_ = open_[(held != key_) & (held != np.uint32(2**32 - 1))]
        return rank

    def _classify(self, points: ArrayLike) -> None:
        """Asks the library what new code points are."""
        tokenizer = self.tokenizer
        for p in points.tolist():
            c = chr(p)
            category = unicodedata.category(c)
            small = tokenizer.normalizer.normalize_str(c) if category not in ("Cs", "Cn") else ""
            jamo = 0x1100 <= p <= 0x11FF or 0xA960 <= p <= 0xA97F or 0xD7B0 <= p <= 0xD7FF
            if category[0] == "M" or jamo or len(small) != 1 or unicodedata.normalize("NFC", c) != c:
                self.kind[p] = _ODD
                continue
            split = tokenizer.pre_tokenizer.pre_tokenize_str
            self.lower[p] = ord(small)
            if small == " ":
                self.kind[p] = _SPACE
            elif len(split("a" + small)) == 1:
                self.kind[p] = _LETTER if len(split(small)) == 1 else _SPACE
            else:
                self.kind[p] = _SIGN if len(split("." + small)) == 1 else _NUMBER

    def _library(self, text: str) -> ArrayLike:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_batch(self, texts: list[str]) -> list[ArrayLike]:
        parts, owner, size = [], [], 0
        found: list[list[ArrayLike]] = [[] for _ in texts]

        def flush():
            nonlocal parts, owner, size
            for i, ids in zip(owner, self._encode(parts) if parts else []):
                found[i].append(ids)
            parts, owner, size = [], [], 0

        for i, text in enumerate(texts):
            if not self.special_as_text and _SPECIAL.search(text):
                found[i].append(self._library(text))
                continue
            at = 0
            while at < len(text):  # whole words: nothing joins across white space
                cut = _BREAK.search(text, at + BLOCK_CHARS)
                end = cut.end() if cut else len(text)
                parts.append(text[at:end])
                owner.append(i)
                size, at = size + end - at, end
                if size >= BLOCK_CHARS:
                    flush()
        flush()
        empty = np.zeros(0, "<u4")
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in found]

    def _encode(self, parts: list[str]) -> list[ArrayLike]:
        points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[points]
        if (new := kind == _UNKNOWN).any():
            self._classify(np.unique(points[new]))
            kind = self.kind[points]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths + 1) - lengths - 1
        odd = np.flatnonzero(kind == _ODD)
        apart = np.unique(np.searchsorted(starts, odd, side="right") - 1) if len(odd) else odd
        for i in apart.tolist():
            kind[starts[i] : starts[i] + lengths[i]] = _SPACE
        points = self.lower[points]
        fresh = np.r_[True, kind[1:] != kind[:-1]] | (kind == _NUMBER)
        self._contractions(points, kind, fresh)
        fresh &= kind != _SPACE
        solid = kind != _SPACE
        first = np.flatnonzero(fresh)
        data, offsets = self._bytes(points[solid], (np.cumsum(solid) - 1)[first])
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids, ends = self._merge_all(pieces.dictionary)
        code = pieces.indices.to_numpy()
        begin = np.r_[0, ends[:-1]]
        count = (ends - begin)[code]
        total = np.cumsum(count)
        # Every piece's ids in a row: consecutive numbers from the piece's own start.
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(begin[code] - (total - count), count)
        stream = ids[at].astype("<u4")
        cuts = np.r_[0, total][np.searchsorted(first, np.r_[starts, len(points) + 1])]
        out = [stream[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for i in apart.tolist():
            out[i] = self._library(parts[i])
        return out

    @staticmethod
    def _contractions(points: ArrayLike, kind: ArrayLike, fresh: ArrayLike) -> None:
        """An apostrophe that begins a run of signs takes s, t, m, d, re, ve or ll with it; the next piece begins after."""
        marks = np.flatnonzero((points == 0x27) & fresh)
        marks = marks[marks + 1 < len(points)]
        if not len(marks):
            return
        padded = np.r_[points, 0, 0]
        a, b = padded[marks + 1], padded[marks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, size in ((one, 2), (two, 3)):
            at = marks[found]
            fresh[at + 1] = False
            after = at + size
            after = after[after < len(points)]
            fresh[after] = True

    @staticmethod
    def _bytes(points: ArrayLike, first: ArrayLike) -> tuple[ArrayLike, ArrayLike]:
        """UTF-8 of the code points, and the byte offsets of the pieces that begin at ``first``, and of the end."""
        if not len(points) or points.max() < 0x80:
            return points.astype(np.uint8), np.r_[first, len(points)].astype(np.int32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(width)
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        return data, np.r_[np.r_[0, ends][first], ends[-1]].astype(np.int32)

    def _merge_all(self, pieces: pa.BinaryArray) -> tuple[ArrayLike, ArrayLike]:
        """Ids of all pieces, one after the other, and where each piece's end."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        length = np.diff(offsets)
        counts = np.zeros(len(pieces), np.int64)
        made = []
        low = 0
        for high in (4, 8, 12, 16, 24, 40, LONGEST):
            rows = np.flatnonzero((length > low) & (length <= high))
            if len(rows):
                ids, n = self._merge(data, offsets[rows], length[rows], high)
                counts[rows] = n
                made.append((rows, ids))
            low = high
        rows = np.flatnonzero(length > LONGEST)
        if len(rows):
            coded = [self._library(pieces[i].as_py().decode()) for i in rows.tolist()]
            counts[rows] = list(map(len, coded))
            made.append((rows, np.concatenate(coded).astype(np.int32)))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, ids in made:
            n = counts[rows]
            total = np.cumsum(n)
            out[np.arange(total[-1]) + np.repeat(ends[rows] - n - (total - n), n)] = ids
        return out, ends

    def _merge(self, data: ArrayLike, start: ArrayLike, length: ArrayLike, width: int) -> tuple[ArrayLike, ArrayLike]:
        """Merges pieces of up to ``width`` bytes, a column each: every round takes each column's lowest merge, the
        leftmost on ties. Removed symbols stay in place and are stepped over by links."""
        n = len(start)
        rows = np.arange(width)[:, None]
        inside = rows < length
        symbol = np.where(inside, self.inner[data[np.minimum(start + rows, len(data) - 1)]], -1)
        last = length - 1
        symbol[last, np.arange(n)] = self.final[data[start + last]]
        after = np.broadcast_to(rows + 1, (width, n)).astype(np.int8)
        before = after - np.int8(2)
        # Rank and place in one number, so that one minimum finds both.
        best = np.full((width, n), _NEVER, np.int32)
        pairs = rows[:-1] + 1 < length
        rank = self._rank(symbol[:-1][pairs], symbol[1:][pairs])
        place = np.broadcast_to(rows[:-1], pairs.shape)[pairs]
        best[:-1][pairs] = np.where(rank == _NEVER, _NEVER, (rank << 6) | place.astype(np.int32))
        live = np.arange(n)
        view = best
        while len(live):
            low = np.minimum.reduce(view, axis=0)
            going = low != _NEVER
            if not going.all():
                live, low, view = live[going], low[going], view[:, going]
                if not len(live):
                    break
            column = np.arange(len(live))
            at = low & 63
            right = after[at, live]
            over = after[right, live]
            made = self.result[low >> 6]
            symbol[at, live] = made
            symbol[right, live] = -1
            view[right, column] = _NEVER
            after[at, live] = over
            has = over < length[live]
            new = np.full(len(live), _NEVER, np.int32)
            c, o, a = live[has], over[has], at[has]
            before[o, c] = a
            rank = self._rank(made[has], symbol[o, c])
            new[has] = np.where(rank == _NEVER, _NEVER, (rank << 6) | a)
            view[at, column] = new
            prior = before[at, live]
            has = prior >= 0
            c, p = live[has], prior[has]
            rank = self._rank(symbol[p, c], made[has])
            view[p, column[has]] = np.where(rank == _NEVER, _NEVER, (rank << 6) | p)
        kept = symbol >= 0
        return symbol.T[kept.T], kept.sum(axis=0)


@lru_cache(maxsize=2)
def word_tokenizer(path: str, special_as_text: bool = True) -> WordTokenizer:
    """One tokenizer per worker process: its tables serve all tasks that the process runs."""
    return WordTokenizer(path, special_as_text)
