"""A run-length index of a small repetitive collection: where its strings repeat.

The index keeps the runs of the Burrows-Wheeler transform and, for the ends of the runs and the starts of the strings, a
sample: how far the suffix there matches its neighbour in suffix order. Inside a run the next match is one shorter than
the last (neighbours stay neighbours), so the matching statistics of the whole collection stream from the samples.
"""

from __future__ import annotations

import numpy as np
from numpy.typing import ArrayLike


def suffix_order(symbols: ArrayLike) -> ArrayLike:
    """Suffix array by prefix doubling from 8 symbols on; each round sorts only suffixes that are still tied."""
    n = len(symbols)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = symbols
    first = np.zeros(n, np.uint64)
    for j in range(7):
        first = (first << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    head = np.r_[True, sorted_first[1:] != sorted_first[:-1]]
    starts = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = starts[np.cumsum(head) - 1]
    h = 7
    slots = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(slots) and h < n:
        at = order[slots]
        mine, later = rank[at], rank[np.minimum(at + h, n)]
        by = np.lexsort((later, mine))
        at, mine, later = at[by], mine[by], later[by]
        order[slots] = at
        head = np.r_[True, (mine[1:] != mine[:-1]) | (later[1:] != later[:-1])]
        group = np.cumsum(head) - 1
        rank[at] = slots[np.flatnonzero(head)[group]]
        slots = slots[~(head & np.r_[head[1:], True])]
        h *= 2
    return order


def _common(symbols: ArrayLike, a: ArrayLike, b: ArrayLike, most: int) -> ArrayLike:
    """Lengths, up to ``most``, of the common prefixes of the suffixes at ``a`` and ``b``."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.full(most + 8, 511, symbols.dtype)])
    length, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        same = (padded[np.minimum(x, n)] == padded[np.minimum(y, n)]) & (x < n) & (y < n) & (length[live] < most)
        live = live[same]
        length[live] += 1
    return length


class RunLengthIndex:
    """``strings``: byte strings; matches never cross from one to the next.

    Suffix order, text and ranks serve the construction only. What stays are the transform's runs (``run_symbols``,
    ``run_lengths``) and the samples at run ends and string starts: ``up`` and ``down`` hold text places, ascending, and how
    far the suffix there matches its neighbour above or below. Their size follows the runs, not the text.
    """

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        symbols = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int16) + 1
        symbols[self.ends] = 0
        order, most = suffix_order(symbols), int(sizes.max(initial=0)) + 1
        before = symbols[order - 1]
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.run_symbols, self.run_lengths = before[heads] - 1, np.diff(np.r_[heads, len(symbols)])
        row_of = np.empty(len(symbols), np.int64)
        row_of[order] = np.arange(len(symbols))
        first = row_of[self.starts]
        self.up = self._samples(symbols, order, np.union1d(heads, first), -1, most)
        self.down = self._samples(symbols, order, np.union1d(np.r_[heads[1:] - 1, len(symbols) - 1], first), 1, most)

    @staticmethod
    def _samples(symbols: ArrayLike, order: ArrayLike, rows: ArrayLike, neighbour: int, most: int) -> tuple[ArrayLike, ArrayLike]:
        other = rows + neighbour
        inside = (other >= 0) & (other < len(symbols))
        length = np.zeros(len(rows), np.int64)
        length[inside] = _common(symbols, order[rows[inside]], order[other[inside]], most)
        by_place = np.argsort(order[rows])
        return order[rows][by_place], length[by_place]

    def _matches(self, places: ArrayLike) -> ArrayLike:
        """The longest match of the suffix at each place with any other: a sample's, less the steps since."""
        best = np.zeros(len(places), np.int64)
        for at, length in (self.up, self.down):
            i = np.searchsorted(at, places, side="right") - 1
            best = np.maximum(best, at[i] + length[i] - places)
        return best

    def repeated(self, length: int) -> ArrayLike:
        """Whether the ``length`` symbols from each position on, within its string, stand at another position too."""
        places = np.arange(self.ends[-1] + 1 if len(self.ends) else 0)
        rest = np.repeat(self.ends, np.diff(np.r_[-1, self.ends])) - places
        return (self._matches(places) >= length) & (rest >= length)
