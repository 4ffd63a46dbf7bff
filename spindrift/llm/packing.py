"""Packing of documents into training sequences by dynamic programming over ordered cut points.

Documents keep their order. A sequence is a window of at most ``size`` tokens of the running token stream; windows are
cut after documents (free), after sentences (a small penalty) or, in stretches without either, at regular places (a
larger one). The cost of a packing is its padding plus the penalties of its cuts. With ``f`` the least cost up to a cut
and ``S`` the cut's position, ``f[j] = penalty[j] + size - S[j] + min(f[i] + S[i])`` over the cuts ``i`` at most
``size`` tokens back: a sliding minimum, kept in a monotone queue, so the work is linear in the number of cuts.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_and_ids
from .word_bpe import word_tokenizer

SENTENCE_PENALTY, FORCED_PENALTY, FORCED_EVERY = 8, 48, 64
#: Tokens that a task holds before it settles all but the last of their sequences.
BLOCK_TOKENS = 1 << 20
def choose_cuts(places: ArrayLike, penalties: ArrayLike, size: int) -> list[int]:
    """Indices into ``places`` (ascending positions, from 0 to the end, gaps of at most ``size``) of the cheapest cuts."""
    S, pen = places.tolist(), penalties.tolist()
    cost, back = [0] * len(S), [0] * len(S)
    queue = deque([(S[0], 0)])
    for j in range(1, len(S)):
        here = S[j]
        while here - S[queue[0][1]] > size:
            queue.popleft()
        best, i = queue[0]
        back[j] = i
        value = cost[j] = best + size - here + pen[j]
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(S) - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; ``add`` and ``close`` yield lists of pieces."""

    def __init__(self, size: int, first_sequence: int, ends: ArrayLike) -> None:
        self.size, self.sequence, self.ends = size, first_sequence, ends
        self.docs: list[tuple[object, ArrayLike, int]] = []  # id, ids yet to place, ids placed before
        self.held = 0

    def add(self, key, ids: ArrayLike) -> list[tuple]:
        self.docs.append((key, ids, 0))
        self.held += len(ids)
        return self._settle(False) if self.held >= BLOCK_TOKENS else []

    def close(self) -> list[tuple]:
        return self._settle(True) if self.docs else []

    def _cut_places(self, stream: ArrayLike, doc_ends: ArrayLike) -> tuple[ArrayLike, ArrayLike]:
        kind = np.zeros(len(stream) + 1, np.int64)
        kind[np.flatnonzero(self.ends[stream]) + 1] = SENTENCE_PENALTY
        is_cut = kind > 0
        is_cut[doc_ends], kind[doc_ends], is_cut[0] = True, 0, True
        places = np.flatnonzero(is_cut)
        gaps = np.diff(places)
        for k in np.flatnonzero(gaps > FORCED_EVERY):
            extra = np.arange(places[k] + FORCED_EVERY, places[k + 1], FORCED_EVERY)
            is_cut[extra], kind[extra] = True, FORCED_PENALTY
        places = np.flatnonzero(is_cut)
        return places, kind[places]

    def _settle(self, last: bool) -> list[tuple]:
        stream = np.concatenate([ids for _, ids, _ in self.docs])
        doc_ends = np.cumsum([len(ids) for _, ids, _ in self.docs])
        places, penalties = self._cut_places(stream, doc_ends)
        cuts = places[choose_cuts(places, penalties, self.size)]
        if last:
            # The rest of the stream: powers of two need no padding.
            head = int(cuts[-2]) if len(cuts) > 1 else 0
            rest, tail = len(stream) - head, []
            while rest:
                step = min(self.size, 1 << (rest.bit_length() - 1))
                head, rest = head + step, rest - step
                tail.append(head)
            cuts = np.concatenate([cuts[:-1], np.asarray(tail, np.int64)])
        else:
            cuts = cuts[:-1]
        end = int(cuts[-1]) if len(cuts) else 0
        starts = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends < end]]))
        ends = np.append(starts[1:], end) if starts[-1] < end else starts[1:]
        starts = starts[: len(ends)]
        of_doc = np.searchsorted(doc_ends, starts, side="right")
        of_window = np.searchsorted(cuts, starts, side="right")
        window_start = np.concatenate([[0], cuts])[of_window]
        doc_start = np.concatenate([[0], doc_ends])[of_doc]
        raw, pieces = memoryview(stream.astype("<u4", copy=False).tobytes()), []
        for a, b, d, w, o, s in zip(starts.tolist(), ends.tolist(), of_doc.tolist(), of_window.tolist(), (starts - window_start).tolist(), (starts - doc_start).tolist()):
            key, ids, before = self.docs[d]
            pieces.append((key, before + s, b - a, zlib.crc32(raw[4 * a : 4 * b]), before + len(ids), self.sequence + w, o))
        self.sequence += len(cuts)
        kept, at = [], 0
        for key, ids, before in self.docs:
            if at + len(ids) > end:
                skip = max(0, end - at)
                kept.append((key, ids[skip:], before + skip))
            at += len(ids)
        self.docs, self.held = ([], 0) if last else (kept, len(stream) - end)
        return pieces


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, size: int = 4096, separator: int = 2, text: str = "text", key: str = "doc_id", special_as_text: bool = True) -> DataFrame:
    """Packs whole texts into sequences of at most ``size`` tokens; one row per piece of a document in a sequence.

    Each document is its ids and then ``separator``; null and empty texts are the separator alone. Documents are taken
    in the order and the partitions in which Spark reads them, nothing is shuffled, and each partition numbers its
    sequences in a range of its own. Repeated rows and ties are packed as often as they occur; a null key stays null;
    very long texts are encoded a block at a time; other columns aren't read. What is left at a partition's end is cut
    into powers of two, which need no padding. ``special_as_text``: see :class:`WordTokenizer`.
    """

    def run(batches):
        coder = word_tokenizer(path, special_as_text)
        packer = Packer(size, TaskContext.get().partitionId() << 33, coder.ends)
        tail = np.asarray([separator], "<u4")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def out(pieces):
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            keys, texts = texts_and_ids(batch)
            for i in range(0, len(texts), 1024):
                for k, ids in zip(keys[i : i + 1024], coder.encode_batch(texts[i : i + 1024])):
                    if pieces := packer.add(k, np.concatenate([ids, tail])):
                        yield out(pieces)
        if pieces := packer.close():
            yield out(pieces)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)
