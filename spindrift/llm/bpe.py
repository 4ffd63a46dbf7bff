"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A piece of text is read byte by byte. For every prefix exactly one last token belongs to its encoding: the token that
ends there, may follow the last token at its own start, and is made by merges itself. The transducer's configuration
holds the starts that a longer token can still begin at, each with its place in the vocabulary's trie and the last token
there; the last of them is the prefix's own end, so the configuration tells the prefix's last token. Reading these back
from the piece's end gives its tokens. What was decided before a start is not part of a configuration, so pieces that
differ in it share theirs. Configurations are numbered as they turn up and their transitions kept, which determinises
only the part of the machine that the corpus visits.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts_and_ids


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line per token, base64 of its bytes and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Plain BPE: merges the lowest-ranked neighbours, leftmost first, until ``until`` parts or no merges are left. Used for
    short strings."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class MergeTransducer:
    """``encode(piece)`` gives a piece's token ids; ``states`` bounds the determinised part kept in memory."""

    def __init__(self, ranks: dict[bytes, int], states: int = 200_000) -> None:
        self.ranks, self.limit = ranks, states
        self.bytes_of = {i: t for t, i in ranks.items()}
        #: The vocabulary's trie: node * 256 + byte -> node; the token that ends at a node, if merges lead to it.
        self.trie: dict[int, int] = {}
        self.token_at: list[int | None] = [None]
        #: Where a token's last merge joins its two parts.
        self._splits: dict[bytes, int] = {}
        for token, number in ranks.items():
            node = 0
            for byte in token:
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(None)
                node = child
            parts = merge_by_rank(token, ranks, 2)
            if len(parts) <= 2:  # two parts of a token merge into it
                self.token_at[node] = number
                self._splits[token] = len(parts[0])
        inner = {key >> 8 for key in self.trie}
        #: What a trie edge leads to: the node, if longer tokens go through it (else -1), and the token that ends there.
        self.moves = {key: (node if node in inner else -1, self.token_at[node]) for key, node in self.trie.items()}
        self._pairs: dict[int, bool] = {}
        self._edges: dict[tuple[bytes, bool], list[tuple[bytes, float]]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A configuration: trie node * 2**24 + last token + 1 of each start, the earliest first; a prefix's last token by its
        #: state; state * 256 + byte -> state.
        self.number, self.configs, self.last, self.next = {(0,): 0}, [(0,)], [-1], {}

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """The pieces that stand at one edge of a token while it is being made, last first, each with the rank of the
        merge that takes it in."""
        found = self._edges.get((token, right))
        if found is None:
            found, until = [], float("inf")
            while True:
                found.append((token, until))
                if len(token) == 1:
                    break
                until = self.ranks[token]
                left = self._splits[token]
                token = token[left:] if right else token[:left]
            self._edges[found[0][0], right] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border: a pair of edge pieces that stand there together would merge before
        either is taken in (on equal ranks the leftmost merge goes first)."""
        found = self._pairs.get(left << 24 | right)
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            xs, ys, ranks = self._edge(self.bytes_of[left], True), self._edge(self.bytes_of[right], False), self.ranks
            found, i, j = True, len(xs) - 1, len(ys) - 1
            while i >= 0 and j >= 0:
                (x, x_until), (y, y_until) = xs[i], ys[j]
                rank = ranks.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    found = False
                    break
                if x_until <= y_until:
                    i -= 1
                else:
                    j -= 1
            self._pairs[left << 24 | right] = found
        return found

    def _step(self, state: int, byte: int) -> int:
        moves, pairs = self.moves, self._pairs
        ends, grown = -1, []
        for start in self.configs[state]:
            move = moves.get(start >> 24 << 8 | byte)
            if move is None:
                continue
            child, token = move
            last = start & 0xFFFFFF
            if ends < 0 and token is not None:
                fits = not last or pairs.get(last - 1 << 24 | token)
                if self.may_follow(last - 1, token) if fits is None else fits:
                    ends = token
            if child >= 0:
                grown.append(child << 24 | last)
        grown.append(ends + 1)
        config = tuple(grown)
        to = self.number.get(config)
        if to is None:
            to = self.number[config] = len(self.configs)
            self.configs.append(config)
            self.last.append(ends)
        self.next[state << 8 | byte] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.configs) > self.limit:
            self._reset()
        state, following, last, bytes_of = 0, self.next, self.last, self.bytes_of
        ends: list[int] = []
        for byte in piece:
            state = following.get(state << 8 | byte) or self._step(state, byte)
            ends.append(last[state])
        ids: list[int] = []
        at = len(piece)
        while at:
            token = ends[at - 1]
            ids.append(token)
            at -= len(bytes_of[token])
        ids.reverse()
        return ids


class _Pieces(dict):
    """Piece of text -> its ids; forgets all when it holds ``limit`` pieces, so memory stays bounded."""

    def __init__(self, transducer: MergeTransducer, limit: int = 1_000_000) -> None:
        super().__init__()
        self.transducer, self.limit = transducer, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        ids = self[piece] = tuple(self.transducer.encode(piece.encode("utf-8")))
        return ids


def newer_letters() -> str:
    """The code points that the pattern library's tables have as letters or numbers and the tokenizer library's don't: of
    those that Python's own tables lack, it is asked about each."""
    import regex
    import tiktoken

    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    single = {bytes([i]): i for i in range(256)}
    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=single, special_tokens={})
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", unknown) if not known.encode_ordinary(c))


class BytePairCoder:
    """Encodes whole texts by a pretokenising pattern and a rank file, and decodes ids in a stream."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        newer = newer_letters()
        self.newer = regex.compile("[" + newer + "]") if newer else None
        self.high = re.compile(f"[{min(newer, default=chr(sys.maxunicode))}-{chr(sys.maxunicode)}]")
        self.pieces = _Pieces(MergeTransducer(ranks))
        size = max(ranks.values()) + 1
        self.table, self.names = [b""] * size, [str(i) for i in range(size)]
        for token, i in ranks.items():
            self.table[i] = token
        # The memo's tuples form no cycles: looking for some in a million of them costs a fifth of the time.
        gc.freeze()
        gc.set_threshold(1_000_000, 100, 100)

    def split(self, text: str) -> list[str]:
        """The pattern's matches. A code point that only the pattern library's tables know is matched as the sign that it is
        to the tokenizer's."""
        if self.newer is None or not self.high.search(text) or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub("\u2603", text))]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode_stream(self, ids: list[int], chunk: int = 4096):
        """Yields (bytes, text) per chunk of ids; a character cut between chunks comes out whole with the later one."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(ids), chunk):
            raw = b"".join(map(self.table.__getitem__, ids[i : i + chunk]))
            yield raw, machine.decode(raw, i + chunk >= len(ids))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> BytePairCoder:
    """One coder per worker process: its memo serves all tasks that the process runs."""
    return BytePairCoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token ids of every whole text: ``key``, ``ids array<int>``.

    Null and empty texts give an empty array; repeated rows each give their row; other columns are not read.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            keys, texts = texts_and_ids(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(c.encode, texts), pa.list_(pa.int32()))], [key, "ids"])

    frame = docs.select(F.col(key), text_of(text).alias("text"))
    kind = frame.schema[key].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Texts of token ids (``key``, ``text``); bytes that are not UTF-8 become U+FFFD, a null array becomes the empty text."""

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            texts = ["".join(t for _, t in c.decode_stream(ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    frame = encoded.select(key, "ids")
    kind = frame.schema[key].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text and digests both sides; ids stay in the task that made them.

    Null and empty texts have no ids; every row gives its own, equal rows and null doc_ids too; an empty table gives none;
    very long texts are encoded whole; columns other than doc_id and text aren't read.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            _, texts = texts_and_ids(batch)
            n, of_ids, of_bytes = [], [], []
            for text in texts:
                ids = c.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for raw, _ in c.decode_stream(ids):
                    digest.update(raw)
                of_bytes.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
