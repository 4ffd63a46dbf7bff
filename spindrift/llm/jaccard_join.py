"""Exact Jaccard join of documents on word shingles, as a metric-space join around pivots.

1. Every distinct shingle set is a node. Of its shingles in hash order the first half is its front. Sets of n and
   N >= n shingles and similarity 0.8 share more than 3/10 N, and more than 3/8 n, shingles of their fronts. So of the
   larger set's front the last 3/10 N, and of the smaller one's the last 3/8 n, can go without losing all of the common
   ones. What goes are the shingles that stand in the most fronts: common passages.
2. Each shingle that two or more nodes still share is a region; its pivot is its smallest set, and long regions have a few
   more. Every member is compared with its region's pivots only, and what lies within the radius is linked.
3. Members of a region that are not yet in one component are compared with each other. A region with many of them is
   first cut into windows of their distance to the pivot, one radius wide: by the triangle inequality linked sets stand
   in one window or in neighbouring ones, so each member also visits its neighbours.
4. A window with many members is split again: a few of its members become pivots, every member's home is the Voronoi
   cell of its nearest pivot, and members on a border, up to two radii farther from another pivot, visit that cell too.
   Cells split until they are small, or until splitting gains nothing. A pair is compared in the smaller set's home.

Regions come first because pivots alone can't separate unrelated texts, all of which are at distance 1 from each other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SKETCH_WORDS, mix64, sketch, sketch_lacks, spread_join, stored, text_of
from .graph import connected

SHINGLE = 5
_FACTORS = (np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: A region shingle keeps this many bits of its hash; a clash only adds a candidate.
_REGION_BITS = 44


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def shingle_set(text: str) -> ArrayLike:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z as a-z, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * _FACTORS[j]
    return _distinct(mix64(total))


def _distinct(x: ArrayLike) -> ArrayLike:
    """Sorted distinct values; short arrays are sorted faster than they are hashed."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


#: Texts that are split into words at once: so few that their distinct words stay in a core's cache.
_AT_ONCE = 512


def shingle_sets(texts: pa.Array) -> list[ArrayLike]:
    """``shingle_set`` of each text. Words are split and told apart by Arrow, and a distinct one is hashed once."""
    out = []
    for at in range(0, len(texts), _AT_ONCE):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, _AT_ONCE).fill_null("")))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        which = coded.indices.to_numpy()
        full = np.fromiter(map(len, distinct), np.int64, len(distinct))[which] > 0  # white space at a text's ends leaves empty words
        ends = np.concatenate(([0], np.cumsum(full)))[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[which[full]]
        every = np.full(max(len(h) - SHINGLE + 1, 0), np.uint64(SHINGLE), np.uint64)
        for j in range(SHINGLE):
            every += h[j : len(every) + j] * _FACTORS[j]
        every = mix64(every)
        for start, end in zip(ends, ends[1:]):
            n = end - start
            if n >= SHINGLE:
                out.append(_distinct(every[start : end - SHINGLE + 1]))
            else:
                few = h[start:end] * _FACTORS[:n]
                out.append(mix64(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def set_key(s: ArrayLike) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def _second_key(s: ArrayLike) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes(), 1), "big", signed=True)


def front_length(n):
    return n // 2 + 1


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, r1, r2: 128 bits stand for a row, whose doc_id others may share."""
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return frame.select("*", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2"))


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2, n (size of the shingle set), k, k2 (the set's 128 bits) and its sketch w0, w1, ..: equal sets have
    equal n, k and k2."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(3))
            words = list(zip(*map(sketch, sets))) if sets else [[]] * SKETCH_WORDS
            found = [[len(s) for s in sets], [set_key(s) for s in sets], [_second_key(s) for s in sets], *words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in found)], names)

    names = ["doc_id", "r1", "r2", "n", "k", "k2", *(f"w{i}" for i in range(SKETCH_WORDS))]
    return _texts(docs).select("doc_id", "r1", "r2", "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def fronts(docs: DataFrame) -> DataFrame:
    """s (region shingle), k, n for each shingle of each set's front; a task gives a set that it meets again only once
    while it remembers it."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            parts, keys, sizes = [], [], []
            for s in shingle_sets(batch.column(0)):
                key = set_key(s)
                if len(s) == 0 or key in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                front = s[: front_length(len(s))] >> np.uint64(64 - _REGION_BITS)
                parts.append(_distinct(front))
                keys.append(key)
                sizes.append(len(s))
            if parts:
                times = [len(p) for p in parts]
                columns = [np.concatenate(parts).astype(np.int64), np.repeat(np.asarray(keys, np.int64), times), np.repeat(np.asarray(sizes, np.int64), times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s", "k", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "s bigint, k bigint, n bigint")


def regions(docs: DataFrame) -> DataFrame:
    """s, k, n, small: the shingles of each node's front that it shares with another, less the commonest. Two linked sets
    meet in a region where the smaller one's row has ``small``."""
    rows = fronts(docs).repartition("s").groupBy("s", "k", "n").agg(F.lit(1).alias("one"))
    shared = rows.withColumn("c", F.count("*").over(Window.partitionBy("s"))).where("c > 1").select("s", "k", "n", "c")
    shared = stored(shared, "fronts")
    # Rarest first; shingles of one set alone come before all of these.
    in_set = Window.partitionBy("k", "n")
    from_end = F.count("*").over(in_set) - F.row_number().over(in_set.orderBy("c", "s"))
    kept = shared.withColumn("from_end", from_end).where(F.col("from_end") >= F.floor(F.col("n") * 3 / 10) - 1)
    kept = kept.withColumn("small", F.col("from_end") >= F.floor(F.col("n") * 3 / 8) - 1)
    return kept.select("s", "k", "n", "small")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def similarities(pairs: DataFrame, docs: DataFrame, per_task: int = 64) -> DataFrame:
    """pairs (a, ka, ra, b, kb, rb: nodes, set hashes, keys of a row with the set) -> a, b, both, either: sizes of
    intersection and union.

    The set of ``a`` travels once to each of its tasks, the partners of an ``a`` with more than ``per_task`` of them are
    dealt to several, and a task holds one set at a time.
    """
    pairs = pairs.withColumn("salts", F.ceil(F.count("*").over(Window.partitionBy("a")) / per_task))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    hub = pairs.select("a", "ka", "ra", "salts").distinct()
    hub = hub.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.col("ka").alias("k"), F.col("ra").alias("row"), F.lit(0).alias("role"))
    asked = hub.union(pairs.select("a", "salt", F.col("b").alias("node"), F.col("kb").alias("k"), F.col("rb").alias("row"), F.lit(1).alias("role")))
    texts = _texts(docs).select("r1", "text").join(asked.hint("shuffle_merge"), F.col("r1") == F.col("row")).select("a", "salt", "role", "node", "k", "text")

    def sets(batches):
        for batch in batches:
            found = shingle_sets(batch.column(5))
            right = pa.array([set_key(s) == k for s, k in zip(found, batch.column(4).to_pylist())])
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((s.tobytes() for s in found), pa.binary())], ["a", "salt", "role", "node", "shingles"])
            yield out.filter(right)

    def compare(batches):
        hub_of, hub_set = None, None
        for batch in batches:
            rows = []
            for a, salt, role, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    hub_of, hub_set = (a, salt), s
                elif hub_of == (a, salt):
                    both = np.intersect1d(hub_set, s, assume_unique=True).size
                    rows.append((a, node, both, len(hub_set) + len(s) - both))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "both", "either"])

    made = texts.mapInArrow(sets, "a bigint, salt bigint, role int, node bigint, shingles binary")
    return made.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, "a bigint, b bigint, both bigint, either bigint")


#: Members of a region or cell above which it is split again, pivots of a split, and rounds at most.
CELL_MEMBERS, CELL_PIVOTS, ROUNDS = 4096, 8, 6


def more_pivots(left: DataFrame) -> DataFrame:
    """pivot, node: pairs of members of long lists (s, node, length) and some pivots.

    Each node does this in the longest of its lists alone, so that a group of near copies, whose lists are many and much
    the same, is paired once. A list of m nodes that do so has log2(m / 8) pivots, those of the least hashes; lists of fewer
    than 16 have none, they are compared in full anyway."""
    longest = left.groupBy("node").agg(F.max(F.struct("length", "s")).alias("x")).select("node", F.col("x.s").alias("s"))
    longest = stored(longest, "longest")
    sizes = longest.groupBy("s").agg(F.count("*").alias("n_rows")).withColumn("wanted", F.floor(F.log2(F.col("n_rows") / 8)).cast("int")).where("wanted > 0")
    sizes = stored(sizes, "long-lists")
    inside = stored(spread_join(longest, sizes, ["s"], ["node"]), "in-long-lists")
    turn = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("node"), "node"))
    few = inside.withColumn("turn", turn).where(F.col("turn") <= 60).where(F.col("turn") <= F.col("wanted"))  # log2 of any count is below 60
    few = few.groupBy("s").agg(F.collect_list("node").alias("pivots")).join(sizes.select("s", "n_rows"), "s")
    met = spread_join(inside.select("s", "node"), stored(few, "more-pivots"), ["s"], ["node"])
    return met.select(F.explode("pivots").alias("pivot"), "node").where("pivot <> node")


#: Lists of a node, the first ones, by which a pair is made once.
FIRST_LISTS = 16


def first_lists(lists: DataFrame) -> DataFrame:
    """node, lists: the FIRST_LISTS smallest of a node's lists (s, node)."""
    return lists.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("s")), 1, FIRST_LISTS).alias("lists"))


def is_first(a: str, b: str, s: str) -> Column:
    """Whether ``s`` is the smallest list that two nodes share. Where their first lists have none in common this can't be
    told, and any list will do; a common one among them is the smallest of all."""
    return F.coalesce(F.array_min(F.array_intersect(a, b)), F.col(s)) == F.col(s)


def _pairs_with_pivot(members: DataFrame) -> DataFrame:
    """members (.., node, k, rep, p: struct<node, k, rep>) -> pairs as ``similarities`` takes them."""
    apart = members.where(F.col("p.node") != F.col("node"))
    return apart.select(F.col("p.node").alias("a"), F.col("p.k").alias("ka"), F.col("p.rep").alias("ra"), F.col("node").alias("b"), F.col("k").alias("kb"), F.col("rep").alias("rb")).distinct()


def _pairs_of_nodes(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (pivot, node) whose sizes fit, as ``similarities`` takes them."""
    pairs = stored(pairs, "node-pairs")
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("k").alias(f"k{x}"), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    hubs = stored(pairs.groupBy(F.col("pivot").alias("a")).agg(F.count("*").alias("n_rows")).join(of("a"), "a"), "hubs")
    met = spread_join(pairs.withColumnsRenamed({"pivot": "a", "node": "b"}).join(of("b"), "b"), hubs, ["a"], ["b"])
    return met.where(_sizes_fit(F.col("na"), F.col("nb"), percent)).select("a", "ka", "ra", "b", "kb", "rb")


def _distances(measured: DataFrame) -> DataFrame:
    return measured.select(F.col("a").alias("pivot"), F.col("b").alias("of"), (1 - F.col("both") / F.col("either")).alias("distance")).distinct()


def _measure(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members with ``distance``, to the pivot ``p``."""
    found = _distances(similarities(_pairs_with_pivot(members), docs))
    joined = members.join(found, (F.col("p.node") == F.col("pivot")) & (F.col("node") == F.col("of")), "left").drop("pivot", "of")
    return joined.withColumn("distance", F.when(F.col("p.node") == F.col("node"), 0.0).otherwise(F.coalesce("distance", F.lit(1.0))))


def _windows(members: DataFrame, radius: float) -> DataFrame:
    """Members in the windows of their distance to the pivot, and as visitors (``home`` false) in the neighbouring ones."""
    own = F.floor(F.col("distance") / radius).cast("int")
    spread = members.withColumn("own", own).withColumn("window", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    cell = F.xxhash64("s", "window").alias("cell")
    return spread.select(cell, "node", "k", "rep", "n", "small", "component", (F.col("window") == F.col("own")).alias("home"))


def _split(cells: DataFrame, docs: DataFrame, radius: float, seed: int) -> DataFrame:
    """The cells' Voronoi cells around CELL_PIVOTS of their members, with visitors from two radii beyond the borders."""
    order = Window.partitionBy("cell").orderBy("turn", "node")
    pivots = cells.select("cell", "node", "k", "rep", F.xxhash64(F.lit(seed), "k").alias("turn"))
    # Each task puts forward its first few, then the first of these are taken.
    few = pivots.groupBy("cell", F.pmod(F.xxhash64("node"), F.lit(64)).alias("salt")).agg(F.min(F.struct("turn", "node", "k", "rep")).alias("x")).select("cell", "x.*")
    few = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CELL_PIVOTS)
    few = few.groupBy("cell").agg(F.collect_list(F.struct("node", "k", "rep")).alias("ps"))
    asked = cells.join(few, "cell").withColumn("p", F.explode("ps")).drop("ps")
    asked = stored(_measure(asked, docs), "cell-distances")
    nearest = asked.groupBy("cell", "node").agg(F.min(F.struct("distance", "p.node")).alias("home_is"))
    joined = asked.join(nearest.hint("shuffle_merge"), ["cell", "node"]).where(F.col("distance") <= F.col("home_is.distance") + 2 * radius)
    own = F.col("p.node") == F.col("home_is.node")
    return joined.select(F.xxhash64("cell", "p.node").alias("cell"), "node", "k", "rep", "n", "small", "component", (F.col("home") & own).alias("home"))


def _cells(members: DataFrame, docs: DataFrame, measured: DataFrame, radius: float) -> DataFrame:
    """cell, node, k, rep, n, small, component, home: regions, windows of those with many members, and the Voronoi cells
    of windows with many. Only the members of large regions need their distance to the pivot, of which ``measured`` has
    some."""
    names = ["node", "k", "rep", "n", "small", "component"]
    done = members.where(F.col("members") <= CELL_MEMBERS).select(F.xxhash64("s").alias("cell"), *names, F.lit(True).alias("home"))
    large = members.where(F.col("members") > CELL_MEMBERS)
    if large.isEmpty():
        return done
    known = large.join(_distances(measured), (F.col("p.node") == F.col("pivot")) & (F.col("node") == F.col("of")), "left").drop("pivot", "of")
    known = stored(known, "large-regions")
    far = _measure(known.where("distance is null").drop("distance"), docs)  # sets far larger than the pivot
    cells = stored(_windows(known.where("distance is not null").unionByName(far), radius), "windows")
    for seed in range(ROUNDS):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("members"))
        large = sizes.where(F.col("members") > CELL_MEMBERS)
        square = lambda f, c: f.agg(F.sum(F.col(c) * F.col(c).cast("double")).alias("x")).first()["x"]
        before = square(large, "members")
        if before is None:
            break
        finer = stored(_split(cells.join(large.select("cell"), "cell"), docs, radius, seed), "cells")
        done = done.union(cells.join(large.select("cell"), "cell", "left_anti"))
        if square(finer.groupBy("cell").agg(F.count("*").alias("m")), "m") > 0.8 * before:  # as far from each other as from the pivots
            cells = cells.join(large.select("cell"), "cell")
            break
        cells = finer
    return done.union(cells)


def classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, r1, r2 (a row's 128 bits), n_shingles, component (a number that its component alone has; null for the empty
    set), component_id: see :func:`near_duplicates`."""
    if percent < 80:
        raise ValueError("percent must be at least 80")
    radius = 1 - percent / 100 + 1e-9
    keys = stored(set_keys(docs), "keys")
    # Stored, for the numbers of the nodes must stay.
    nodes = keys.where("n > 0").groupBy("k", "k2", "n").agg(F.min("doc_id").alias("low"), F.min("r1").alias("rep"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = stored(regions(docs).join(nodes.select("k", "n", "node", "rep"), ["k", "n"]), "regions")

    pivots = member.groupBy("s").agg(F.min(F.when(F.col("small"), F.struct("n", "node", "k", "rep"))).alias("p"), F.count("*").alias("n_rows"))
    pivots = stored(pivots.where("n_rows > 1 and p is not null").withColumn("length", F.col("n_rows")), "pivots")
    member = stored(spread_join(member, pivots, ["s"], ["node"]), "members")
    around = member.where((F.col("p.node") != F.col("node")) & _sizes_fit(F.col("p.n"), F.col("n"), percent))
    further = _pairs_of_nodes(more_pivots(member.select("s", "node", F.col("length"))), nodes, percent)
    measured = stored(similarities(_pairs_with_pivot(around).unionByName(further).distinct(), docs), "measured")
    near = F.col("both") * 100 >= F.col("either") * percent
    found = stored(connected(measured.where(near).select("a", "b")), "components")

    # Open regions: their members aren't in one component yet.
    label = member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = label.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_rows"))
    open_ = stored(open_.where("low < high").select("s", "n_rows", F.col("n_rows").alias("members")), "open-regions")
    label = stored(spread_join(label.drop("length"), open_, ["s"], ["node"]).where("node <> p.node"), "open")
    cells = _cells(label, docs, measured, radius)
    drawn = keys.select(F.col("r1").alias("of"), F.col("k").alias("of_k"), *[f"w{i}" for i in range(SKETCH_WORDS)])
    cells = cells.join(drawn.hint("shuffle_merge"), (F.col("rep") == F.col("of")) & (F.col("k") == F.col("of_k"))).drop("of", "of_k").distinct()
    # A pair is made where the smaller set is at home and its row is marked: linked sets visit each other's homes. Of several
    # such cells the first one makes it.
    every = cells.select(F.col("cell").alias("s"), "node")
    own = first_lists(cells.where("home and small").select(F.col("cell").alias("s"), "node")).withColumnRenamed("lists", "own")
    cells = cells.join(first_lists(every).hint("shuffle_merge"), "node").join(own.hint("shuffle_merge"), "node", "left")
    cells = stored(cells, "sketched")
    names = ["node", "k", "rep", "n", "small", "component", "home", "lists", "own", *[f"w{i}" for i in range(SKETCH_WORDS)]]
    left, right = (cells.select("cell", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    # Linked sets have this many shingles in common; what one of them lacks shows in the sketches.
    common = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent))
    alike = (sketch_lacks("a_w", "b_w") <= F.col("a_n") - common) & (sketch_lacks("b_w", "a_w") <= F.col("b_n") - common)
    open_pairs = (F.col("a_n") <= F.col("b_n")) & (F.col("a_component") != F.col("b_component"))
    once = is_first("a_own", "b_lists", "cell")
    rest = left.where("a_small and a_home").join(right.hint("shuffle_merge"), "cell").where(open_pairs & _sizes_fit(F.col("a_n"), F.col("b_n"), percent) & alike & once)
    rest = rest.select(*[F.col(f"{side}_{c}").alias(new) for side in "ab" for c, new in (("node", side), ("k", f"k{side}"), ("rep", f"r{side}"))]).distinct()
    rest = stored(rest.join(measured.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = stored(similarities(rest, docs).where(near).select("a", "b"), "more")
        if not more.isEmpty():
            found = stored(connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")
    labelled = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = labelled.groupBy("component").agg(F.min("low").alias("least"))
    by_set = labelled.join(lows, "component").select(F.col("k").alias("of"), F.col("k2").alias("of2"), F.col("n").alias("of_n"), "component", "least")
    joined = keys.join(by_set.hint("shuffle_merge"), (F.col("k") == F.col("of")) & (F.col("k2") == F.col("of2")) & (F.col("n") == F.col("of_n")), "left")
    return joined.select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), "component", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links of similarity
    ``percent`` / 100 or more reach).

    ``percent`` must be 80 or more, for the fronts are made for that. A null or blank text has the empty set and stands
    alone; a text of fewer than five words is one shingle; equal sets are linked and compared once; rows that repeat a
    doc_id each get a row, by their own text; a null doc_id is nobody's smallest. An empty table gives no rows, very long
    texts are sets like others, and columns other than doc_id and text aren't read. Sets are told apart by 128 bits of
    the 64-bit hashes of their shingles.
    """
    return classes(docs, percent).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less near duplicates: of each component the row with the smallest doc_id stays,
    of equal doc_ids the one with the smallest text hash; rows with the empty set stay. Rows with equal doc_id and text are
    one row, with the least of the other columns."""
    found = classes(docs, percent)
    alone = found.where("component is null").select("r1", "r2").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")
    stay = alone.union(found.where("component is not null").groupBy("component").agg(F.min(order).alias("x")).select("x.r1", "x.r2"))
    keyed = docs.select(F.col("text").alias("_t"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row"), *[F.xxhash64(*x).alias(n) for n, x in (("r1", _row_of(docs)), ("r2", [F.lit(1), *reversed(_row_of(docs))]))])
    once = keyed.groupBy("r1", "r2").agg(F.first("_t").alias("text"), F.min("_row").alias("_row"))
    return once.join(stay.withColumnsRenamed({"r1": "s1", "r2": "s2"}).hint("shuffle_merge"), (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")), "left_semi").select("_row.*", "text").select(*docs.columns)


def _row_of(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].cast("bigint"), F.coalesce(docs["text"].cast("string"), F.lit(""))]
