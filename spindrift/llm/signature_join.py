"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Every distinct shingle set is a node. Its signature has COORDINATES values: per coordinate the member that a hash
   function of its own puts first. Two sets of similarity s agree in each coordinate with chance s, independently.
2. A node is posted under each of its (coordinate, value) pairs. A pair's frequency is counted; the pairs that one node
   alone has can't collide and go.
3. A link must have MATCHES collisions. So if each node's pairs are ordered by frequency, linked nodes share one of their
   first COORDINATES - MATCHES + 1 pairs: these are the prefix, and the others, with the longest lists, are skipped when
   lists are merged. What the merge finds is probed in whole signatures: collisions are counted in all coordinates.
4. Each list's smallest set is its pivot, and long lists have a few more. Members meet their pivots first, which is linear
   in the lists' lengths; pairs with MATCHES collisions are confirmed on the full sets, and confirmed links make components.
5. Lists whose members aren't in one component yet are merged in full: members of different components meet, and those with
   MATCHES collisions that the sketches of their sets don't rule out are confirmed too. Long lists, whose members often
   share a passage rather than a text, are merged by their members' rarest shingles, which loses no link.
6. A loose group of m near copies, of which most are linked but few by a pivot, has links in proportion to m squared.
   So in long lists one pair of SAMPLE ** i is tried first, then one of SAMPLE ** (i - 1), at last every one. What a round
   confirms puts most of the group in one component, and its pairs meet no more: a node has SAMPLE links to other components
   left for the next round at most, as can be expected. The last round leaves out nothing but pairs in one component.

The chance that a link of similarity 0.85 has fewer than 29 collisions of 64 is 3e-14, so all links are found but for that;
no list is capped. A component's documents are linked by confirmed links only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SKETCH_WORDS, mix64, sketch, sketch_lacks, spread_join, stored
from .graph import connected
from .jaccard_join import _second_key, _texts, first_lists, is_first, more_pivots, set_key, shingle_sets, similarities

COORDINATES, MATCHES = 64, 29
_ODD = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALT = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Members of a set that are hashed at once.
_CHUNK = 4096


def signature(s: ArrayLike) -> ArrayLike:
    """Per coordinate 32 bits of the member with the least hash."""
    least, value = np.full(COORDINATES, ~np.uint64(0)), np.zeros(COORDINATES, np.uint64)
    for i in range(0, len(s), _CHUNK):
        part = s[i : i + _CHUNK]
        h = (part[None] ^ _SALT[:, None]) * _ODD[:, None]
        at = h.argmin(1)
        low = h[np.arange(COORDINATES), at]
        value = np.where(low <= least, part[at], value)
        least = np.minimum(low, least)
    return (value >> np.uint64(32)).astype(np.uint32)


_WORDS = [f"w{i}" for i in range(SKETCH_WORDS)]


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (a row's 128 bits), n (size of the shingle set), k, k2 (the set's 128 bits), sig (the signature, two
    coordinates in one number), bits (the last bit of each coordinate) and the set's sketch w0, w1, .."""

    def run(batches):
        for batch in batches:
            found = shingle_sets(batch.column(3))
            drawn = [signature(s) for s in found]
            bits = [int(np.packbits((x & 1).astype(np.uint8), bitorder="little").view("<i8")[0]) for x in drawn]
            numbers = [[len(s) for s in found], [set_key(s) for s in found], [_second_key(s) for s in found], bits, *(list(zip(*map(sketch, found))) if found else [[]] * SKETCH_WORDS)]
            sig = pa.array([x.view("<i8").tolist() for x in drawn], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in numbers), sig], names)

    names = ["doc_id", "r1", "r2", "n", "k", "k2", "bits", *_WORDS, "sig"]
    return _texts(docs).select("doc_id", "r1", "r2", "text").mapInArrow(run, ", ".join(f"{n} {'array<bigint>' if n == 'sig' else 'bigint'}" for n in names))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def collisions(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree."""
    both = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    one = lambda x: F.when(x.bitwiseAND(F.lit(0xFFFFFFFF)) == 0, 1).otherwise(0) + F.when(F.shiftrightunsigned(x, 32) == 0, 1).otherwise(0)
    return F.aggregate(both, F.lit(0), lambda n, x: n + one(x))


def alike(percent: int) -> Column:
    """Whether nodes a and b (columns a_n, a_bits, a_w0, .., b_n, ..) may be linked, by what is cheap to tell: by their
    sizes, by their sketches, as linked sets have so many members in common, and by the bits of their coordinates."""
    common = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    fits = (sketch_lacks("a_w", "b_w") <= F.col("a_n") - common) & (sketch_lacks("b_w", "a_w") <= F.col("b_n") - common)
    return sizes & (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= COORDINATES - MATCHES) & fits


def postings(nodes: DataFrame) -> DataFrame:
    """s (coordinate and value), node."""
    halves = lambda x, i: F.array(F.shiftleft((2 * i).cast("bigint"), 32).bitwiseOR(x.bitwiseAND(F.lit(0xFFFFFFFF))), F.shiftleft((2 * i + 1).cast("bigint"), 32).bitwiseOR(F.shiftrightunsigned(x, 32)))
    return nodes.select("node", F.explode(F.flatten(F.transform("sig", halves))).alias("s"))


def lists(nodes: DataFrame) -> DataFrame:
    """s, node: the lists that are merged: each node's prefix, less what no other node has."""
    posted = postings(nodes)
    counts = posted.groupBy("s").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    counts = stored(counts.withColumn("c", F.col("n_rows")), "frequencies")
    shared = spread_join(posted, counts, ["s"], ["node"])
    in_node = Window.partitionBy("node")
    from_end = F.count("*").over(in_node) - F.row_number().over(in_node.orderBy("c", "s"))
    return shared.withColumn("from_end", from_end).where(F.col("from_end") >= MATCHES - 1).select("s", "node")


_OF_NODE = ["node", "k", "rep", "n", "sig", "bits", *_WORDS]


def _side(frame: DataFrame, side: str, more: list[str] = ()) -> DataFrame:
    return frame.select(*more, *[F.col(c).alias(f"{side}_{c}") for c in _OF_NODE])


def _as_pairs(frame: DataFrame) -> DataFrame:
    """The pairs with MATCHES collisions, as ``similarities`` takes them."""
    frame = stored(frame.select(*[f"{side}_{c}" for side in "ab" for c in ("node", "k", "rep", "sig")]), "met").where(collisions("a_sig", "b_sig") >= MATCHES)
    names = (("node", ""), ("k", "k"), ("rep", "r"))
    return frame.select(*[F.col(f"{side}_{c}").alias(f"{new}{side}" if new else side) for side in "ab" for c, new in names])


def _met(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (pivot, node; distinct) that may be linked, as ``similarities`` takes them."""
    pairs = stored(pairs, "pivot-pairs")
    hubs = pairs.groupBy("pivot").agg(F.count("*").alias("n_rows"))
    hubs = stored(hubs.join(_side(nodes, "a"), F.col("pivot") == F.col("a_node")), "hubs")
    met = spread_join(pairs.join(_side(nodes, "b"), F.col("node") == F.col("b_node")), hubs, ["pivot"], ["b_node"])
    return _as_pairs(met.where(alike(percent)))


#: Bits of the filter of texts for each row that is asked for, and at most.
FILTER_BITS, MOST_BITS = 8, 2**25


def asked_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose r1 is in ``rows`` (r1), and of few others, which a join tells apart later.

    Texts are most of what a join by r1 would shuffle, and few of them are asked for. So the asked rows' bits are broadcast,
    64 to a number, and the other texts go before they travel. Beyond MOST_BITS more of the others pass, never fewer of the
    asked ones."""
    rows = stored(rows.distinct(), "asked")
    numbers = 1 << max(0, (min(rows.count() * FILTER_BITS, MOST_BITS) - 1).bit_length() - 6)
    number, bit = F.col("r1").bitwiseAND(F.lit(numbers - 1)).alias("number"), F.shiftrightunsigned("r1", 58).cast("int")
    bits = rows.groupBy(number).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    return _texts(docs).select("doc_id", "text", "r1", number).join(F.broadcast(bits), "number").where(F.getbit("bits", bit) == 1).select("doc_id", "text")


def linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """a, b: of the pairs (as ``similarities`` takes them) those that the full sets confirm."""
    rows = pairs.select(F.explode(F.array("ra", "rb")).alias("r1"))
    return similarities(pairs, asked_texts(docs, rows)).where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def with_pivots(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's pivots and its members: its smallest set and, in long lists, some more."""
    n = members.join(nodes.select("node", "n"), "node")
    pivots = n.groupBy("s").agg(F.min(F.struct("n", "node")).alias("p"), F.count("*").alias("n_rows"))
    pivots = stored(pivots.select("s", F.col("p.node").alias("pivot"), "n_rows", F.col("n_rows").alias("length")), "pivots")
    met = stored(spread_join(members, pivots, ["s"], ["node"]), "members")
    pairs = met.where("node <> pivot").select("pivot", "node").unionByName(more_pivots(met.select("s", "node", "length")))
    return _met(pairs.distinct(), nodes, percent)


def open_lists(members: DataFrame, found: DataFrame) -> DataFrame:
    """s, node, component, length and low (of the list: its members and least component): lists whose members aren't in
    one component."""
    label = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = stored(label, "labelled")
    per_list = label.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_rows"))
    per_list = stored(per_list.where("low < high").select("s", "n_rows", F.col("n_rows").alias("length"), "low"), "open-lists")
    return stored(spread_join(label, per_list, ["s"], ["node"]), "open")


#: Lists of more members than that are merged by the members' rarest shingles too.
LONG = 256


def rare_fronts(left: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """s, node for the members of long lists: lists by shingle, of those members that have the shingle in their front.

    Members of a long list often share a passage that makes up most of them, and collide in its coordinates. Linked sets
    have ``percent`` of the larger one in common, so of the smaller set's and of the larger set's shingles, the commonest
    last, the first that they share stands in both fronts, which are all but ``percent`` of a set."""
    long = left.where(F.col("length") > LONG).select("node").distinct().join(nodes.select("node", "k", "rep", "n"), "node")
    long = stored(long, "long-members")
    texts = _texts(asked_texts(docs, long.select(F.col("rep").alias("r1")))).select("r1", "text").join(long.hint("shuffle_merge"), F.col("r1") == F.col("rep")).select("node", "k", "n", "text")

    def run(batches):
        for batch in batches:
            node, k, n = (c.to_pylist() for c in batch.columns[:3])
            for i, s in enumerate(shingle_sets(batch.column(3))):
                if set_key(s) == k[i]:
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), node[i])), pa.array(np.full(len(s), n[i]))], ["s", "node", "n"])

    rows = stored(texts.mapInArrow(run, "s bigint, node bigint, n bigint").distinct(), "shingles")
    counts = stored(rows.groupBy("s").agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumn("c", F.col("n_rows")), "shingle-counts")
    in_node = Window.partitionBy("node")
    after = F.count("*").over(in_node) - F.row_number().over(in_node.orderBy("c", "s"))
    kept = spread_join(rows, counts, ["s"], ["node"]).withColumn("after", after).where(F.col("after") >= F.ceil(F.col("n") * percent / 100) - 1)
    return kept.select(F.col("s").bitwiseOR(F.lit(-(2**63))).alias("s"), "node")  # below all coordinates' lists


#: Each round compares so many times more of the pairs of long lists than the one before.
SAMPLE = 16


def shares(merged: DataFrame) -> list[int]:
    """For each round, of how many pairs of a list (s, node) one is tried: the last round is 1, others are for long lists."""
    longest = merged.groupBy("s").count().agg(F.max("count").alias("n")).first()["n"] or 0
    out = [1]
    while longest > SAMPLE**2 * out[0]:
        out.insert(0, SAMPLE * out[0])
    return out


def open_pairs(left: DataFrame, known: DataFrame, percent: int, share: int) -> DataFrame:
    """Pairs of members of open lists (as of :func:`open_lists`) that may be linked and aren't in one component, as
    ``similarities`` takes them. A pair that shares several lists is made in the first of them. With a ``share`` above 1,
    the members of a list are dealt into so many parts, members of one part meet, and short lists wait.

    A component's number is its least node's, so the largest one mostly has the list's least number; its members only meet
    the others, never each other."""
    if share > 1:
        left = left.where(F.col("length") > 4 * share)
    part = F.pmod(F.xxhash64("s", "node"), F.lit(share)).alias("part")
    every = stored(left.select("s", "node", "component", (F.col("component") == F.col("low")).alias("lowest"), part).join(known, "node"), "merged")
    one, two = (_side(every, side, ["s", "part", *[F.col(c).alias(f"{side}_{c}") for c in ("component", "lowest", "lists")]]) for side in "ab")
    ordered = F.col("b_lowest") | (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))
    two = two.withColumnsRenamed({"s": "s2", "part": "part2"}).hint("shuffle_merge")
    same = (F.col("s") == F.col("s2")) & (F.col("part") == F.col("part2")) & (F.col("a_component") != F.col("b_component"))
    return _as_pairs(one.where("not a_lowest").join(two, same & ordered & alike(percent) & is_first("a_lists", "b_lists", "s"))).distinct()


def join_open(left: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The components ``found`` (node, component) joined by the links between members of open lists (s, node, component,
    length) in different ones."""
    short = left.where(F.col("length") <= LONG).select("s", "node")
    merged = stored(short.unionByName(rare_fronts(left, nodes, docs, percent)), "merged-lists")
    known = stored(first_lists(merged).join(nodes.select(*_OF_NODE), "node"), "known")
    for share in shares(merged):
        rest = stored(open_pairs(open_lists(merged, found), known, percent, share), "rest")
        more = stored(linked(rest, docs, percent), "more-links")
        if not more.isEmpty():
            found = stored(connected(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")
    return found


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links of similarity
    ``percent`` / 100 or more reach), kept (whether it is that document).

    ``percent`` must be 85 or more: MATCHES is made for that. A null or blank text has the empty set, stands alone and is
    kept; a text of fewer than five words is one shingle; equal sets are one node; rows that repeat a doc_id each get a
    row, by their own text; a null doc_id is nobody's smallest, and kept only where its component has no other. An empty
    table gives no rows, very long texts are sets like others, and columns other than doc_id and text aren't read. Sets are
    told apart by 128 bits of the 64-bit hashes of their shingles.
    """
    if percent < 85:
        raise ValueError("percent must be at least 85")
    every = stored(sets(docs), "sets")
    by_set = every.where("n > 0").groupBy("k", "k2", "n").agg(F.min("doc_id").alias("low"), F.min("r1").alias("rep"), F.count("*").alias("n_rows"), *[F.min(c).alias(c) for c in ("sig", "bits", *_WORDS)])
    nodes = stored(by_set.withColumn("node", F.monotonically_increasing_id()), "nodes")  # stored, for the numbers must stay
    members = stored(lists(nodes), "lists")
    links = stored(linked(with_pivots(members, nodes, percent), docs, percent), "links")
    found = stored(connected(links), "components")
    found = join_open(open_lists(members, found), found, nodes, docs, percent)
    labelled = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("low").alias("least"))
    of_set = stored(labelled.join(least, "component").select("k", "k2", "n", "n_rows", "least"), "classes")
    named = spread_join(every.where("n > 0").select("doc_id", "r1", "k", "k2", "n"), of_set, ["k", "k2", "n"], ["r1"]).select("doc_id", "n", "least")
    named = named.unionByName(every.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("least")))
    component = F.coalesce("least", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
