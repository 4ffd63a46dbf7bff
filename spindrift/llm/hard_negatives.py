"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A row x gets one more component, sqrt(M^2 - |x|^2) with M the longest row's norm, and a query q gets 0: then the squared
distance of the two is |q|^2 + M^2 - 2 q.x, so that a score is a distance and a window of scores is an annulus around q.

The tree has two parts. Its top, of 2^MOST_LEVELS leaves at most, is made of a sample and known to all tasks: every row
goes down it and keeps its distances to the vantage points on its path, and each leaf has the range of these. A leaf's rows
form blocks of about BLOCK_ROWS, whose own part of the tree a task builds from the block alone. A query goes to its nearest
leaf first; the k-th score found there narrows its annulus, and it then visits the other leaves that the annulus meets.
Inside a block small leaves are read nearest first until the next one lies behind the k-th row found. Bounds only leave out
what can't be an answer; scores are whole numbers, and all answers are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block, of a block's own leaves, of the sample, levels of the top, and queries that one copy of a block answers.
BLOCK_ROWS, LEAF_ROWS, SAMPLE_ROWS, MOST_LEVELS, QUERIES = 4096, 64, 4096, 8, 256
#: Components end here, scores at 64 bits.
LARGEST = float(2**62)


def _whole(batch: pa.RecordBatch, scale: float) -> list[ArrayLike]:
    """The vectors' components as floor(scale * x)."""
    lists = batch.column(2)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    edges = np.cumsum([0, *(len(x) for x in lists)])
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def quantised(rows: DataFrame, vector: str, scale: float = 256.0) -> DataFrame:
    """row (a number of its own), vec_id, label, v (64-bit whole numbers, little-endian), size, norm2: rows that take part."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    frame = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(usable & finite)

    def run(batches):
        for batch in batches:
            found = [np.clip(x, -LARGEST, LARGEST) for x in _whole(batch, scale)]
            columns = [pa.array([x.astype("<i8").tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array([float(x @ x) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["vec_id", "label", "v", "size", "norm2"])

    made = frame.mapInArrow(run, "vec_id bigint, label bigint, v binary, size bigint, norm2 double")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(raw: list[bytes], size: int, exact: bool) -> ArrayLike:
    """Vectors as rows of one matrix, shorter ones with zeros behind. Doubles hold all scores exactly where ``exact``;
    else Python's whole numbers do."""
    out = np.zeros((len(raw), size), np.float64 if exact else object)
    for i, x in enumerate(raw):
        v = np.frombuffer(x, "<i8")
        out[i, : len(v)] = v if exact else v.astype(object)
    return out


def _floats(x: ArrayLike) -> ArrayLike:
    return x if x.dtype == np.float64 else x.astype(np.float64)


@dataclass
class Tree:
    """Vantage points and the ranges of their distances to what lies under them: a complete binary tree whose node i has
    children 2i + 1 and 2i + 2. ``low`` and ``high`` are of (leaf, level): distances to the ancestor on that level."""

    points: ArrayLike  # node -> vector, its added component last
    split: ArrayLike
    levels: int
    low: ArrayLike | None = None
    high: ArrayLike | None = None

    @property
    def above(self) -> ArrayLike:
        """leaf, level -> ancestor."""
        leaf, level = np.arange(1 << self.levels)[:, None], np.arange(self.levels)[None]
        return (1 << level) - 1 + (leaf >> (self.levels - level))


def added(x: ArrayLike, longest2: float) -> ArrayLike:
    """Rows with their added component."""
    x = _floats(x)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest2 - np.einsum("ij,ij->i", x, x)))])


def distances(x: ArrayLike, points: ArrayLike) -> ArrayLike:
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", points, points)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(0.0, d))


def plant(x: ArrayLike, levels: int) -> tuple[Tree, ArrayLike]:
    """A tree over rows with added components, and each row's leaf. A node's vantage point is its row farthest from the
    node's first; half of its rows, the nearer ones, go left."""
    nodes = (1 << levels) - 1
    points, split = np.zeros((nodes, x.shape[1])), np.zeros(nodes)
    parts = [np.arange(len(x))]
    for level in range(levels):
        lower = []
        for i, rows in enumerate(parts):
            node = (1 << level) - 1 + i
            if not len(rows):
                lower += [rows, rows]
                continue
            own = x[rows]
            points[node] = own[distances(own, own[:1])[:, 0].argmax()]
            d = distances(own, points[node : node + 1])[:, 0]
            split[node] = np.median(d)
            lower += [rows[d <= split[node]], rows[d > split[node]]]
        parts = lower
    leaf = np.zeros(len(x), np.int64)
    for i, rows in enumerate(parts):
        leaf[rows] = i
    return Tree(points, split, levels), leaf


def descend(tree: Tree, x: ArrayLike) -> tuple[ArrayLike, ArrayLike]:
    """Each row's leaf, and its distances to the vantage points on its path."""
    node, path = np.zeros(len(x), np.int64), np.zeros((len(x), tree.levels))
    d = distances(x, tree.points)
    for level in range(tree.levels):
        path[:, level] = d[np.arange(len(x)), node]
        node = 2 * node + 1 + (path[:, level] > tree.split[node])
    return node - len(tree.points), path


def bounds(tree: Tree, q: ArrayLike) -> tuple[ArrayLike, ArrayLike]:
    """Of queries (their added component is 0) and leaves: the least and the largest distance that a row there can have."""
    n = 1 << tree.levels
    least, most = np.zeros((len(q), n)), np.full((len(q), n), np.inf)
    if not tree.levels:
        return least, most
    d, above = distances(q, tree.points), tree.above
    for level in range(tree.levels):
        at = d[:, above[:, level]]
        least = np.maximum(least, np.maximum(at - tree.high[None, :, level], tree.low[None, :, level] - at))
        most = np.minimum(most, at + tree.high[None, :, level])
    return least, most


@dataclass
class Index:
    """blocks (stored): block, leaf and the rows in it; ``subs``: blocks of each leaf. ``top`` has no row data but a
    vantage point for each inner node."""

    blocks: DataFrame
    rows: DataFrame
    top: Tree
    subs: list[int]
    size: int
    longest2: float

    @property
    def exact(self) -> bool:
        return self.longest2 < 2**52


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows (block, row, vec_id, label, v), sorted by block, as one row for each block."""

    def run(batches):
        at, kept = None, []

        def out():
            columns = [np.asarray([k[i] for k in kept], np.int64).tobytes() for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([c], pa.binary()) for c in columns), pa.array([[k[3] for k in kept]], pa.list_(pa.binary()))], ["block", "rows", "ids", "labels", "vs"])

        for batch in batches:
            for block, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at and kept:
                    yield out()
                    kept = []
                at = block
                kept.append(rest)
        if kept:
            yield out()

    ordered = rows.select("block", "row", "vec_id", "label", "v").repartition("block").sortWithinPartitions("block", "row")
    return ordered.mapInArrow(run, "block bigint, rows binary, ids binary, labels binary, vs array<binary>")


def index(rows: DataFrame) -> Index:
    """The tree over rows as :func:`quantised` gives them. Its top is made of the SAMPLE_ROWS rows with the least hashes."""
    facts = rows.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("norm2").alias("longest2")).first()
    n, size, longest2 = facts["n"], facts["size"] or 0, facts["longest2"] or 0.0
    levels = 0
    while levels < MOST_LEVELS and n > BLOCK_ROWS << levels:
        levels += 1
    exact = longest2 < 2**52
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS if levels else 1).select("v").collect()]
    top, _ = plant(added(matrix(sample, size, exact), longest2), levels)

    def place(batches):
        for batch in batches:
            leaf, path = descend(top, added(matrix(batch.column(3).to_pylist(), size, exact), longest2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(list(path), pa.list_(pa.float64()))], ["row", "vec_id", "label", "v", "leaf", "path"])

    placed = rows.select("row", "vec_id", "label", "v").mapInArrow(place, "row bigint, vec_id bigint, label bigint, v binary, leaf bigint, path array<double>")
    placed = stored(placed, "placed")
    ranges = [f(F.get("path", i)).alias(f"{k}{i}") for i in range(levels) for k, f in (("low", F.min), ("high", F.max))]
    top.low, top.high, subs = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf), [0] * (1 << levels)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), *ranges).collect():  # 2^MOST_LEVELS rows at most
        subs[r["leaf"]] = -(-r["n"] // BLOCK_ROWS)
        for i in range(levels):
            top.low[r["leaf"], i], top.high[r["leaf"], i] = r[f"low{i}"], r[f"high{i}"]
    sub = F.get(F.array(*map(F.lit, subs)), F.col("leaf").cast("int"))
    block = F.shiftleft(F.col("leaf"), 40) + F.pmod(F.xxhash64("row"), sub)
    return Index(stored(_gathered(placed.withColumn("block", block)), "blocks"), placed, top, subs, size, longest2)


#: A query: its row, label, vector, whether answers have its label or another, and its windows of scores (null: no bound).
QUERY = "query bigint, label bigint, v binary, same boolean, windows array<struct<w int, lo bigint, hi bigint>>"


def _annulus(reach2: float, lo: int | None, hi: int | None, slack: float) -> tuple[float, float]:
    """Distances of a window of scores; ``reach2`` is |q|^2 + M^2."""
    near = 0.0 if hi is None else max(0.0, reach2 - 2.0 * hi) ** 0.5 - slack
    far = np.inf if lo is None else max(0.0, reach2 - 2.0 * lo) ** 0.5 + slack
    return near, far


def _routed(ix: Index, queries: DataFrame, first: bool) -> DataFrame:
    """Queries with the blocks that they visit: those of the nearest leaf, or all others that a window's annulus meets."""
    top, subs, size, longest2, exact = ix.top, ix.subs, ix.size, ix.longest2, ix.exact

    def run(batches):
        for batch in batches:
            q = _floats(matrix(batch.column(2).to_pylist(), size, exact))
            least, most = bounds(top, np.column_stack([q, np.zeros(len(q))]))
            least[:, [not s for s in subs]] = np.inf
            home, reach2 = least.argmin(1), np.einsum("ij,ij->i", q, q) + longest2
            leaves = []
            for i, windows in enumerate(batch.column(4).to_pylist()):
                if first:
                    leaves.append([int(home[i])])
                    continue
                meets, slack = np.zeros(len(subs), bool), 1e-6 * reach2[i] ** 0.5
                for w in windows:
                    near, far = _annulus(reach2[i], w["lo"], w["hi"], slack)
                    meets |= (least[i] <= far) & (most[i] >= near)
                meets &= least[i] < np.inf
                meets[home[i]] = False
                leaves.append(np.flatnonzero(meets).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    routed = queries.mapInArrow(run, f"{QUERY}, leaves array<bigint>")
    number = F.get(F.array(*map(F.lit, subs)), F.col("leaf").cast("int"))
    routed = routed.withColumn("leaf", F.explode("leaves")).drop("leaves")
    return routed.withColumn("sub", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("block", F.shiftleft(F.col("leaf"), 40) + F.col("sub")).drop("leaf", "sub")


def _best(score: ArrayLike, ids: ArrayLike, rows: ArrayLike, k: int) -> ArrayLike:
    """The places of the k largest scores, ties by id, then by row."""
    if len(score) > 4 * k and score.dtype == np.float64:
        few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        few = np.arange(len(score))
    return few[np.lexsort((rows[few], ids[few], -score[few]))[:k]] if score.dtype == np.float64 else np.asarray(sorted(few, key=lambda i: (-score[i], ids[i], rows[i]))[:k], np.int64)


def _answer(q: ArrayLike, query: dict, least: ArrayLike, most: ArrayLike, block: dict, reach2: float, k: int):
    """Answers of one query in one block: its leaves nearest first, read in growing steps; each window stops when the next
    leaf lies behind its k-th row. What one window has read the others use too."""
    x, ids, rows, labels, starts = block["x"], block["ids"], block["rows"], block["labels"], block["starts"]
    slack, order = 1e-6 * reach2**0.5, np.argsort(least, kind="stable")
    fits = ((labels == query["label"]) == query["same"]) & (rows != query["query"])
    score, read = np.zeros(len(x), x.dtype), np.zeros(len(starts) - 1, bool)
    for w in query["windows"]:
        near, far = _annulus(reach2, w["lo"], w["hi"], slack)
        leaves = order[(least[order] <= far) & (most[order] >= near)]
        found, at, step = np.zeros(0, np.int64), 0, 1
        while at < len(leaves):
            if len(found) == k and least[leaves[at]] > max(0.0, reach2 - 2.0 * float(score[found[-1]])) ** 0.5 + slack:
                break
            some = leaves[at : at + step]
            at, step = at + step, step * 4
            new = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
            if not read[some].all():
                score[new] = x[new] @ q if len(new) < len(x) // 2 else (x @ q)[new]
                read[some] = True
            s = score[new]
            ok = fits[new]
            if w["lo"] is not None:
                ok &= (s >= w["lo"]).astype(bool)
            if w["hi"] is not None:
                ok &= (s <= w["hi"]).astype(bool)
            both = np.concatenate([found, new[ok]])
            found = both[_best(score[both], ids[both], rows[both], k)]
        for i in found:
            yield query["query"], w["w"], int(min(max(score[i], -(2**63)), 2**63 - 1)), int(ids[i]), int(rows[i])


def _block(raw: dict, size: int, longest2: float, exact: bool) -> tuple[dict, Tree]:
    """A block's rows in the order of the leaves of its own tree."""
    x = matrix(raw["vs"], size, exact)
    levels = max(0, (len(x) // LEAF_ROWS).bit_length() - 1)
    wide = added(x, longest2)
    tree, leaf = plant(wide, levels)
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange((1 << levels) + 1))
    tree.low, tree.high = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf)
    d = distances(wide[order], tree.points) if levels else None
    for i in range(1 << levels):
        own = slice(starts[i], starts[i + 1])
        if levels and starts[i] < starts[i + 1]:
            here = d[own][:, tree.above[i]]
            tree.low[i], tree.high[i] = here.min(0), here.max(0)
    columns = {c: np.frombuffer(raw[c], np.int64)[order] for c in ("rows", "ids", "labels")}
    return {"x": x[order], "starts": starts, **columns}, tree


def _visit(ix: Index, routed: DataFrame, k: int) -> DataFrame:
    """query, w, score, id, row: the k best rows of each window in each block that the query visits. A block that many
    queries visit is copied, one copy for about QUERIES of them."""
    size, longest2, exact = ix.size, ix.longest2, ix.exact
    routed = stored(routed, "routed")
    copies = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    salted = routed.join(copies, "block").withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")))
    asked = salted.groupBy("block", "salt").agg(F.collect_list(F.struct("query", "label", "v", "same", "windows")).alias("queries"))  # about QUERIES each
    whole = ix.blocks.join(copies, "block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1))).drop("salts")
    joined = whole.join(asked.hint("shuffle_merge"), ["block", "salt"]).select("rows", "ids", "labels", "vs", "queries")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {c: batch.column(c)[i].as_py() for c in ("rows", "ids", "labels", "vs", "queries")}
                block, tree = _block(raw, size, longest2, exact)
                q = matrix([x["v"] for x in raw["queries"]], size, exact)
                wide = np.column_stack([_floats(q), np.zeros(len(q))])
                least, most = bounds(tree, wide)
                reach2 = np.einsum("ij,ij->i", wide, wide) + longest2
                found = [r for j, x in enumerate(raw["queries"]) for r in _answer(q[j], x, least[j], most[j], block, reach2[j], k)]
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["query", "w", "score", "id", "row"])

    return joined.mapInArrow(run, "query bigint, w int, score bigint, id bigint, row bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "w").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_in_windows(ix: Index, queries: DataFrame, k: int) -> DataFrame:
    """query, w, rank, score, id, row: the k best rows of each window of each query (QUERY; stored), ties by smaller id."""
    near = stored(_visit(ix, _routed(ix, queries, True), k), "near")
    caps = _ranked(near, k).where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("caps"))
    narrowed = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.greatest(x["lo"], F.try_element_at("caps", x["w"])).alias("lo"), x["hi"].alias("hi")))
    again = queries.join(caps, "query", "left").select("query", "label", "v", "same", narrowed.alias("windows"))
    return _ranked(near.unionByName(_visit(ix, _routed(ix, again, False), k)), k)


def hard_negatives(vectors: DataFrame, anchors: Column, vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for rows (vec_id, label, ``vector``).

    A score is the inner product of two rows, whose components become floor(scale * x). ``anchors`` is a condition on
    vec_id and label. An anchor's positives are the ``positives`` best other rows of its label; for each of them come the
    ``negatives`` best rows of other labels with low / 100 to high / 100 of its score, both ends included; ties go to the
    smaller vec_id. A negative positive score has an empty window.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part. Shorter vectors
    count as if zeros followed; an empty one scores 0. Rows that repeat a vec_id are rows of their own, also as anchors and
    as each other's positives. An empty table gives no rows; other columns aren't read. Components end at 2^62, scores at
    64 bits; beyond 2^52 of them the work is done in Python's whole numbers.
    """
    rows = quantised(vectors, vector, scale)
    ix = index(rows)
    no_bound = F.array(F.struct(F.lit(0).alias("w"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")))
    asked = stored(rows.where(anchors).select(F.col("row").alias("query"), "label", "v", F.lit(True).alias("same"), no_bound.alias("windows")), "anchors")
    best = stored(nearest_in_windows(ix, asked, positives).select("query", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    lo, hi = F.ceil(score * low / 100).cast("bigint"), F.floor(score * high / 100).cast("bigint")
    windows = best.where("positive_score >= 0").groupBy("query").agg(F.collect_list(F.struct("w", lo.alias("lo"), hi.alias("hi"))).alias("windows"))  # ``positives`` at most
    asked = stored(asked.drop("windows").join(windows, "query").withColumn("same", F.lit(False)).select("query", "label", "v", "same", "windows"), "windows")
    worst = nearest_in_windows(ix, asked, negatives).select("query", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = rows.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"))
    return worst.join(best, ["query", "w"]).join(ids, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
