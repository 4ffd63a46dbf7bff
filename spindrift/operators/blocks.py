"""Sparse matrices as masks of blocks: a tile has 64 x 64 blocks of ``side`` x ``side``, and a word for each row of blocks.

A set bit stands for a block that is the identity times the tile's weight for it (1 without weights). Tiles are rows (bi,
bj, masks), vectors rows (bj, x), so that a product is a join on the tiles' columns and a sum over their rows; blocks whose
bit isn't set are never looked at, and tiles without any leave before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, ROWS = 4, 64


def _set(mask: Column) -> Column:
    """The numbers of a word's set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda j: F.call_function("shiftrightunsigned", mask, j).bitwiseAND(F.lit(1)) == 1)


def tile_product(masks: Column, x: Column, weights: Column | None = None, side: int = SIDE) -> Column:
    """masks (64 words) times x (64 ``side`` numbers): as many numbers. ``weights``: 64 arrays of 64."""

    def row(mask: Column, r: Column) -> Column:
        w = (lambda c: F.get(F.get(weights, r), c)) if weights is not None else (lambda c: F.lit(1.0))

        def sums(cols: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.aggregate(cols, F.lit(0.0), lambda s, c: s + F.get(x, c * side + k) * w(c)))

        return F.transform(F.array(_set(mask)), sums)[0]

    return F.flatten(F.transform(masks, row))


def product(tiles: DataFrame, vector: DataFrame, side: int = SIDE) -> DataFrame:
    """bi, y: the product of a tiled matrix (bi, bj, masks) with a tiled vector (bj, x: array<double>). A row of tiles is
    summed element by element with partial sums, so no row is gathered."""
    full = tiles.where(F.exists("masks", lambda m: m != 0))
    each = full.join(vector, "bj").select("bi", F.posexplode(tile_product(F.col("masks"), F.col("x"), side=side)).alias("i", "v"))
    sums = each.groupBy("bi", "i").agg(F.sum("v").alias("v"))
    return sums.groupBy("bi").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("y"))  # a tile's height


def attend(masks: Column, query: Column, least: int) -> Column:
    """struct(best, distance, fires): the first row of a tile with most bits in common with the query, how many of 64 it
    lacks, and a word of the rows that have ``least`` or more."""
    scores = F.transform(masks, lambda m: F.bit_count(m.bitwiseAND(query)))

    def body(s: Column) -> Column:
        top = F.array_max(s)
        fired = F.transform(s, lambda v, i: F.when(v >= least, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.struct((F.array_position(s, top) - 1).cast("int").alias("best"), (ROWS - top).alias("distance"), F.aggregate(fired, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)).alias("fires"))

    return F.transform(F.array(scores), body)[0]


def active(masks: Column, row: Column, side: int = SIDE) -> Column:
    """The columns of a tile that a row's blocks cover, so that a search scores these alone."""
    cols = _set(F.get(masks, F.floor(row / side).cast("int")))
    return F.flatten(F.transform(cols, lambda c: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: c * side + k)))
