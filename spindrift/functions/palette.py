"""Vectors as 17 whole numbers, palettes of such codes, and tables of distances between palette entries."""

from __future__ import annotations

import numpy as np
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: length, the step in which its elements follow the vector's, and the scale.
DIMENSIONS, STEP, SCALE = 17, 11, 256
#: The largest possible L1 distance, to which tables are scaled, and a table's largest entry.
WIDEST, TOP = 17 * 65535, 65535


def project(v: Column) -> Column:
    """Element b is the mean of the vector's elements at b * STEP mod 17 and every 17th on, scaled and rounded half away
    from zero, within 16 bits; 0 where the vector has none."""

    def one(b: Column) -> Column:
        start, last = b * STEP % DIMENSIONS, F.size(v) - 1
        places = F.sequence(start, last, F.lit(DIMENSIONS))
        mean = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(v, i)) / (F.floor((last - start) / DIMENSIONS) + 1)
        return F.when(start <= last, F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.round(mean * SCALE)))).otherwise(0.0).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), one)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("bigint")))


def l1_weighted(a: Column, b: Column) -> Column:
    """Element 0 counts 20 times, elements 1 to 6 three times."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("bigint"))
    return _sum(F.transform(gaps, lambda g, i: g * F.when(i == 0, 20).when(i < 7, 3).otherwise(1)))


def sign_agreement(a: Column, b: Column) -> Column:
    """Elements of one sign; 0 counts as positive."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when((x >= 0) == (y >= 0), 1).otherwise(0).cast("bigint")))


def triangle_holds(a: Column, b: Column, c: Column) -> Column:
    return l1(a, c) <= l1(a, b) + l1(b, c)


def build_palette(codes: DataFrame, code: str, k: int, rounds: int = 3, sample_rows: int = 4096) -> list[list[int]]:
    """A palette of up to ``k`` (256 at most) entries: k-means by L1 from farthest-first seeds, means cut to whole numbers,
    fitted on a sample of ``sample_rows`` rows (least hashes), so what reaches the driver is bounded."""
    rows = codes.where(F.col(code).isNotNull()).select(code).orderBy(F.xxhash64(code), code).limit(sample_rows).collect()
    if not rows:
        return []
    x = np.asarray([r[0] for r in rows], np.int64)
    k, chosen = min(k, 256, len(x)), [0]
    gap = np.abs(x - x[0]).sum(1)
    while len(chosen) < k:
        chosen.append(int(gap.argmax()) if gap.max() > 0 else 0)
        gap = np.minimum(gap, np.abs(x - x[chosen[-1]]).sum(1))
    entries = x[chosen].copy()
    for _ in range(rounds):
        near = np.stack([np.abs(x - e).sum(1) for e in entries]).argmin(0)
        means = np.asarray([np.trunc(x[near == j].sum(0) / max(1, (near == j).sum())) if (near == j).any() else entries[j] for j in range(k)], np.int64)
        if (means == entries).all():
            break
        entries = means
    return entries.tolist()


def _literal(entries: ArrayLike) -> Column:
    return F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in entries])


def nearest(code: Column, palette: list[list[int]]) -> Column:
    """Index of the entry of least L1 distance, the first on ties. A palette has 256 entries at most, so it is a literal."""
    ds = F.transform(_literal(palette), lambda e, i: F.struct(l1(code, e).alias("d"), i.alias("i")))
    return F.array_min(ds)["i"]


def distance_table(palette: list[list[int]]) -> list[list[int]]:
    """All distances between entries, scaled to 16 bits and cut."""
    x = np.asarray(palette, np.int64)
    d = np.abs(x[:, None] - x[None]).sum(2)
    return np.minimum(d * TOP // WIDEST, TOP).tolist()


def table_distance(table: list[list[int]], a: Column, b: Column) -> Column:
    return F.get(F.get(_literal(table), a), b).cast("bigint")


def spo_distance(tables: list[list[list[int]]], a: list[Column], b: list[Column]) -> Column:
    """Sum of the three planes' table distances of two edges given as palette indices."""
    parts = [table_distance(t, x, y) for t, x, y in zip(tables, a, b)]
    return parts[0] + parts[1] + parts[2]
