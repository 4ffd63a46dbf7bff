"""Subject-predicate-object data: edge codes, plane distances, survivor classes, differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE, FULL = 8192, 16384


def edge_code(ds: Column, dp: Column, do: Column) -> Column:
    """Eight bytes: byte 0 tells which of S, P, O, SP, SO, PO, SPO are close (below CLOSE); bytes 1 to 7 are the largest
    distances of SPO, PO, SO, SP, O, P, S scaled to 255."""
    close = [d < CLOSE for d in (ds, dp, do)]
    s, p, o = close
    flags = [s, p, o, s & p, s & o, p & o, s & p & o]
    code = F.lit(0).cast("bigint")
    for i, flag in enumerate(flags):
        code = code.bitwiseOR(F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    values = [F.greatest(ds, dp, do), F.greatest(dp, do), F.greatest(ds, do), F.greatest(ds, dp), do, dp, ds]
    for i, v in enumerate(values, 1):
        byte = F.least(F.lit(255), F.floor(v * 255 / FULL)).cast("bigint")
        code = code.bitwiseOR(F.call_function("shiftleft", byte, F.lit(8 * i)))
    return code


def byte_of(code: Column, n: int) -> Column:
    return F.shiftrightunsigned(code, 8 * n).bitwiseAND(F.lit(255))


def code_distance(a: Column, b: Column, upto: int = 7) -> Column:
    """L1 over bytes 0 to ``upto``."""
    return sum((F.abs(byte_of(a, i) - byte_of(b, i)) for i in range(1, upto + 1)), F.abs(byte_of(a, 0) - byte_of(b, 0)))


def plane_distance(a_bits: Column, a_mask: Column, b_bits: Column, b_mask: Column) -> Column:
    """disagreement and overlap where both are known, penalty where the first is not: the order of arguments matters. Null
    where nothing is known to both: planes without overlap can't be compared."""
    bits = lambda c: F.bit_count(c).cast("bigint")
    both = a_mask.bitwiseAND(b_mask)
    return F.when(bits(both) > 0, F.struct(bits(a_bits.bitwiseXOR(b_bits).bitwiseAND(both)).alias("disagreement"), bits(both).alias("overlap"), bits(F.bitwise_not(a_mask)).alias("penalty")))


def normalized(distance: Column) -> Column:
    """(disagreement + penalty) / (overlap + penalty); null for incomparable planes."""
    return (distance["disagreement"] + distance["penalty"]) / (distance["overlap"] + distance["penalty"])


def node_distance(planes: list[Column]) -> Column:
    """Sums of the planes' distances, incomparable ones left out; null if all are incomparable."""
    names = ("disagreement", "overlap", "penalty")
    some = F.coalesce(*[p["overlap"] for p in planes])
    return F.when(some.isNotNull(), F.struct(*[sum((F.coalesce(p[n], F.lit(0)) for p in planes[1:]), F.coalesce(planes[0][n], F.lit(0))).alias(n) for n in names]))


def project_all(s: Column, p: Column, o: Column) -> Column:
    """Distances of the seven choices of planes: S, P, O, SP, SO, PO, SPO."""
    return F.array(*[node_distance(list(x)) for x in ((s,), (p,), (o,), (s, p), (s, o), (p, o), (s, p, o))])


def is_legal_scent(byte0: Column) -> Column:
    """Whether pairs of planes are close only where both planes are, and all three only where all pairs are."""
    bit = lambda i: F.shiftright(byte0, i).bitwiseAND(F.lit(1)) == 1
    s, p, o, sp, so, po, spo = (bit(i) for i in range(7))
    return (~sp | (s & p)) & (~so | (s & o)) & (~po | (p & o)) & (~spo | (sp & so & po))


def with_sign(code: Column, sign: Column) -> Column:
    """Sets or clears the direction, bit 7 of byte 0."""
    return F.when(sign, code.bitwiseOR(F.lit(128).cast("bigint"))).otherwise(code.bitwiseAND(F.lit(~128).cast("bigint")))


def scent_hamming(a: Column, b: Column) -> Column:
    return F.bit_count(byte_of(a, 0).bitwiseXOR(byte_of(b, 0))).cast("bigint")


#: Widths of a packed weight edge's fields, the highest first.
WEIGHT_EDGE = (("block", 6), ("projection", 4), ("verb", 2), ("row", 16), ("l1", 16), ("f", 10), ("c", 10))


def pack_weight_edge(fields: dict[str, Column]) -> Column:
    """One word of a weight edge; l1 is cut to 16 bits' most, f and c (0 to 1) become tenths of a percent and the like."""
    fields = fields | {"l1": F.least(fields["l1"], F.lit(65535))} | {n: F.round(fields[n] * 1023) for n in ("f", "c")}
    word, at = F.lit(0).cast("bigint"), 64
    for name, width in WEIGHT_EDGE:
        at -= width
        word = word.bitwiseOR(F.call_function("shiftleft", fields[name].cast("bigint").bitwiseAND(F.lit((1 << width) - 1)), F.lit(at)))
    return word


def unpack_weight_edge(word: Column) -> dict[str, Column]:
    out, at = {}, 64
    for name, width in WEIGHT_EDGE:
        at -= width
        value = F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << width) - 1))
        out[name] = value / 1023 if name in ("f", "c") else value
    return out


def plane_class(s: Column, p: Column, o: Column) -> Column:
    """Which of the eight survivor classes a row is in."""
    name = F.concat(F.when(s, "S").otherwise(""), F.when(p, "P").otherwise(""), F.when(o, "O").otherwise(""))
    return F.when(name == "", "none").otherwise(name)


def snapshot_diff(a: DataFrame, b: DataFrame, on: list[str], distance: Column, threshold: float) -> DataFrame:
    """Rows of both snapshots that moved by more than ``threshold``; columns of the second are prefixed ``b_``."""
    right = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on])
    return a.join(right, on).withColumn("l1", distance).where(F.col("l1") > threshold)


def unmatched(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")
