"""Truth values (frequency f, confidence c) from evidence, and rules that combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON = 1.0


def from_evidence(positive: Column, negative: Column, k: float = HORIZON) -> tuple[Column, Column]:
    """f = w+/w (0.5 without evidence), c = w/(w + k)."""
    w = positive + negative
    return F.when(w > 0, positive / w).otherwise(0.5), w / (w + k)


def to_evidence(f: Column, c: Column, k: float = HORIZON) -> tuple[Column, Column]:
    w = k * c / (1 - c)
    return w * f, w * (1 - f)


def expectation(f: Column, c: Column) -> Column:
    return c * (f - 0.5) + 0.5


def revise(frame: DataFrame, by: list[str], f: str, c: str, cap: float = 0.9999) -> DataFrame:
    """All truths of a group as one: evidence adds up, so this is a plain aggregate with partial sums."""
    w = F.least(F.col(c), F.lit(cap)) / (1 - F.least(F.col(c), F.lit(cap)))
    sums = frame.groupBy(*by).agg(F.sum(w * F.col(f)).alias("p"), F.sum(w * (1 - F.col(f))).alias("n"), F.count("*").alias("k"))
    rf, rc = from_evidence(F.col("p"), F.col("n"))
    return sums.select(*by, "k", rf.alias("f"), F.least(rc, F.lit(cap)).alias("c"))


def _w(c: Column) -> Column:
    return c / (c + 1)


def deduction(f1, c1, f2, c2):
    return f1 * f2, f1 * f2 * c1 * c2


def abduction(f1, c1, f2, c2):
    return f1, _w(f2 * c1 * c2)


def induction(f1, c1, f2, c2):
    return f2, _w(f1 * c1 * c2)


def comparison(f1, c1, f2, c2):
    either = f1 + f2 - f1 * f2
    return F.when(either > 1e-9, f1 * f2 / either).otherwise(0.0), _w(f1 * f2 * c1 * c2)


def analogy(f1, c1, f2, c2):
    return f1 * f2, c1 * c2 * f2


def resemblance(f1, c1, f2, c2):
    return f1 * f2, c1 * c2 * (f1 + f2 - f1 * f2)


RULES = {"deduction": deduction, "abduction": abduction, "induction": induction, "comparison": comparison, "analogy": analogy, "resemblance": resemblance}


def severity(f1, c1, f2, c2, gap: float = 0.5, confidence: float = 0.5) -> Column:
    """How severe a contradiction is: both confidences and the gap multiplied; null where there is none."""
    return F.when(contradicts(f1, c1, f2, c2, gap, confidence), c1 * c2 * F.abs(f1 - f2))


def revised(f1, c1, f2, c2, cap: float = 0.9999) -> tuple[Column, Column]:
    """Two truths as one: their evidence adds up."""
    w1, w2 = (F.least(c, F.lit(cap)) / (1 - F.least(c, F.lit(cap))) for c in (c1, c2))
    f, c = from_evidence(w1 * f1 + w2 * f2, w1 * (1 - f1) + w2 * (1 - f2))
    return f, F.least(c, F.lit(cap))


def conflict(f1, c1, f2, c2, similarity, threshold: float) -> Column:
    """What beliefs of similar structure (over 0.7) and opposing truth resolve to: struct(conflict, f, c), else null."""
    gap = F.abs(f1 - f2)
    f, c = revised(f1, c1, f2, c2)
    return F.when((similarity > 0.7) & (gap > threshold), F.struct(gap.alias("conflict"), f.alias("f"), c.alias("c")))


def critique(f: Column, c: Column) -> Column:
    """Two challenges of a truth: its negation, a tenth less confident, and half of its confidence; whether it survives."""
    negated = expectation(1 - f, c * 0.9)
    return F.array(
        F.struct(F.lit("negation").alias("kind"), (1 - f).alias("f"), (c * 0.9).alias("c"), (expectation(f, c) > negated).alias("survives")),
        F.struct(F.lit("dependency").alias("kind"), f.alias("f"), (c * 0.5).alias("c"), (c > 0.5).alias("survives")),
    )


def best_belief(frame: DataFrame, by: list[str], label: str, f: str, c: str) -> DataFrame:
    """The belief of greatest expectation per group; the first label on ties."""
    best = F.min(F.struct((-expectation(F.col(f), F.col(c))).alias("m"), F.col(label), F.col(f), F.col(c)))
    return frame.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{label}", f"b.{f}", f"b.{c}")


def budget_merge(frame: DataFrame, by: list[str]) -> DataFrame:
    """Budgets of a group: the greatest priority, the mean durability, the greatest quality."""
    return frame.groupBy(*by).agg(F.max("priority").alias("priority"), F.avg("durability").alias("durability"), F.max("quality").alias("quality"))


def budget_decay(frame: DataFrame, factor: Column) -> DataFrame:
    """Priority and durability shrink; quality stays."""
    return frame.withColumn("priority", F.col("priority") * factor).withColumn("durability", F.col("durability") * factor)


#: Fixed-point truths: 16 bits, and what stands for not knowing.
UNIT, UNKNOWN = 65535, 32768


def plane_truth(bits: Column, mask: Column, width: Column | int, evidence: Column) -> Column:
    """struct(f, c, evidence) in fixed point: set bits of the known ones, and known ones of all."""
    known = F.bit_count(mask).cast("bigint")
    f = F.when(known == 0, UNKNOWN).otherwise(F.floor(F.bit_count(bits.bitwiseAND(mask)) * UNIT / known))
    return F.struct(f.cast("bigint").alias("f"), F.floor(known * UNIT / width).cast("bigint").alias("c"), evidence.cast("bigint").alias("evidence"))


def plane_expectation(f: Column, c: Column) -> Column:
    """Fixed-point expectation; the product is cut towards zero."""
    weighted = c * (f - UNKNOWN) / UNIT
    cut = F.when(weighted < 0, F.ceil(weighted)).otherwise(F.floor(weighted))
    return F.greatest(F.lit(0), F.least(F.lit(UNIT), cut + UNKNOWN)).cast("bigint")


def evidence_revision(frame: DataFrame, by: list[str], f: str = "f", c: str = "c", evidence: str = "evidence") -> DataFrame:
    """Fixed-point truths of a group weighted by their evidence: sums, so the order doesn't matter and no history is
    gathered; without evidence a group is unknown."""
    sums = frame.groupBy(*by).agg(*[F.sum(F.col(x) * F.col(evidence)).alias(x) for x in (f, c)], F.sum(evidence).alias(evidence))
    share = lambda x, none: F.when(F.col(evidence) > 0, F.floor(F.col(x) / F.col(evidence))).otherwise(none).cast("bigint").alias(x)
    return sums.select(*by, share(f, UNKNOWN), share(c, 0), F.col(evidence).cast("bigint").alias(evidence))


def contradicts(f1, c1, f2, c2, gap: float = 0.5, confidence: float = 0.5) -> Column:
    """Both confident and far apart."""
    return (c1 > confidence) & (c2 > confidence) & (F.abs(f1 - f2) > gap)


def fold_revision(frame: DataFrame, by: list[str], order: str, f: str, c: str) -> DataFrame:
    """Integer revision (f1 + f2) div 2 in order: rounding makes the order matter, so a group's pairs are folded after
    sorting; groups are as long as their histories, which the caller bounds."""
    pairs = F.array_sort(F.collect_list(F.struct(order, f, c)))
    fold = F.aggregate(
        F.slice(F.col("h"), 2, 2_000_000_000),
        F.struct(F.get("h", 0)[f].cast("bigint").alias("f"), F.get("h", 0)[c].cast("bigint").alias("c")),
        lambda a, x: F.struct(F.floor((a["f"] + x[f]) / 2).cast("bigint").alias("f"), F.floor((a["c"] + x[c]) / 2).cast("bigint").alias("c")),
    )
    return frame.groupBy(*by).agg(pairs.alias("h")).select(*by, fold.alias("r")).select(*by, "r.f", "r.c")
