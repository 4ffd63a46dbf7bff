"""Search cascades on prints of many words: a probe of one word, of eight, then the whole; packed strokes; quantised codes.

Every stage is a filter on a column that Spark computes only for rows that passed the stage before."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.vectors import hamming_words
from spindrift.operators.search import band, top_k


@dataclass(frozen=True)
class SliceGate:
    """Whole-number thresholds from shares of a print's bits."""

    bits: int
    hot: float = 0.10
    mid: float = 0.30
    cold: float = 0.49
    anti: float = 0.90
    margin: float = 1.5

    def reject(self, probe_bits: int) -> int:
        """Conflicts of the first ``probe_bits`` bits above which a row goes."""
        return math.ceil(self.cold * self.bits * (probe_bits / self.bits) * self.margin)

    def below(self, share: float) -> int:
        return math.floor(share * self.bits)


@dataclass(frozen=True)
class SigmaGate:
    """Distances by standard deviations below the noise of random prints, half of the bits."""

    mu: int
    sigma: int
    discovery: int
    strong: int
    evidence: int
    hint: int

    @classmethod
    def of_bits(cls, bits: int) -> SigmaGate:
        mu, sigma = bits // 2, math.sqrt(bits / 4)
        return cls(mu, int(sigma), *[max(0, mu - int(k * sigma)) for k in (3.0, 2.5, 2.0, 1.5)])

    @classmethod
    def custom(cls, mu: int, sigma: int) -> SigmaGate:
        return cls(mu, sigma, *[max(0, mu - x) for x in (3 * sigma, 5 * sigma // 2, 2 * sigma, 3 * sigma // 2)])

    def level(self, d: Column) -> Column:
        return F.when(d < self.discovery, "Discovery").when(d < self.strong, "Strong").when(d < self.evidence, "Evidence").when(d < self.hint, "Hint").otherwise("Noise")

    def z(self, d: Column) -> Column:
        return (self.mu - d) / F.lit(float(self.sigma)) if self.sigma else F.lit(0.0)

    def p_value(self, d: Column) -> Column:
        """One-tailed, in steps."""
        steps = ((5.0, 3e-7), (4.0, 3e-5), (3.0, 0.0013), (2.5, 0.0062), (2.0, 0.023), (1.5, 0.067), (1.0, 0.159), (0.0, 0.5))
        out = F.when(self.z(d) >= steps[0][0], steps[0][1])
        for z, p in steps[1:]:
            out = out.when(self.z(d) >= z, p)
        return out.otherwise(1.0)


def _first_words(words: Column, n: int) -> Column:
    return F.slice(words, 1, n)


def word_conflicts(a: Column, b: Column) -> Column:
    """Differing bits per word."""
    return F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def _popcount(words: Column) -> Column:
    return F.aggregate(F.transform(words, lambda w: F.bit_count(w).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def energies(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """conflict, energy_a, energy_b, agreement of two prints."""
    x, y = F.col(a), F.col(b)
    both = F.zip_with(x, y, lambda p, q: p.bitwiseAND(q))
    return pairs.withColumns({"conflict": hamming_words(x, y), "energy_a": _popcount(x), "energy_b": _popcount(y), "agreement": _popcount(both)})


def stages(pairs: DataFrame, a: str, b: str, gate: SliceGate) -> DataFrame:
    """Pairs with ``stage``: where each one ends. K0 and K1 reject by the first word and the first eight, K2 sees the rest."""
    x, y = F.col(a), F.col(b)
    k0 = hamming_words(_first_words(x, 1), _first_words(y, 1)) <= gate.reject(64)
    k1 = hamming_words(_first_words(x, 8), _first_words(y, 8)) <= gate.reject(512)
    return pairs.withColumn("stage", F.when(~k0, "k0").when(~k1, "k1").otherwise("k2"))


def kernel_pipeline(pairs: DataFrame, a: str, b: str, gate: SliceGate) -> DataFrame:
    """The matches: pairs that pass K0 and K1 and have a grade, with energies, grade and significance.

    Grades add 3, 2 and 1 for conflicts below the hot, mid and cold threshold."""
    out = energies(stages(pairs, a, b, gate).where("stage = 'k2'").drop("stage"), a, b)
    d = F.col("conflict")
    grade = sum((F.when(d < gate.below(s), n).otherwise(0) for s, n in ((gate.mid, 2), (gate.cold, 1))), F.when(d < gate.below(gate.hot), 3).otherwise(0))
    sigma = SigmaGate.of_bits(gate.bits)
    return out.withColumns({"grade": grade, "z": sigma.z(d), "level": sigma.level(d), "p_value": sigma.p_value(d)}).where("grade > 0")


def pipeline_stats(pairs: DataFrame, a: str, b: str, gate: SliceGate) -> DataFrame:
    """One row: how many pairs each stage rejected, promoted and matched, and how many are opposites."""
    staged = energies(stages(pairs, a, b, gate), a, b)
    d, k2 = F.col("conflict"), F.col("stage") == "k2"
    return staged.agg(
        F.count("*").alias("total"), F.count_if(F.col("stage") == "k0").alias("k0_rejected"), F.count_if(F.col("stage") == "k1").alias("k1_rejected"), F.count_if(k2).alias("k2_promoted"),
        F.count_if(k2 & (d < gate.below(max(gate.hot, gate.mid, gate.cold)))).alias("matches"), F.count_if(k2 & (d > math.ceil(gate.anti * gate.bits))).alias("opposites"),
    )


def pack_strokes(prints: DataFrame, words: str, first: int, second: int) -> DataFrame:
    """Prints as three columns s1, s2, s3 of words, so that a columnar file lets a search read the first alone."""
    w = F.col(words)
    rest = F.slice(w, first + second + 1, F.greatest(F.size(w) - first - second, F.lit(0)))
    return prints.withColumns({"s1": F.slice(w, 1, first), "s2": F.slice(w, first + 1, second), "s3": rest}).drop(words)


def _query_strokes(query: list[int], first: int, second: int) -> list[Column]:
    parts = query[:first], query[first : first + second], query[first + second :]
    return [F.array(*[F.lit(x).cast("bigint") for x in p]) if p else F.array().cast("array<bigint>") for p in parts]


def packed_search(packed: DataFrame, query: list[int], first: int, second: int, reject_first: int, reject_both: int, k: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows whose first stroke, and first two strokes together, are within explicit thresholds."""
    q1, q2, q3 = _query_strokes(query, first, second)
    one = packed.withColumn("_d", hamming_words(F.col("s1"), q1)).where(F.col("_d") <= reject_first)
    two = one.withColumn("_d", F.col("_d") + hamming_words(F.col("s2"), q2)).where(F.col("_d") <= reject_both)
    return top_k(two.select(key, (F.col("_d") + hamming_words(F.col("s3"), q3)).alias("d")), "d", key, k)


def estimated_search(packed: DataFrame, query: list[int], first: int, second: int, threshold: int, k: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows within a threshold by strokes scaled to the whole print: a quarter above the threshold passes
    the first stroke, the threshold itself the second. Rows can be lost where a print's start is unlike its rest."""
    q1, q2, q3 = _query_strokes(query, first, second)
    whole = len(query)
    one = packed.withColumn("_d", hamming_words(F.col("s1"), q1)).where(F.floor(F.col("_d") * (whole / first)) <= threshold + threshold // 4)
    two = one.withColumn("_d", F.col("_d") + hamming_words(F.col("s2"), q2)).where(F.floor(F.col("_d") * float(whole) / (first + second)) <= threshold)
    full = two.select(key, (F.col("_d") + hamming_words(F.col("s3"), q3)).alias("d")).where(F.col("d") <= threshold)
    return top_k(full.withColumn("band", band(F.col("d"), threshold)), "d", key, k)


def code_cascade(pairs: DataFrame, tables: str, codes: str, parts: int, heel: float, branch: float) -> DataFrame:
    """Quantised codes in three strokes: the first part's distance below ``heel``, the first two parts' below ``branch``,
    then all parts: column ``d``."""
    at = lambda p: F.get(F.get(F.col(tables), p), F.get(F.col(codes), p))
    kept = pairs.where(at(0) < heel).where(at(0) + at(1) < branch)
    return kept.withColumn("d", sum((at(p) for p in range(1, parts)), at(0)))


def channel_sweep(pairs: DataFrame, channels: list[tuple[str, str, int]]) -> DataFrame:
    """Pairs whose channels (columns of words, threshold) are all within their thresholds, one filter after the other."""
    for i, (a, b, most) in enumerate(channels):
        pairs = pairs.withColumn(f"d{i}", hamming_words(F.col(a), F.col(b))).where(F.col(f"d{i}") <= most)
    return pairs


def adaptive_band(entropy: Column, variation: Column) -> Column:
    """The band to search in, by a query's entropy and a corpus's coefficient of variation."""
    return F.when(entropy < 0.2, "Foveal").when((entropy < 0.5) & (variation < 0.3), "Near").when(variation < 0.5, "Good").otherwise("Weak")


def sigma_class(d: Column, thresholds: tuple[int, int, int]) -> Column:
    return F.when(d <= thresholds[0], "exact").when(d <= thresholds[1], "near").when(d <= thresholds[2], "far").otherwise("noise")


def band_class(d: Column, threshold: int) -> Column:
    """Bands in three words."""
    b = band(d, threshold)
    return F.when(b == "Foveal", "exact").when(b == "Near", "near").when(b == "Reject", "noise").otherwise("far")
