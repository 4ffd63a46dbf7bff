"""Binary nets and synapse registers: scores by matching bits, layered searches, states and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.vectors import hamming_words
from spindrift.operators.kernels import SliceGate, kernel_pipeline
from spindrift.operators.search import Mask, top_k_per

#: Names of the five states, the strong ones outermost.
STATES = ("StrongNeg", "WeakNeg", "Silent", "WeakPos", "StrongPos")


def binary_score(conflicts: Column, bits: int) -> Column:
    """1 where all bits match, -1 where none does."""
    return 2 * (bits - conflicts) / bits - 1


def channel_score(pairs: list[tuple[Column, Column]], bits: int) -> Column:
    """The score of several channels (columns of words of ``bits`` bits) as one."""
    conflicts = sum((hamming_words(a, b) for a, b in pairs), F.lit(0))
    return binary_score(conflicts, bits * len(pairs))


def cascade_search(pairs: DataFrame, words: str, query: str, gate: SliceGate, bits: int, k: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` best matches per query_id of those that pass the gate's probes; rows that a probe rejects are never
    compared in full."""
    hits = kernel_pipeline(pairs, words, query, gate).select("query_id", key, "conflict", binary_score(F.col("conflict"), bits).alias("score"))
    return top_k_per(hits, "query_id", "conflict", key, k)


def threshold_search(pairs: DataFrame, words: str, query: str, first: int, threshold: int, bits: int, k: int, key: str = "vec_id") -> DataFrame:
    """The ``k`` best matches per query_id within ``threshold`` bits. The conflicts of the first ``first`` words alone rule
    pairs out: exact, unlike a scaled estimate."""
    start = pairs.withColumn("_s", hamming_words(F.slice(words, 1, first), F.slice(query, 1, first))).where(F.col("_s") <= threshold)
    rest = hamming_words(F.slice(words, first + 1, 1 << 20), F.slice(query, first + 1, 1 << 20))
    full = start.withColumn("conflict", F.col("_s") + rest).where(F.col("conflict") <= threshold)
    return top_k_per(full.select("query_id", key, "conflict", binary_score(F.col("conflict"), bits).alias("score")), "query_id", "conflict", key, k)


def work_search(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Pairs of byte arrays whose summed differences are at most ``most``: ``d``. A sixteenth and then a quarter of the
    places are summed first; what they sum to is part of the whole, so that nothing is lost."""
    part = lambda step: F.aggregate(F.zip_with(F.filter(a, lambda _, i: i % step == 0), F.filter(b, lambda _, i: i % step == 0), lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pairs.where(part(16) <= most).where(part(4) <= most).withColumn("d", part(1)).where(F.col("d") <= most)


def section_bitmaps(states: DataFrame, by: list[str], position: str, state: str, mask: Mask) -> DataFrame:
    """by, word (number), bits, n: which of each 64 states pass a mask, as one word; bits of positions without a state are
    clear."""
    place = F.pmod(F.col(position), F.lit(64)).cast("int")
    bit = F.when(mask.test(F.col(state)), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint"))
    words = states.groupBy(*by, F.floor(F.col(position) / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.withColumn("n", F.bit_count("bits").cast("bigint"))


def synapse_state(efficacy: Column, theta: Column, maturity: Column, ripe: int = 8) -> Column:
    """Silent up to half of theta, strong above theta where ripe, weak else."""
    size = F.abs(efficacy)
    strong = (size > theta) & (maturity >= ripe)
    side = F.when(efficacy > 0, F.when(strong, "StrongPos").otherwise("WeakPos")).otherwise(F.when(strong, "StrongNeg").otherwise("WeakNeg"))
    return F.when(size <= F.floor(theta / 2), "Silent").otherwise(side)


def synapse_stats(synapses: DataFrame, by: list[str], threshold: int) -> DataFrame:
    """by, n, mean_efficacy (of magnitudes), saturated (share beyond the threshold), and a column for each state."""
    state = synapse_state(F.col("efficacy"), F.col("theta"), F.col("maturity"))
    counts = [F.count_if(state == s).alias(s) for s in STATES]
    return synapses.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("efficacy")).alias("mean_efficacy"), F.avg((F.abs("efficacy") > threshold).cast("int")).alias("saturated"), *counts)


def level_fractions(classes: DataFrame, name: str = "class", n: str = "n") -> DataFrame:
    """level, share: classes named by their planes' letters (S, P, O), by how many they have; all four levels have a row."""
    size = F.when(F.col(name) == "none", 0).otherwise(F.length(name))
    counts = classes.groupBy(size.alias("i")).agg(F.sum(n).alias("n"))
    levels = classes.sparkSession.createDataFrame([(0, "noise"), (1, "free"), (2, "pair"), (3, "core")], "i int, level string")  # four rows
    total = classes.agg(F.sum(n).alias("total"))
    joined = levels.join(counts, "i", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("level", (F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))).alias("share"))
