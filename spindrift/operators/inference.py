"""Composition of partial bindings to a fixpoint, inference of an open slot, and precedence between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import blockwise
from spindrift.operators.lineage import kept
from spindrift.operators.search import top_k_per

LEVELS = ("Noise", "Free", "Pair", "Core")


def level(mask: Column) -> Column:
    """The lattice level of a set of three planes."""
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.bit_count(mask) + 1)


def compose(facts: DataFrame, planes: int = 3, limit: int | None = None) -> DataFrame:
    """a, b, mask (a set of planes, as bits), cost: all that compositions of the facts (a, b, mask, cost) give, the facts
    included, each with its least cost.

    A fact from a to b and one from b to c compose to one from a to c where their planes differ, with the planes and the
    costs of both; those beyond ``limit`` are dropped. Each round joins the facts that the last round added or made cheaper
    with all facts, on the node between them, and rounds end when none is left: masks grow, so after ``planes`` rounds at
    most. Nodes with many facts are split by Spark's skew handling, as both sides come from plain exchanges."""
    best = lambda f: f.groupBy("a", "b", "mask").agg(F.min("cost").alias("cost"))
    known = kept(best(facts.select("a", "b", F.col("mask").cast("int").alias("mask"), F.col("cost").cast("bigint").alias("cost"))))
    fresh = known
    for _ in range(planes):
        left = fresh.select("a", F.col("b").alias("via"), F.col("mask").alias("m1"), F.col("cost").alias("c1"))
        right = known.select(F.col("a").alias("via"), "b", F.col("mask").alias("m2"), F.col("cost").alias("c2"))
        one = left.join(right, "via")
        left = known.select("a", F.col("b").alias("via"), F.col("mask").alias("m1"), F.col("cost").alias("c1"))
        right = fresh.select(F.col("a").alias("via"), "b", F.col("mask").alias("m2"), F.col("cost").alias("c2"))
        both = one.unionByName(left.join(right, "via")).where(F.col("m1").bitwiseAND(F.col("m2")) == 0)
        made = both.select("a", "b", F.col("m1").bitwiseOR(F.col("m2")).alias("mask"), (F.col("c1") + F.col("c2")).alias("cost"))
        made = best(made if limit is None else made.where(F.col("cost") <= limit))
        before = known.withColumnRenamed("cost", "had")
        fresh = kept(made.join(before, ["a", "b", "mask"], "left").where(F.col("had").isNull() | (F.col("cost") < F.col("had"))).drop("had"))
        if fresh.isEmpty():
            break
        known = kept(best(known.unionByName(fresh)))
    return known


def infer(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """query_id, mode, entry, d: the codebook entry (entry, fp) in which the fewest bits differ from what unbinding gives; the
    smaller entry on ties.

    ``queries``: query_id, mode and the prints that the mode needs: Forward takes ``po`` and ``p`` (what is the object?),
    Backward ``sp`` and ``p`` (the subject?), Abduction ``sp`` and ``s`` (the predicate?). A binding is an exclusive or, so
    the bound print and the known one give the third. Queries without the prints that they need have no row. Estimates meet
    the codebook block by block, and a task hands on one entry for each."""
    bound, known = F.when(F.col("mode") == "Forward", F.col("po")).otherwise(F.col("sp")), F.when(F.col("mode") == "Abduction", F.col("s")).otherwise(F.col("p"))
    estimate = queries.select("query_id", "mode", bound.bitwiseXOR(known).alias("estimate")).where("estimate is not null")
    asked = kept(estimate.withColumn("number", F.monotonically_increasing_id()))
    prints = codebook.select("entry", F.array("fp").alias("words"))
    found = blockwise.nearest_prints(prints, asked.select(F.col("number").alias("query_id"), F.array("estimate").alias("q")), "entry", "words", 1)
    best = top_k_per(found.withColumnRenamed("query_id", "number"), "number", "cost", "entry", 1)
    return best.join(asked, "number").select("query_id", "mode", "entry", F.col("cost").alias("d"))


def _turned(word: Column, shift: Column) -> Column:
    return F.call_function("shiftleft", word, shift).bitwiseOR(F.call_function("shiftrightunsigned", word, 64 - shift))


def edge(source: Column, shift: Column | int, target: Column) -> Column:
    """A directed edge as a word: the source, and the target turned by the verb's number of bits, 1 to 63."""
    return source.bitwiseXOR(_turned(target, shift if isinstance(shift, Column) else F.lit(shift)))


def asymmetry(source: Column, shift: Column | int, target: Column) -> Column:
    """Which share of the bits the edge and its reverse differ in: 0 for an edge that has no direction."""
    return F.bit_count(edge(source, shift, target).bitwiseXOR(edge(target, shift, source))) / 64


def non_causal(edges: DataFrame, threshold: float, shift: str = "shift") -> DataFrame:
    """Edges (source, ``shift``, target, ..) whose asymmetry is below the threshold, with it."""
    return edges.withColumn("asymmetry", asymmetry(F.col("source"), F.col(shift), F.col("target"))).where(F.col("asymmetry") < threshold)


def asof(events: DataFrame, marks: DataFrame, by: list[str], order: list[str], take: list[str]) -> DataFrame:
    """``events`` with the columns ``take`` of the last of ``marks`` that isn't later, within ``by``: an as-of join.

    ``order`` (columns of both) tells what is later; of equal ones the mark counts as earlier. Both tables go through one
    sort per ``by``, and the last mark is carried on: no pairs are made, whatever the number of marks."""
    side = F.struct(*[F.col(c) for c in take])
    both = events.withColumn("_mark", F.lit(None).cast(marks.select(side.alias("x")).schema["x"].dataType)).withColumn("_turn", F.lit(1))
    others = [F.col(c) if c in (*by, *order) else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns]
    both = both.unionByName(marks.select(*others, side.alias("_mark"), F.lit(0).alias("_turn")))
    w = Window.partitionBy(*by).orderBy(*order, "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(w)).where("_turn = 1")
    return last.select(*events.columns, *[F.col(f"_mark.{c}").alias(c) for c in take])


def recency(event_s: Column, reference_s: Column, scale_s: float = 3600.0) -> Column:
    """How near in time: 1 at the reference, falling by e per ``scale_s`` seconds."""
    return F.exp(-F.abs(event_s - reference_s) / scale_s)


def temporal_similarity(a: Column, recency_a: Column, b: Column, recency_b: Column, distance) -> Column:
    """struct(distance, weight): how far two codes are, and the geometric mean of their recencies."""
    return F.struct(distance(a, b).alias("distance"), F.sqrt(recency_a * recency_b).alias("weight"))
