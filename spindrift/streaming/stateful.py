"""Keyed streams with several state variables and timers, and their batch twins as window functions.

Each processor runs with ``transformWithStateInPandas`` (RocksDB state store); a key's rows of one trigger are put in order
before they meet the state, whose size doesn't grow with the stream. The twins give the same rows from a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Confidences end here.
CAP = 0.9999


def _in_order(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """A key's rows of one trigger by time and number."""
    rows = pd.concat(list(frames))
    return list(rows.sort_values(["ts", "seq"]).itertuples(index=False))


def _run(stream: DataFrame, processor: StatefulProcessor, out: str, timed: bool = False, late: str | None = None) -> DataFrame:
    if timed and stream.isStreaming:
        stream = stream.withWatermark("ts", late)
    return stream.groupBy("key").transformWithStateInPandas(processor, out, "append" if timed else "update", "EventTime" if timed else "None")


def action(f: Column, c: Column) -> Column:
    """What to do with a head of this truth: reinforce or suppress it where it is sure, explore it otherwise."""
    return F.when(c <= 0.7, "Explore").when(f > 0.6, "Reinforce").when(f < 0.3, "Suppress").otherwise("Explore")


def _action(f: float, c: float) -> str:
    return "Explore" if c <= 0.7 else "Reinforce" if f > 0.6 else "Suppress" if f < 0.3 else "Explore"


class Beliefs(StatefulProcessor):
    """Feedback (value: how much a key's head helped, 0 to 1) revises the key's truth; evidence adds up."""

    OUT = "key string, seq bigint, rounds bigint, f double, c double, action string"

    def __init__(self, prior_f: float = 0.5, prior_c: float = 0.5, confidence: float = 0.8):
        weight = prior_c / (1 - prior_c)
        self.start, self.weight = (weight * prior_f, weight * (1 - prior_f)), confidence / (1 - confidence)

    def init(self, handle) -> None:
        self.evidence = handle.getValueState("evidence", "positive double, negative double")
        self.rounds = handle.getValueState("rounds", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        (p, n), done, out = self.evidence.get() if self.evidence.exists() else self.start, self.rounds.get()[0] if self.rounds.exists() else 0, []
        for r in _in_order(rows):
            p, n, done = p + self.weight * r.value, n + self.weight * (1 - r.value), done + 1
            f, c = p / (p + n), min((p + n) / (p + n + 1), CAP)
            out.append((key[0], r.seq, done, f, c, _action(f, c)))
        self.evidence.update((p, n))
        self.rounds.update((done,))
        yield pd.DataFrame(out, columns=["key", "seq", "rounds", "f", "c", "action"])

    def close(self) -> None:
        pass


def update_beliefs(stream: DataFrame, **prior: float) -> DataFrame:
    """Columns key, ts, seq, value of a stream (or a table)."""
    return _run(stream.select("key", "ts", "seq", "value"), Beliefs(**prior), Beliefs.OUT)


def _past(*order: str):
    return Window.partitionBy("key").orderBy("ts", "seq", *order)


def beliefs_twin(rows: DataFrame, prior_f: float = 0.5, prior_c: float = 0.5, confidence: float = 0.8) -> DataFrame:
    start, weight = prior_c / (1 - prior_c), confidence / (1 - confidence)
    run = _past().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.lit(start * prior_f) + weight * F.sum("value").over(run)
    n = F.lit(start * (1 - prior_f)) + weight * F.sum(1 - F.col("value")).over(run)
    sums = rows.select("key", "seq", F.row_number().over(_past()).cast("bigint").alias("rounds"), p.alias("p"), n.alias("n"))
    w = F.col("p") + F.col("n")
    truth = sums.select("key", "seq", "rounds", (F.col("p") / w).alias("f"), F.least(w / (w + 1), F.lit(CAP)).alias("c"))
    return truth.withColumn("action", action(F.col("f"), F.col("c")))


def phase(d1: Column, d2: Column) -> Column:
    """Where a print goes: compared with the one before, and with the one before that."""
    return F.when(d1.isNull(), "first").when(d1 == 0, "settled").when(d2 < d1, "returning").otherwise("moving")


def _phase(d1: int | None, d2: int | None) -> str:
    return "first" if d1 is None else "settled" if d1 == 0 else "returning" if d2 is not None and d2 < d1 else "moving"


class Trajectory(StatefulProcessor):
    """Each print of a key against the last and the last but one: the two are a list state."""

    OUT = "key string, seq bigint, iteration bigint, d1 bigint, d2 bigint, phase string"

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "print bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        last, n, out = [x[0] for x in self.last.get()], self.count.get()[0] if self.count.exists() else 0, []
        for r in _in_order(rows):
            apart = [((int(r.print) ^ int(x)) & (2**64 - 1)).bit_count() for x in reversed(last)] + [None, None]
            n, last = n + 1, [*last[-1:], int(r.print)]
            out.append((key[0], r.seq, n, apart[0], apart[1], _phase(*apart[:2])))
        self.last.put([(x,) for x in last])
        self.count.update((n,))
        frame = pd.DataFrame(out, columns=["key", "seq", "iteration", "d1", "d2", "phase"])
        yield frame.astype({"d1": "Int64", "d2": "Int64"})

    def close(self) -> None:
        pass


def record_iterations(stream: DataFrame) -> DataFrame:
    """Columns key, ts, seq, print."""
    return _run(stream.select("key", "ts", "seq", "print"), Trajectory(), Trajectory.OUT)


def iterations_twin(rows: DataFrame) -> DataFrame:
    apart = lambda k: F.bit_count(F.col("print").bitwiseXOR(F.lag("print", k).over(_past()))).cast("bigint")
    each = rows.select("key", "seq", F.row_number().over(_past()).cast("bigint").alias("iteration"), apart(1).alias("d1"), apart(2).alias("d2"))
    return each.withColumn("phase", phase(F.col("d1"), F.col("d2")))


class Recalibration(StatefulProcessor):
    """Running mean and deviation of a key's distances; where one observation moves the mean by more than two deviations,
    the threshold is set anew, to the mean plus three deviations."""

    OUT = "key string, seq bigint, n bigint, mean double, sigma double, alert boolean, threshold bigint"

    def __init__(self, threshold: int, least: int = 10):
        self.first, self.least = threshold, least

    def init(self, handle) -> None:
        self.moments = handle.getValueState("moments", "n bigint, mean double, m2 double")
        self.threshold = handle.getValueState("threshold", "t bigint")

    def handleInputRows(self, key, rows, timerValues):
        n, mean, m2 = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0)
        threshold, out = self.threshold.get()[0] if self.threshold.exists() else self.first, []
        for r in _in_order(rows):
            before, sigma = mean, math.sqrt(m2 / n) if n else 0.0
            n, delta = n + 1, r.value - mean
            mean += delta / n
            m2 += delta * (r.value - mean)
            now = math.sqrt(m2 / n)
            alert = n > self.least and sigma > 0 and abs(mean - before) > 2 * sigma
            if alert:
                threshold = math.floor(mean + 3 * now)
            out.append((key[0], r.seq, n, mean, now, alert, threshold))
        self.moments.update((n, mean, m2))
        self.threshold.update((threshold,))
        yield pd.DataFrame(out, columns=["key", "seq", "n", "mean", "sigma", "alert", "threshold"])

    def close(self) -> None:
        pass


def recalibrate(stream: DataFrame, threshold: int, least: int = 10) -> DataFrame:
    """Columns key, ts, seq, value."""
    return _run(stream.select("key", "ts", "seq", F.col("value").cast("double").alias("value")), Recalibration(threshold, least), Recalibration.OUT)


def recalibration_twin(rows: DataFrame, threshold: int, least: int = 10) -> DataFrame:
    run = _past().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col("value").cast("double")
    each = rows.select("key", "ts", "seq", F.count("*").over(run).alias("n"), F.avg(v).over(run).alias("mean"), F.stddev_pop(v).over(run).alias("sigma"))
    before, deviation = F.lag("mean").over(_past()), F.lag("sigma").over(_past())
    each = each.withColumn("alert", F.coalesce((F.col("n") > least) & (deviation > 0) & (F.abs(F.col("mean") - before) > 2 * deviation), F.lit(False)))
    fresh = F.when(F.col("alert"), F.floor(F.col("mean") + 3 * F.col("sigma")).cast("bigint"))
    each = each.withColumn("threshold", F.coalesce(F.last(fresh, ignorenulls=True).over(run), F.lit(threshold).cast("bigint")))
    return each.drop("ts")


class Crystallization(StatefulProcessor):
    """A key soaks evidence for each bit until it has seen ``needed`` prints; then the bits' majorities become its print
    (Form to Flow) and the counters go. A timer freezes the print ``delay_ms`` later (Flow to Freeze)."""

    OUT = "key string, gate string, at timestamp, print bigint"

    def __init__(self, bits: int, needed: int, delay_ms: int):
        self.bits, self.needed, self.delay = bits, needed, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.soaking = handle.getMapState("soaking", "bit int", "total bigint")
        self.seen = handle.getValueState("seen", "n bigint")
        self.print = handle.getValueState("print", "print bigint, at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        if self.print.exists():
            return
        n = self.seen.get()[0] if self.seen.exists() else 0
        totals = {b: (self.soaking.getValue((b,))[0] if self.soaking.containsKey((b,)) else 0) for b in range(self.bits)}
        for r in _in_order(rows):
            n += 1
            for b in totals:
                totals[b] += 1 if (int(r.print) >> b) & 1 else -1
            if n == self.needed:
                value = sum(1 << b for b, t in totals.items() if t > 0)
                self.print.update((value, r.ts.to_pydatetime()))
                self.soaking.clear()
                self.seen.clear()
                self.handle.registerTimer(int(r.ts.timestamp() * 1000) + self.delay)
                yield pd.DataFrame([(key[0], "Flow", r.ts, value)], columns=["key", "gate", "at", "print"])
                return
        self.seen.update((n,))
        for b, t in totals.items():
            self.soaking.updateValue((b,), (t,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        value, _ = self.print.get()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], "Freeze", at, value)], columns=["key", "gate", "at", "print"])

    def close(self) -> None:
        pass


def crystallize(stream: DataFrame, bits: int, needed: int, delay_ms: int, late: str = "0 seconds") -> DataFrame:
    """Columns key, ts, seq, print of a stream; a row for each change of a key's gate."""
    return _run(stream.select("key", "ts", "seq", "print"), Crystallization(bits, needed, delay_ms), Crystallization.OUT, timed=True, late=late)


def crystallize_twin(rows: DataFrame, bits: int, needed: int, delay_ms: int) -> DataFrame:
    """The same from a table whose last row's time is the watermark."""
    first = rows.withColumn("turn", F.row_number().over(_past())).where(F.col("turn") <= needed)
    is_set = lambda b: F.shiftright(F.col("print"), b).bitwiseAND(F.lit(1)) == 1
    folds = [F.when(2 * F.count_if(is_set(b)) > F.count("*"), F.lit(1 << b)).otherwise(0).cast("bigint").alias(f"b{b}") for b in range(bits)]
    done = first.groupBy("key").agg(F.count("*").alias("n"), F.max("ts").alias("at"), *folds).where(F.col("n") == needed)
    value = sum((F.col(f"b{b}") for b in range(bits)), F.lit(0).cast("bigint"))
    flow = done.select("key", F.lit("Flow").alias("gate"), "at", value.alias("print"))
    end = rows.agg(F.max("ts").alias("end"))
    later = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_ms / 1000))
    frozen = flow.crossJoin(F.broadcast(end)).where(later < F.col("end")).select("key", F.lit("Freeze").alias("gate"), later.alias("at"), "print")  # one row
    return flow.unionByName(frozen)
