"""Sampled signals: frames, spectra, lapped transforms, WAV bytes, convolutions of prints, and thresholds of images."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.bits import popcount
from spindrift.functions.vectors import hamming_words


def frames(values: Column, size: int, hop: int) -> Column:
    """Whole frames of ``size`` values, every ``hop``-th: array of arrays, empty for a shorter signal."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - size, F.lit(0)), F.lit(hop))
    return F.when(F.size(values) >= size, F.transform(starts, lambda i: F.slice(values, i + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def _per_signal(frame: DataFrame, key: str, signal: str, body) -> DataFrame:
    """``body``: a signal -> rows of numbers, which get a number each: key, frame, v."""

    def run(batches):
        for batch in batches:
            keys, numbers, rows = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = body(np.asarray(x, float))
                keys += [k] * len(found)
                numbers += range(len(found))
                rows += list(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], [key, "frame", "v"])

    picked = frame.where(F.col(signal).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(signal).cast("array<double>").alias("x"))
    return picked.mapInArrow(run, f"{key} bigint, frame bigint, v array<double>")


def stft_magnitude(frame: DataFrame, key: str, signal: str, size: int, hop: int) -> DataFrame:
    """Magnitudes of size / 2 + 1 frequencies of every frame, under a Hann window of period ``size``."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))

    def body(x: ArrayLike):
        if len(x) < size:
            return np.zeros((0, size // 2 + 1))
        rows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        return np.abs(np.fft.rfft(rows * window, axis=1))

    return _per_signal(frame, key, signal, body)


def mdct(frame: DataFrame, key: str, signal: str, size: int) -> DataFrame:
    """Lapped cosine transform: blocks of 2 ``size`` values, half of them shared with the next, give ``size`` numbers each,
    under a sine window."""
    n, k = np.arange(2 * size)[:, None], np.arange(size)[None]
    basis = np.sin(np.pi * (n + 0.5) / (2 * size)) * np.cos(np.pi / size * (n + 0.5 + size / 2) * (k + 0.5))

    def body(x: ArrayLike):
        if len(x) < 2 * size:
            return np.zeros((0, size))
        return np.lib.stride_tricks.sliding_window_view(x, 2 * size)[::size] @ basis

    return _per_signal(frame, key, signal, body)


def wav_bytes(frame: DataFrame, key: str, signal: str, rate: int) -> DataFrame:
    """key, wav: 16-bit mono PCM with its header; samples are scaled so that the loudest is the largest."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                x = np.asarray(x, float)
                pcm = (x * (32767 / max(np.abs(x).max(initial=0), 1e-10))).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(pcm))
                out.append(head + pcm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "wav"])

    picked = frame.where(F.col(signal).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(signal).cast("array<double>").alias("x"))
    return picked.mapInArrow(run, f"{key} bigint, wav binary")


def wav_header(wav: Column) -> Column:
    """struct(rate, samples) of a WAV's bytes, null where they aren't one."""
    text = lambda a, n: F.decode(F.substring(wav, a, n), "ISO-8859-1")
    little = lambda a: F.conv(F.concat(*[F.hex(F.substring(wav, a + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("bigint")
    good = (F.length(wav) >= 44) & (text(1, 4) == "RIFF") & (text(9, 4) == "WAVE") & (text(13, 4) == "fmt ")
    return F.when(good, F.struct(little(25).alias("rate"), F.floor((F.length(wav) - 44) / 2).alias("samples")))


def binary_conv1d(prints: DataFrame, by: list[str], at: str, words: str, kernel: Column, bits: int, stride: int = 1) -> DataFrame:
    """Equal bits of a kernel (an array of words) and of every ``stride``-th print of a sequence, and a score of -1 to 1."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1
    rows = prints.withColumn("i", place).where(F.col("i") % stride == 0)
    alike = bits - hamming_words(F.col(words), kernel)
    return rows.select(*by, (F.col("i") / stride).cast("bigint").alias("i"), alike.alias("alike"), (2 * alike / bits - 1).alias("score"))


def winner(scores: DataFrame, by: list[str], neuron: str, score: str) -> DataFrame:
    """The neuron of greatest score per group, the first on ties."""
    best = F.min(F.struct((-F.col(score)).alias("m"), F.col(neuron)))
    return scores.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{neuron}", (-F.col("b.m")).alias(score))


def local_means(image: DataFrame, by: list[str], reach: int) -> DataFrame:
    """image (.., i0, i1, v) with ``mean`` of the window of 2 ``reach`` + 1 rows and columns, cut at the edges: sums along one
    axis, then along the other."""
    along = lambda part, order: Window.partitionBy(*by, part).orderBy(order).rangeBetween(-reach, reach)
    rows = image.withColumns({"_s": F.sum("v").over(along("i0", "i1")), "_n": F.count("*").over(along("i0", "i1"))})
    total = rows.withColumns({"_s": F.sum("_s").over(along("i1", "i0")), "_n": F.sum("_n").over(along("i1", "i0"))})
    return total.withColumn("mean", F.col("_s") / F.col("_n")).drop("_s", "_n")


def adaptive_binarize(image: DataFrame, by: list[str], window: int, c: float) -> DataFrame:
    """1 where a pixel is darker than its window's mean less ``c``."""
    return local_means(image, by, window // 2).withColumn("bit", (F.col("v") < F.col("mean") - c).cast("int")).drop("mean")


def binarize(image: DataFrame, threshold: float) -> DataFrame:
    return image.withColumn("bit", (F.col("v") < threshold).cast("int"))


def tally(prints: DataFrame, by: list[str], word: str, sign: Column | int = 1, bits: int = 64) -> DataFrame:
    """+1 and -1 per bit: a tally that evidence (``sign`` 1) adds to and that takes evidence back (-1). ``t0``, ``t1``, .."""
    vote = lambda i: F.when(F.shiftrightunsigned(word, i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1) * sign
    return prints.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(vote(i)).alias(f"t{i}") for i in range(bits)])


def tally_word(bits: int = 64) -> Column:
    """The bits whose tally is positive."""
    parts = [F.when(F.col(f"t{i}") > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(i))).otherwise(F.lit(0).cast("bigint")) for i in range(bits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def saturating_sum(values: Column, low: int = -128, high: int = 127) -> Column:
    """Sum in order, held between bounds after every step."""
    return F.aggregate(values, F.lit(0), lambda s, x: F.greatest(F.lit(low), F.least(F.lit(high), s + x)))


def text_print(text: Column, words: int = 16) -> Column:
    """A text as an array of words of 64 pseudo-random bits: a hash of text and word number."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.xxhash64(text, i))


def density(words: Column, bits: int) -> Column:
    return popcount(words) / bits


def mel_filters(rate: int, size: int, channels: int) -> ArrayLike:
    """channels x (size / 2 + 1): triangles whose corners are even steps on the mel scale from 0 to half the rate, each
    rising from its left corner to 1 at its centre."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    corners = 700 * (10 ** (np.linspace(0, top, channels + 2) / 2595) - 1)
    at = corners * size / rate
    left, centre, right = (x[:, None] for x in (at[:-2], at[1:-1], at[2:]))
    bins = np.arange(size // 2 + 1)[None]
    up, down = (bins - left) / np.maximum(centre - left, 1e-10), (right - bins) / np.maximum(right - centre, 1e-10)
    return np.where((bins >= left) & (bins < centre), up, np.where((bins >= centre) & (bins < right), down, 0.0))


def log_mel(frame: DataFrame, key: str, signal: str, rate: int, size: int, hop: int, channels: int, least: float = 1e-10) -> DataFrame:
    """key, frame, v: natural logarithms of the filters' sums over each frame's magnitudes, ``least`` at least. The filters
    are a small fixed matrix; frames of one batch are multiplied together, and only the filters' columns that aren't 0."""
    filters = mel_filters(rate, size, channels)
    used = np.flatnonzero(filters.any(0))
    kernel = filters[:, used].T

    def run(batches):
        for batch in batches:
            magnitudes = np.asarray(batch.column(2).to_pylist(), np.float64).reshape(-1, size // 2 + 1)
            v = np.log(np.maximum(magnitudes[:, used] @ kernel, least))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(v), pa.list_(pa.float64()))], [key, "frame", "v"])

    return stft_magnitude(frame, key, signal, size, hop).mapInArrow(run, f"{key} bigint, frame bigint, v array<double>")


def pulses(v: Column, k: int) -> Column:
    """A vector on the lattice of ``k`` pulses: each goes to the element whose magnitude is farthest from the pulses that it
    has, the larger magnitude on ties, then the first, and has the element's sign. Of nothing, nothing."""

    def place(state: Column) -> Column:
        benefit = F.transform(state, lambda e: F.struct(F.abs(e["m"] - e["n"]).alias("b"), e["m"].alias("m"), (-e["i"]).alias("i")))
        best = F.transform(F.array(F.array_max(benefit)), lambda x: -x["i"])[0]
        return F.transform(F.array(best), lambda at: F.transform(state, lambda e: F.struct(e["m"].alias("m"), (e["n"] + F.when(e["i"] == at, 1).otherwise(0)).alias("n"), e["i"].alias("i"))))[0]

    start = F.transform(v.cast("array<double>"), lambda x, i: F.struct(F.abs(x).alias("m"), F.lit(0).alias("n"), i.alias("i")))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, lambda s, _: place(s)) if k else start
    return F.when(F.size(v) > 0, F.zip_with(done, v, lambda e, x: F.when(x >= 0, e["n"]).otherwise(-e["n"]))).otherwise(F.array().cast("array<int>"))


def from_pulses(p: Column) -> Column:
    """The unit vector of a vector of pulses."""
    squares = F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x)
    return F.transform(F.array(F.greatest(F.sqrt(squares), F.lit(1e-10))), lambda n: F.transform(p, lambda x: x / n))[0]
