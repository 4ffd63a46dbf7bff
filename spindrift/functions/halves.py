"""16-bit floats and rotary embeddings, vectorised in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.typing import ArrayLike
from pyspark.sql import functions as F


def to_bf16(x: ArrayLike, rounded: bool = True) -> ArrayLike:
    """bfloat16 bits of 32-bit floats: truncated, or rounded to nearest even; NaN stays NaN."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    if not rounded:
        return (bits >> np.uint32(16)).astype(np.uint16)
    with np.errstate(over="ignore"):
        up = bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))
    return np.where(np.isnan(x), np.uint16(0x7FC0), (up >> np.uint32(16)).astype(np.uint16))


def from_bf16(bits: ArrayLike) -> ArrayLike:
    return (bits.astype(np.uint32) << np.uint32(16)).view(np.float32)


def bf16_round_trip(vector, rounded: bool = True):
    """An array's numbers as bfloat16 holds them, rounded to nearest even or cut."""

    @F.pandas_udf("array<float>")
    def apply(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else from_bf16(to_bf16(np.asarray(x, np.float32), rounded)))

    return apply(vector)


def rope(vector, position, theta: float = 10_000.0):
    """Rotary position embedding of an even-length vector: neighbours 2i and 2i + 1 rotate by position * theta^(-2i / n)."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for x, at in zip(v, p):
            if x is None:
                out.append(None)
                continue
            x = np.asarray(x, float)
            angle = at * theta ** (-2 * np.arange(len(x) // 2) / len(x))
            a, b = x[::2], x[1::2]
            out.append(np.stack([a * np.cos(angle) - b * np.sin(angle), a * np.sin(angle) + b * np.cos(angle)], axis=1).reshape(-1))
        return pd.Series(out)

    return apply(vector, position)
