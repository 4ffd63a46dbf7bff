"""Linear algebra on coordinate frames (i0, i1, v), and dense factorisations of many small matrices in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.typing import ArrayLike
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha A B by a join on the inner index and a sum; zeros need no rows."""
    left = a.select(F.col("i0").alias("i"), F.col("i1").alias("k"), F.col("v").alias("va"))
    right = b.select(F.col("i0").alias("k"), F.col("i1").alias("j"), F.col("v").alias("vb"))
    return left.join(right, "k").groupBy(F.col("i").alias("i0"), F.col("j").alias("i1")).agg((alpha * F.sum(F.col("va") * F.col("vb"))).alias("v"))


def matmul_add(a: DataFrame, b: DataFrame, c: DataFrame, alpha: float, beta: float) -> DataFrame:
    both = matmul(a, b, alpha).unionByName(c.select("i0", "i1", (beta * F.col("v")).alias("v")))
    return both.groupBy("i0", "i1").agg(F.sum("v").alias("v"))


def gram(rows: DataFrame) -> DataFrame:
    """A'A of a tall matrix given as vectors of bounded width: a matrix product per Arrow batch, so only width x width
    sums per task are shuffled."""

    def run(batches):
        total = None
        for batch in batches:
            x = np.asarray(batch.column(0).to_pylist())
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1), pa.int64()), pa.array(j.reshape(-1), pa.int64()), pa.array(total.reshape(-1))], ["i0", "i1", "v"])

    sums = rows.where("x is not null").select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "i0 bigint, i1 bigint, v double")
    return sums.groupBy("i0", "i1").agg(F.sum("v").alias("v"))


def matvec(a: DataFrame, x: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha A x; x is (i, x)."""
    return a.join(x, F.col("i1") == F.col("i")).groupBy("i0").agg((alpha * F.sum(F.col("v") * F.col("x"))).alias("v"))


def triangular(a: DataFrame, upper: bool, unit: bool = False) -> DataFrame:
    keep = F.col("i0") <= F.col("i1") if upper else F.col("i0") >= F.col("i1")
    return a.where(keep).withColumn("v", F.when(F.lit(unit) & (F.col("i0") == F.col("i1")), 1.0).otherwise(F.col("v")))


def banded(a: DataFrame, below: int, above: int) -> DataFrame:
    return a.where((F.col("i1") - F.col("i0")).between(-below, above))


def symmetric(a: DataFrame, upper: bool) -> DataFrame:
    """The whole matrix from one of its triangles."""
    half = triangular(a, upper)
    return half.unionByName(half.where("i0 <> i1").select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"))


def outer(x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha x y': the result has a row per pair by its nature."""
    return x.select(F.col("i").alias("i0"), F.col("x")).crossJoin(y.select(F.col("i").alias("i1"), F.col("x").alias("y"))).select("i0", "i1", (alpha * F.col("x") * F.col("y")).alias("v"))


def kron(a: DataFrame, b: DataFrame, b_rows: int, b_columns: int) -> DataFrame:
    """Kronecker product; the second factor is the smaller one."""
    right = b.select(F.col("i0").alias("k0"), F.col("i1").alias("k1"), F.col("v").alias("w"))
    return a.crossJoin(right).select((F.col("i0") * b_rows + F.col("k0")).alias("i0"), (F.col("i1") * b_columns + F.col("k1")).alias("i1"), (F.col("v") * F.col("w")).alias("v"))


def _per_row(frame: DataFrame, key: str, vector: str, body, out: str = "v array<double>") -> DataFrame:
    """Applies a numpy function to each row's vector."""

    def run(batches):
        for batch in batches:
            rows = [body(np.asarray(v)).tolist() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, "v"])

    return frame.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, f"{key} bigint, {out}")


def spectrum(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """Power of the real FFT's n/2 + 1 frequencies."""
    return _per_row(frame, key, vector, lambda x: np.abs(np.fft.rfft(x)) ** 2)


def _hadamard(x: ArrayLike) -> ArrayLike:
    n = len(x)
    if n & (n - 1):
        raise ValueError("the length must be a power of two")
    y, h = x.copy(), 1
    while h < n:
        y = y.reshape(-1, 2, h)
        y = np.concatenate([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
        h *= 2
    return y / np.sqrt(n)


def walsh_hadamard(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """Normalised, so that it is its own inverse."""
    return _per_row(frame, key, vector, _hadamard)


def solve(frame: DataFrame, key: str, matrix: str, rhs: str, n: int, method: str = "lu") -> DataFrame:
    """Solves one dense n x n system per row (matrix row-major); singular ones give null.

    ``method``: lu, cholesky or qr."""

    def one(a: ArrayLike, b: ArrayLike):
        try:
            if method == "cholesky":
                low = np.linalg.cholesky(a)
                return np.linalg.solve(low.T, np.linalg.solve(low, b)).tolist()
            if method == "qr":
                q, r = np.linalg.qr(a)
                return np.linalg.solve(r, q.T @ b).tolist()
            return np.linalg.solve(a, b).tolist()
        except np.linalg.LinAlgError:
            return None

    def run(batches):
        for batch in batches:
            rows = [one(np.asarray(a).reshape(n, n), np.asarray(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, "v"])

    picked = frame.select(F.col(key).cast("bigint").alias(key), F.col(matrix).cast("array<double>").alias("a"), F.col(rhs).cast("array<double>").alias("b"))
    return picked.mapInArrow(run, f"{key} bigint, v array<double>")


def symm(a: DataFrame, b: DataFrame, upper: bool, alpha: float = 1.0) -> DataFrame:
    """alpha A B with A symmetric, given by one triangle."""
    return matmul(symmetric(a, upper), b, alpha)


def trmm(a: DataFrame, b: DataFrame, upper: bool, unit: bool = False, alpha: float = 1.0) -> DataFrame:
    return matmul(triangular(a, upper, unit), b, alpha)


def trmv(a: DataFrame, x: DataFrame, upper: bool, unit: bool = False) -> DataFrame:
    return matvec(triangular(a, upper, unit), x)


def sbmv(a: DataFrame, x: DataFrame, upper: bool, width: int, alpha: float = 1.0) -> DataFrame:
    """Symmetric with ``width`` bands beside the diagonal."""
    return matvec(banded(symmetric(a, upper), width, width), x, alpha)


def syr(a: DataFrame, x: DataFrame, alpha: float, upper: bool, y: DataFrame | None = None) -> DataFrame:
    """One triangle of A + alpha x x', or with ``y`` of A + alpha (x y' + y x'). x and y are (i, x)."""
    parts = [outer(x, x, alpha)] if y is None else [outer(x, y, alpha), outer(y, x, alpha)]
    both = a.select("i0", "i1", "v")
    for part in parts:
        both = both.unionByName(part)
    return triangular(both.groupBy("i0", "i1").agg(F.sum("v").alias("v")), upper)


def int8_matmul(a: DataFrame, b: DataFrame, a_zero: int = 0, scale: float | None = None) -> DataFrame:
    """Products of whole numbers, summed exactly: A's codes less their zero point times B's; scaled if asked for."""
    codes = a.withColumn("v", F.col("v").cast("bigint") - a_zero)
    out = matmul(codes, b.withColumn("v", F.col("v").cast("bigint")), 1)
    return out if scale is None else out.withColumn("v", F.col("v") * scale)


def _batches(frame: DataFrame, columns: list[str], schema: str, body) -> DataFrame:
    """Applies a numpy function of stacked arrays to each Arrow batch: ``columns`` are the key and arrays of one length."""
    key, *arrays = columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = body(*[np.asarray(c.to_pylist(), float) for c in batch.columns[1:]])
                kinds = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(x.reshape(len(x), -1)), kinds) for x in found]], [key, *names])

    names = [part.split()[0] for part in schema.split(", ")]
    picked = frame.select(F.col(key).cast("bigint").alias(key), *[F.col(c).cast("array<double>").alias(c) for c in arrays])
    return picked.where(" and ".join(f"{c} is not null" for c in arrays)).mapInArrow(run, f"{key} bigint, {schema}")


def lu(frame: DataFrame, key: str, matrix: str, n: int) -> DataFrame:
    """Factors of one n x n matrix per row, all rows of a batch at a time: ``lower`` (unit diagonal), ``upper``, row-major, and
    ``pivots``, the order of the rows, of which the largest comes first in every step. A singular matrix has a 0 on upper's diagonal."""

    def body(a: ArrayLike):
        a = a.reshape(-1, n, n).copy()
        order, rows = np.tile(np.arange(n, dtype=float), (len(a), 1)), np.arange(len(a))
        low = np.zeros_like(a)
        for k in range(n):
            at = np.abs(a[:, k:, k]).argmax(1) + k
            for x in (a, low, order):
                x[rows, k], x[rows, at] = x[rows, at].copy(), x[rows, k].copy()
            top = a[:, k, k]
            factor = np.divide(a[:, k + 1 :, k], top[:, None], out=np.zeros_like(a[:, k + 1 :, k]), where=top[:, None] != 0)
            low[:, k, k], low[:, k + 1 :, k] = 1, factor
            a[:, k + 1 :] -= factor[:, :, None] * a[:, k : k + 1]
            a[:, k + 1 :, k] = 0
        return low, a, order

    return _batches(frame, [key, matrix], "lower array<double>, upper array<double>, pivots array<double>", body)


def cholesky(frame: DataFrame, key: str, matrix: str, n: int) -> DataFrame:
    """``lower`` with A = L L' per row; NaN where a matrix isn't positive definite."""

    def body(a: ArrayLike):
        a, low = a.reshape(-1, n, n), np.zeros((len(a), n, n))
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(n):
                low[:, j, j] = np.sqrt(a[:, j, j] - (low[:, j, :j] ** 2).sum(1))
                for i in range(j + 1, n):
                    low[:, i, j] = (a[:, i, j] - (low[:, i, :j] * low[:, j, :j]).sum(1)) / low[:, j, j]
        return (low,)

    return _batches(frame, [key, matrix], "lower array<double>", body)


def qr(frame: DataFrame, key: str, matrix: str, rows: int, columns: int) -> DataFrame:
    """``q`` and ``r`` per row, r with a positive diagonal where the matrix has full rank."""

    def body(a: ArrayLike):
        q, r = np.linalg.qr(a.reshape(-1, rows, columns))
        sign = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
        return q * sign[:, None, :], r * sign[:, :, None]

    return _batches(frame, [key, matrix], "q array<double>, r array<double>", body)


def solve_triangular(frame: DataFrame, key: str, matrix: str, rhs: str, n: int, upper: bool, columns: int = 1, unit: bool = False) -> DataFrame:
    """``v`` with T v = rhs, T one triangle of the matrix; the right side has ``columns`` columns. A zero on the diagonal
    gives infinities or NaN."""

    def body(a: ArrayLike, b: ArrayLike):
        a, b = a.reshape(-1, n, n), b.reshape(-1, n, columns)
        x = np.zeros_like(b)
        with np.errstate(invalid="ignore", divide="ignore"):
            for i in reversed(range(n)) if upper else range(n):
                part = slice(i + 1, n) if upper else slice(0, i)
                rest = b[:, i] - (a[:, i, part, None] * x[:, part]).sum(1)
                x[:, i] = rest if unit else rest / a[:, i, i, None]
        return (x,)

    return _batches(frame, [key, matrix, rhs], "v array<double>", body)


def fft(frame: DataFrame, key: str, real: str, imaginary: str | None = None, inverse: bool = False) -> DataFrame:
    """``re`` and ``im`` of each row's transform; the inverse divides by the length."""

    def body(*parts: ArrayLike):
        z = parts[0] + 1j * parts[1] if len(parts) > 1 else parts[0]
        out = np.fft.ifft(z, axis=1) if inverse else np.fft.fft(z, axis=1)
        return out.real, out.imag

    return _batches(frame, [key, real, *([imaginary] if imaginary else [])], "re array<double>, im array<double>", body)


def rfft(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """The n / 2 + 1 frequencies of real rows."""

    def body(x: ArrayLike):
        out = np.fft.rfft(x, axis=1)
        return out.real, out.imag

    return _batches(frame, [key, vector], "re array<double>, im array<double>", body)
