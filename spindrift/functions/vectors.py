"""Functions of array columns: dense vectors and bit-packed fingerprints. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def total(values: Column, start=0.0) -> Column:
    return F.aggregate(values, F.lit(start), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column, p: int = 2) -> Column:
    """L0 counts non-zeros, L1 sums magnitudes, Lp is the p-th root of the sum of p-th powers."""
    v = doubles(v)
    if p == 0:
        return total(F.transform(v, lambda x: F.when(x != 0, 1.0).otherwise(0.0)))
    if p == 1:
        return total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def sign_word(v: Column) -> Column:
    """Fingerprint of a vector of up to 64 numbers: bit i is set where element i is positive."""
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two words."""
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def softmax(v: Column) -> Column:
    """Shifted by the maximum, so large values don't overflow."""

    def scaled(e: Column) -> Column:
        return F.transform(F.array(total(e)), lambda s: F.transform(e, lambda x: x / s))[0]

    def body(d: Column) -> Column:
        e = F.transform(F.array(F.array_max(d)), lambda top: F.transform(d, lambda x: F.exp(x - top)))[0]
        return F.transform(F.array(e), scaled)[0]

    return F.transform(F.array(doubles(v)), body)[0]


def log_softmax(v: Column) -> Column:
    def body(d: Column) -> Column:
        top = F.array_max(d)
        rest = F.ln(total(F.transform(d, lambda x: F.exp(x - top)))) + top
        return F.transform(F.array(rest), lambda r: F.transform(d, lambda x: x - r))[0]

    return F.transform(F.array(doubles(v)), body)[0]


def affine(v: Column, weight: Column | None, bias: Column | None = None) -> Column:
    """v * weight + bias, each of v's length; what is missing is left out."""
    v = v if weight is None else F.zip_with(v, weight, lambda x, w: x * w)
    return v if bias is None else F.zip_with(v, bias, lambda x, b: x + b)


def group_norm(v: Column, groups: int, weight: Column | None = None, bias: Column | None = None) -> Column:
    """Each of ``groups`` equal runs of the vector normalised alone."""
    each = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: layer_norm(F.slice(v, (g * F.size(v) / groups).cast("int") + 1, (F.size(v) / groups).cast("int"))))
    return affine(F.flatten(each), weight, bias)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit variance; :func:`affine` applies a layer's weights."""
    d = doubles(v)

    def body(x: Column) -> Column:
        mean = total(x) / F.size(x)
        var = total(F.transform(x, lambda e: (e - mean) * (e - mean))) / F.size(x)
        return F.transform(F.array(F.struct(mean.alias("m"), F.sqrt(var + eps).alias("s"))), lambda t: F.transform(x, lambda e: (e - t["m"]) / t["s"]))[0]

    return F.transform(F.array(d), body)[0]


def rms_norm(v: Column, eps: float = 1e-5) -> Column:
    d = doubles(v)
    scale = F.sqrt(total(F.transform(d, lambda e: e * e)) / F.size(d) + eps)
    return F.transform(F.array(scale), lambda s: F.transform(d, lambda e: e / s))[0]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def quantize_u8(v: Column) -> Column:
    """Asymmetric 8-bit codes between the data's own extremes: struct(scale, zero, codes); a constant vector has scale 1.
    The zero point is cut to 0..255, so data of one sign keep only part of their range, as the format has it."""
    d = doubles(v)

    def body(x: Column) -> Column:
        low, high = F.array_min(x), F.array_max(x)
        scale = F.when(high > low, (high - low) / 255).otherwise(1.0)
        zero = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(-low / scale)))
        return F.transform(
            F.array(F.struct(scale.alias("scale"), zero.alias("zero"))),
            lambda p: F.struct(p["scale"].alias("scale"), p["zero"].cast("int").alias("zero"), F.transform(x, lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(e / p["scale"] + p["zero"]))).cast("int")).alias("codes")),
        )[0]

    return F.transform(F.array(d), body)[0]


def quantize_i8(v: Column) -> Column:
    """Symmetric 8-bit codes: struct(scale, codes)."""
    d = doubles(v)

    def body(x: Column) -> Column:
        top = F.array_max(F.transform(x, F.abs))
        scale = F.when(top > 0, top / 127).otherwise(1.0)
        return F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), F.transform(x, lambda e: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(e / s))).cast("int")).alias("codes")))[0]

    return F.transform(F.array(d), body)[0]


def dequantize(codes: Column, scale: Column, zero: Column | int = 0) -> Column:
    return F.transform(codes, lambda q: (q - zero) * scale)


def quantize_i4(v: Column) -> Column:
    """Symmetric 4-bit codes (-8 to 7, scale = largest / 7): struct(scale, codes)."""
    return _symmetric(v, 7.0, -8.0, 7.0)


def quantize_i2(v: Column) -> Column:
    """-1, 0 or 1 after scaling by the largest: struct(scale, codes)."""
    return _symmetric(v, 1.0, -1.0, 1.0)


def _symmetric(v: Column, steps: float, low: float, high: float) -> Column:
    def body(x: Column) -> Column:
        top = F.array_max(F.transform(x, F.abs))
        scale = F.when(top > 0, top / steps).otherwise(1.0)
        code = lambda e, s: F.greatest(F.lit(low), F.least(F.lit(high), F.round(e / s))).cast("int")
        return F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), F.transform(x, lambda e: code(e, s)).alias("codes")))[0]

    return F.transform(F.array(doubles(v)), body)[0]


def pack_i4(codes: Column) -> Column:
    """Bytes of two 4-bit codes in two's complement, the first one low."""
    return _packed(F.transform(codes, lambda c: c.bitwiseAND(F.lit(15))), 4)


def unpack_i4(packed: Column, n: Column | int) -> Column:
    return F.transform(_unpacked(packed, 4, n), lambda c: F.when(c > 7, c - 16).otherwise(c))


def pack_i2(codes: Column) -> Column:
    """Bytes of four codes -1, 0, 1, stored one higher, the first lowest."""
    return _packed(F.transform(codes, lambda c: c + 1), 2)


def unpack_i2(packed: Column, n: Column | int) -> Column:
    return F.transform(_unpacked(packed, 2, n), lambda c: c - 1)


def _packed(codes: Column, bits: int) -> Column:
    per = 8 // bits
    count = F.ceil(F.size(codes) / per).cast("int")
    byte = lambda w: F.aggregate(F.transform(F.slice(codes, w * per + 1, per), lambda c, i: F.call_function("shiftleft", c, i * bits)), F.lit(0), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(codes) > 0, F.transform(F.sequence(F.lit(0), count - 1), byte)).otherwise(F.array().cast("array<int>"))


def _unpacked(packed: Column, bits: int, n: Column | int) -> Column:
    per = 8 // bits
    each = F.transform(packed, lambda b: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.call_function("shiftright", b, i * bits).bitwiseAND(F.lit((1 << bits) - 1))))
    return F.slice(F.flatten(each), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def pack_codes(codes: Column, bits: int) -> Column:
    """Packs unsigned codes of ``bits`` bits (a divisor of 32), the first lowest, into words of 32 bits."""
    per = 32 // bits
    words = F.sequence(F.lit(0), F.ceil(F.size(codes) / per).cast("int") - 1)
    word = lambda w: F.aggregate(
        F.transform(F.slice(codes, w * per + 1, per), lambda c, i: F.call_function("shiftleft", c.cast("bigint"), i * bits)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)
    )
    return F.when(F.size(codes) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def unpack_codes(words: Column, bits: int, count: Column) -> Column:
    per = 32 // bits
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.call_function("shiftright", w, i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")))
    return F.slice(F.flatten(each), F.lit(1), count)
