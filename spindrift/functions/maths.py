"""Elementwise functions by name. Where Spark gives null and IEEE arithmetic doesn't, IEEE's value is returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def ln(x: Column) -> Column:
    """-inf at 0, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-_INF)).when(x.isNotNull(), F.lit(_NAN))


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities, and NaN for 0 / 0."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF)).when(a.isNotNull() & b.isNotNull(), F.lit(_NAN))


def round_half_away(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double")


#: Functions of one number.
UNARY = {
    "is_nan": F.isnan,
    "is_infinite": lambda x: F.abs(x) == F.lit(_INF),
    "round": round_half_away,
    "exp": F.exp,
    "exp2": lambda x: F.pow(F.lit(2.0), x),
    "exp_m1": F.expm1,
    "ln": ln,
    "log2": lambda x: ln(x) / F.ln(F.lit(2.0)),
    "log10": lambda x: ln(x) / F.ln(F.lit(10.0)),
    "ln_1p": F.log1p,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "tan": F.tan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "to_degrees": F.degrees,
    "to_radians": F.radians,
    "pow2": lambda x: x * x,
    "recip": lambda x: divide(F.lit(1.0), x),
    "neg": lambda x: -x,
    "to_complex": lambda x: F.struct(x.alias("re"), F.lit(0.0).alias("im")),
}
#: Functions of two numbers.
BINARY = {
    "powf": F.pow,
    "log": lambda x, base: ln(x) / F.ln(base),
    "abs_sub": lambda x, y: F.greatest(x - y, F.lit(0.0)),
    "hypot": F.hypot,
    "div": divide,
    "atan2": F.atan2,
    "max": F.greatest,
    "min": F.least,
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
}


def on_array(name: str, a: Column, b: Column | None = None) -> Column:
    """A function on every element of an array, or on the pairs of two arrays."""
    return F.transform(a, UNARY[name]) if b is None else F.zip_with(a, b, BINARY[name])


def single(x: Column) -> Column:
    """Rounded to 32 bits, as single-precision results are."""
    return x.cast("float")


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.lit(alpha) * a + b)


def scaled(alpha: float, x: Column) -> Column:
    return F.transform(x, lambda a: F.lit(alpha) * a)


def givens(a: Column, b: Column) -> Column:
    """Rotation that makes (a, b) to (r, 0): struct(c, s, r). r has the sign of the larger of both."""
    larger = F.when(F.abs(a) > F.abs(b), a).otherwise(b)
    r = F.signum(larger) * F.hypot(a, b)
    c, s = F.when(r == 0, 1.0).otherwise(F.try_divide(a, r)), F.when(r == 0, 0.0).otherwise(F.try_divide(b, r))
    return F.struct(c.alias("c"), s.alias("s"), r.alias("r"))
