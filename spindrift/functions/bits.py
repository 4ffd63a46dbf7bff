"""Bit vectors as arrays of 64-bit words, byte arrays as arrays of integers 0 to 255. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_shl = lambda w, n: F.call_function("shiftleft", w, n)
_shr = lambda w, n: F.call_function("shiftrightunsigned", w, n)


def masked_popcount(a: Column, mask: Column) -> Column:
    """Set bits of all words within one mask."""
    return F.aggregate(F.transform(a, lambda w: F.bit_count(w.bitwiseAND(mask)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def popcount_words(a: Column) -> Column:
    return F.transform(a, F.bit_count)


def signed_bytes(a: Column) -> Column:
    """Bytes 0 to 255 as -128 to 127."""
    return F.transform(a, lambda x: F.when(x > 127, x - 256).otherwise(x))


def phase_inverse(a: Column) -> Column:
    return F.transform(a, lambda x: (256 - x) % 256)


def find_pairs(a: Column, pattern: int) -> Column:
    """Places (from 0) where two bytes in a row hold a 16-bit pattern, the high byte first."""
    high, low = pattern >> 8, pattern & 255
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 2, F.lit(0))), lambda i: (F.get(a, i) == high) & (F.get(a, i + 1) == low))


def find_first(a: Column, byte: int) -> Column:
    """The first place (from 0) of a byte, null without one."""
    at = F.array_position(a, byte)
    return F.when(at > 0, at - 1)


def nibbles_less(packed: Column, delta: int) -> Column:
    """Every nibble less ``delta``, 0 at least."""
    part = lambda n: F.greatest(n - delta, F.lit(0))
    return F.transform(packed, lambda b: part(b.bitwiseAND(F.lit(15))) + 16 * part(F.shiftright(b, 4)))


def nibbles_above(packed: Column, threshold: int) -> Column:
    """Places (from 0) of the nibbles above a threshold; the low one of a byte comes first."""
    each = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4))))
    kept = F.filter(F.transform(each, lambda n, i: F.when(n > threshold, i)), lambda i: i.isNotNull())
    return kept


def bits_for(size: int) -> int:
    """Bits that tell ``size`` values apart, 8 at most."""
    return 0 if size <= 1 else min(8, (size - 1).bit_length())


def pack_indices(codes: Column, bits: int) -> Column:
    """Codes of 1 to 8 bits in words of 64, the first lowest; a code never spans two words."""
    per = 64 // bits
    word = lambda w: F.aggregate(F.transform(F.slice(codes, w * per + 1, per), lambda c, i: _shl(c.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1)), i * bits)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    count = F.ceil(F.size(codes) / per).cast("int")
    return F.when(F.size(codes) > 0, F.transform(F.sequence(F.lit(0), count - 1), word)).otherwise(F.array().cast("array<bigint>"))


def unpack_indices(words: Column, bits: int, count: Column) -> Column:
    per = 64 // bits
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: _shr(w, i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")))
    return F.slice(F.flatten(each), F.lit(1), count)


def transcode(words: Column, old_bits: int, new_bits: int, count: Column) -> Column:
    """The same codes at another width; wider codes lose their high bits."""
    return pack_indices(unpack_indices(words, old_bits, count), new_bits)


def bf16_hamming(a: Column, b: Column, sign: int = 256, exponent: int = 16, mantissa: int = 1) -> Column:
    """Differing bits of arrays of 16-bit floats, weighted by field."""
    bits = lambda x: F.bit_count(x).cast("bigint")
    one = lambda x: bits(x.bitwiseAND(F.lit(0x8000))) * sign + bits(x.bitwiseAND(F.lit(0x7F80))) * exponent + bits(x.bitwiseAND(F.lit(0x7F))) * mantissa
    return F.aggregate(F.zip_with(a, b, lambda x, y: one(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def xor_difference(center: Column, point: Column) -> Column:
    """Where a point differs from a centre, and its values there: array of struct(at, value)."""
    each = F.zip_with(F.zip_with(center, point, lambda c, p: F.when(c != p, p)), F.sequence(F.lit(0), F.size(center) - 1), lambda v, i: F.struct(i.alias("at"), v.alias("value")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def hamming_to_difference(query: Column, center: Column, difference: Column, to_center: Column) -> Column:
    """Distance in bits from a query to a point given as its difference from a centre, without decoding it."""
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")
    step = F.transform(difference, lambda d: apart(F.get(query, d["at"]), d["value"]) - apart(F.get(query, d["at"]), F.get(center, d["at"])))
    return F.aggregate(step, to_center, lambda s, x: s + x)


def bind(a: Column, b: Column) -> Column:
    """XOR; binding twice gives the first operand back."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def complement(a: Column) -> Column:
    return F.transform(a, F.bitwise_not)


def popcount(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda w: F.bit_count(w).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def rotate(a: Column, words: int, bits: int) -> Column:
    """Cyclic shift of ``words`` 64-bit words by ``bits`` towards higher positions; negative values shift back."""
    bits %= 64 * words
    whole, part = divmod(bits, 64)
    n = F.lit(words)

    def word(i: Column) -> Column:
        low = F.get(a, F.pmod(i - whole, n))
        if part == 0:
            return low
        carry = F.get(a, F.pmod(i - whole - 1, n))
        return _shl(low, F.lit(part)).bitwiseOR(_shr(carry, F.lit(64 - part)))

    return F.transform(F.sequence(F.lit(0), n - 1), word)


def rotate_items(a: Column, k: int) -> Column:
    """Cyclic shift of an array by ``k`` items."""
    n = F.size(a)
    at = F.pmod(F.lit(k), n)
    return F.concat(F.slice(a, n - at + 1, at), F.slice(a, F.lit(1), n - at))


def phase_bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) % 256)


def phase_unbind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(256)))


def circular_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(F.transform(gap, lambda d: F.least(d, 256 - d).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def wasserstein(a: Column, b: Column) -> Column:
    """W1 distance of two byte arrays of equal length."""
    gap = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y).cast("bigint"))
    return F.aggregate(gap, F.lit(0).cast("bigint"), lambda s, x: s + x)


def find_all(a: Column, needle: int) -> Column:
    """Positions, from 0, of a value in an array."""
    at = F.transform(a, lambda x, i: F.when(x == needle, i))
    return F.filter(at, lambda i: i.isNotNull())


def nibble_pack(codes: Column) -> Column:
    """Two 4-bit codes a byte, the first low; an odd last one stands alone."""
    n = F.ceil(F.size(codes) / 2).cast("int")
    pair = lambda i: F.get(codes, 2 * i) + 16 * F.coalesce(F.get(codes, 2 * i + 1), F.lit(0))
    return F.when(F.size(codes) > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<int>"))


def nibble_unpack(packed: Column, count: Column) -> Column:
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(b % 16, F.floor(b / 16).cast("int")))), F.lit(1), count)


def majority(a: Column, b: Column, c: Column) -> Column:
    """Bit by bit what two of three arrays of words have."""
    two = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseAND(q))
    either = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseOR(q))
    return either(either(two(a, b), two(a, c)), two(b, c))


def superpose(s: Column, p: Column, o: Column, words: int, shift: int) -> Column:
    """Three prints in one: the majority of the first, the second turned by ``shift`` bits and the third by twice as many."""
    return majority(s, rotate(p, words, shift), rotate(o, words, 2 * shift))


def recover(bundle: Column, place: int, words: int, shift: int) -> Column:
    """The print at a place (0, 1, 2) of a superposition, but for the bits in which the other two outvoted it."""
    return rotate(bundle, words, -place * shift)
