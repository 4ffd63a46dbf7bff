"""Order MinHash fingerprints: sensitive to how much of a text is edited and to the order of its parts.

A text's k-mers of words are numbered by occurrence, hashed, and dealt by hash to ``buckets`` parts; of each part the
``keep`` smallest are taken, put back into text order and hashed together. One sorted pass serves all parts, so a
fingerprint costs two sorts of the text's k-mers whatever the number of parts. Two fingerprints are alike by the share
of their non-empty parts that agree. Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, run_starts, text_of, words

K, BUCKETS, KEEP = 5, 64, 2
#: Bits of the sorted words that hold a k-mer's position; hashes keep the other 38.
_POSITION_BITS = 26
_LOW = (1 << _POSITION_BITS) - 1
_BUCKET_BITS = BUCKETS.bit_length() - 1
_TUPLE_BITS = 32 - _BUCKET_BITS


def signature(text: Column, k: int = K, keep: int = KEEP) -> Column:
    """Array of (part number, hash of the part's tuple) in one integer below 2^32 each, ascending; empty without words.

    A text of fewer than ``k`` words has one k-mer, all of its words. Positions count modulo 2^26 words."""
    high = lambda x: F.shiftrightunsigned(x, _POSITION_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_LOW))
    pack = lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("bigint").bitwiseAND(F.lit(_LOW)))
    part = lambda x: F.shiftrightunsigned(x, 64 - _BUCKET_BITS)

    def of_words(wh: Column) -> Column:
        n = F.greatest(F.size(wh) - k + 1, F.lit(1))
        kmers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: pack(F.xxhash64(*[F.get(wh, i + j) for j in range(k)]), i))
        return F.when(F.size(wh) > 0, let(F.sort_array(kmers), of_kmers)).otherwise(F.array().cast("array<bigint>"))

    def of_kmers(s: Column) -> Column:
        # Equal k-mers are neighbours in text order: their occurrence numbers count from each run's start.
        numbers = lambda starts: F.flatten(F.transform(starts, lambda a, r: F.sequence(F.lit(0), F.coalesce(F.get(starts, r + 1), F.size(s)) - a - 1)))
        numbered = lambda occ: F.zip_with(s, occ, lambda x, c: pack(F.xxhash64(high(x), c), place(x)))
        return let(F.sort_array(let(let(run_starts(s, high), numbers), numbered)), of_numbered)

    def of_numbered(s: Column) -> Column:
        def of_start(a: Column) -> Column:
            chosen = F.filter(F.slice(s, a + 1, keep), lambda x: part(x) == part(F.get(s, a)))
            ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(place(x).alias("at"), high(x).alias("h"))))
            tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x["h"]))
            return F.shiftleft(part(F.get(s, a)), _TUPLE_BITS).bitwiseOR(F.shiftrightunsigned(tuple_hash, 64 - _TUPLE_BITS))

        return F.transform(run_starts(s, part), of_start)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts that either signature has in which both agree; 1 for two texts without words."""
    part = lambda x: F.shiftright(x, _TUPLE_BITS)
    either = F.size(F.array_union(F.transform(a, part), F.transform(b, part)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0))


def as_text(sig: Column) -> Column:
    """Eight hexadecimal digits per part."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), "")


#: Bytes of text that a range of doc_ids is to hold, and the most ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16


def with_next(docs: DataFrame, columns: list[str], size: Column) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the row with the following doc_id (of the last: the first's).

    Rows are dealt to ranges of doc_id whose lower bounds are doc_ids themselves, found as quantiles: one for every
    RANGE_BYTES of ``size``. Each range's first row also visits the range before it, so one shuffle and a window per range
    suffice. Rows of equal doc_id follow each other by their columns; a null doc_id stands before all others and is
    nobody's successor at the end, unless all are null.
    """
    whole = docs.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    ranges = min(MOST_RANGES, max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole // RANGE_BYTES))
    marks = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges + 1)], 10 * ranges).alias("m"), F.min("doc_id").alias("low")).first()
    bounds = sorted({*(marks["m"] or []), *([] if marks["low"] is None else [marks["low"]])})[: ranges + 1] or [0]
    # Bounds in rows of ``step``: a look at each row's first finds the row, a look at the row's bounds the range.
    n, step = len(bounds), max(1, math.isqrt(len(bounds)))
    literal = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<bigint>")
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    row = F.greatest(at_most(literal(bounds[::step])) - 1, F.lit(0))
    rows = F.from_json(F.lit(json.dumps([bounds[i : i + step] for i in range(0, n, step)])), "array<array<bigint>>")
    own = F.greatest(row * step + at_most(F.get(rows, row)) - 1, F.lit(0))
    frame = docs.withColumn("_own", own).withColumn("_first", F.coalesce(F.get(F.get(rows, F.floor(F.col("_own") / step).cast("int")), F.col("_own") % step) == F.col("doc_id"), F.lit(False)))
    home, guest = F.struct(F.col("_own").alias("range"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("_own") - 1, F.lit(n)).alias("range"), F.lit(1).alias("guest"))
    frame = frame.withColumn("_visit", F.explode(F.when(F.col("_first"), F.array(home, guest)).otherwise(F.array(home))))
    frame = frame.select("*", "_visit.range", "_visit.guest").drop("_visit", "_own", "_first")
    order = Window.partitionBy("range").orderBy("guest", "doc_id", *columns)
    after = F.lead(F.struct(*columns)).over(order)
    if marks["low"] is None:  # no row has a doc_id: all are in one range, whose first row follows its last
        after = F.coalesce(after, F.first(F.struct(*columns)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return frame.withColumn("next", after).where(F.col("guest") == 0).drop("range", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its text with the second half taken from the next document, and
    both likenesses.

    Null and empty texts have the empty fingerprint. Rows that repeat a doc_id follow each other by text, each with a row
    of its own, equal ones too; null doc_ids come first. Very long texts are one array of words in one row; an empty table
    gives no rows; columns other than doc_id and text aren't read. Likenesses rest on tuple hashes of 26 bits.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    base = base.withColumn("sig", signature(F.col("text")))
    frame = with_next(base, ["text", "sig"], F.octet_length("text"))
    n = F.length("text")
    half = (n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.col("next")["text"], F.lit(1), half))
    frame = frame.select("doc_id", n.cast("bigint").alias("n_chars"), "sig", F.col("next")["sig"].alias("next_sig"), edited.alias("edited"))
    frame = frame.withColumn("edited_sig", signature(F.col("edited")))
    return frame.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
