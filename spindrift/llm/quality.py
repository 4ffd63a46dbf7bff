"""Quality rules: repetition counts, and how far a document's letters and words are from its language's.

Every language, whatever their number, has two references, counted over all of its
documents: the distribution of character classes and that of its most common words with all other words as one bin. A
document of at least ``min_words`` words is kept when the Jensen-Shannon distance (base 2, 0 to 1) of both its own
histograms stays within the limits. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, run_starts, stored, text_of, words

#: Character classes in the order in which they are counted; each pattern applies to what the earlier ones left.
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("point", r"[.,;:!?'\"()-]+"), ("symbol", r"[\x21-\x7E]+"))
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """``min_words``: shorter documents are not judged by distance; the distances are at most ``chars`` and ``words``; a
    language's common words are its ``common_words`` most frequent ones of up to ``common_chars`` characters, so that a
    reference has a size; a language of fewer than ``reference_words`` words in all is judged by the reference of all
    languages together, as its own would be little more than the document."""

    min_words: int = 50
    reference_words: int = 200
    chars: float = 0.30
    words: float = 0.43
    common_words: int = 40
    common_chars: int = 64


#: References that may be broadcast: so many languages, and so many characters in all of their names.
BROADCAST_LANGUAGES, BROADCAST_NAMES = 2_000, 200_000
#: Languages with more than one of so many documents are dealt to several tasks when references are joined by shuffle.
SHARES = 1_000


def repeated_words(ws: Column, window: int = 8) -> Column:
    """The number of words that stand in a ``window`` of words which the text holds twice or more, the first included."""

    def covered(places: Column) -> Column:
        n = F.size(places)
        steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - F.get(places, i), F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_pairs(s: Column) -> Column:
        twin = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"]),
        )
        return let(F.sort_array(F.transform(twin, lambda i: F.get(s, i)["i"])), covered)

    def of_windows(wins: Column) -> Column:
        pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(wins)) < F.size(wins), let(pairs, of_pairs)).otherwise(F.lit(0))

    def of_hashes(wh: Column) -> Column:
        last = F.size(wh) - window
        wins = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(wh, i + j) for j in range(window)]))
        return F.when(last > 0, let(wins, of_windows)).otherwise(F.lit(0))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of_hashes)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ws (the words), the contract's counts, ``classes`` (characters per class, then others, spaces) and
    ``source_row`` (all columns of ``docs``)."""
    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("source_row"), F.col("doc_id").cast("bigint").alias("doc_id"), language(docs).alias("lang"), text_of().alias("text"))
    frame = frame.withColumn("r0", F.regexp_replace("text", f"[{SPACE}]+", ""))
    for i, (_, pattern) in enumerate(CLASSES):
        frame = frame.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, ""))
    before_symbols = F.col(f"r{len(CLASSES) - 1}")
    length = lambda c: F.length(c).cast("bigint")
    rests = [length(F.col(f"r{i}")) for i in range(len(CLASSES) + 1)]
    classes = [a - b for a, b in zip(rests, rests[1:])] + [rests[-1], length(F.col("text")) - rests[0]]
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return frame.select(
        "doc_id",
        "lang",
        words(F.col("text")).alias("ws"),
        rests[0].alias("word_chars"),
        (length(before_symbols) - length(F.translate(before_symbols, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.array(*classes).alias("classes"),
        "source_row",
    )


def _divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (half(p) + half(q)) / 2


def language(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit(""))


def with_references(frame: DataFrame, refs: DataFrame, docs: DataFrame) -> DataFrame:
    """``frame`` with the reference of its ``lang``. References are broadcast if the counted languages are few; otherwise both
    sides are dealt out by language, and a language with many documents to several tasks, each with a copy of its reference."""
    sizes = docs.select(language(docs).alias("lang")).groupBy("lang").agg(F.count("*").alias("n_docs"))
    few = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("lang")), F.lit(0)).alias("names"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs")).first()
    if few["n"] <= BROADCAST_LANGUAGES and few["names"] <= BROADCAST_NAMES:
        return frame.join(F.broadcast(refs), "lang", "left")
    share = max(1, few["docs"] // SHARES)
    large = sizes.where(F.col("n_docs") > share).select("lang", F.ceil(F.col("n_docs") / share).cast("int").alias("salts"))
    large = F.broadcast(large.where(F.length("lang") <= BROADCAST_NAMES // SHARES))  # SHARES rows of short names at most
    salts = F.coalesce("salts", F.lit(1))
    dealt = frame.join(large, "lang", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.col("ws")), salts).cast("int")).drop("salts")
    copies = refs.join(large, "lang", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies.hint("shuffle_merge"), ["lang", "salt"], "left").drop("salt")


def references(docs: DataFrame, limits: Limits) -> DataFrame:
    """One row per language: class_q, marks (hashes of the common words, ascending, their lowest bit set), marks_q (the
    words' shares, in that order), other_q."""
    slots = len(CLASSES) + 2
    sums = counts(docs).groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(slots)])
    sums = stored(sums, "class-sums")
    each = docs.select(language(docs).alias("lang"), F.explode(words(F.lower(text_of()))).alias("w"))
    seen = stored(each.groupBy("lang", "w").agg(F.count("*").alias("n_w")), "word-counts")
    n = seen.groupBy("lang").agg(F.sum("n_w").alias("n"))
    own = _references(sums, seen, limits)
    enough = n.where(F.col("n") >= limits.reference_words).select("lang")
    few = sums.select("lang").join(enough, "lang", "left_anti")
    if few.isEmpty():
        return own
    together = sums.groupBy(F.lit("").alias("lang")).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(slots)])
    all_words = seen.groupBy(F.lit("").alias("lang"), "w").agg(F.sum("n_w").alias("n_w"))
    whole = _references(together, all_words, limits).drop("lang")
    return own.join(enough, "lang").unionByName(few.crossJoin(F.broadcast(whole)))  # one row


def _references(sums: DataFrame, seen: DataFrame, limits: Limits) -> DataFrame:
    slots = len(CLASSES) + 2
    all_chars = sum((F.col(f"c{i}") for i in range(slots)), F.lit(0))
    total = sums.select("lang", F.array(*[F.col(f"c{i}") / F.greatest(all_chars, F.lit(1)) for i in range(slots)]).alias("class_q"))
    n = seen.groupBy("lang").agg(F.sum("n_w").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_w"), "w"))
    common = seen.where(F.length("w") <= limits.common_chars).withColumn("rank", rank).where(F.col("rank") <= limits.common_words)
    common = common.groupBy("lang").agg(F.collect_list(F.struct(F.xxhash64("w").bitwiseOR(F.lit(1)).alias("h"), "n_w")).alias("top"))
    joined = n.join(common, "lang", "left").withColumn("top", F.array_sort("top"))
    joined = joined.select("lang", F.transform("top", lambda x: x["h"]).alias("marks"), F.transform("top", lambda x: x["n_w"] / F.col("n")).alias("marks_q"))
    joined = total.join(joined, "lang", "left").select("lang", "class_q", F.coalesce("marks", F.array().cast("array<bigint>")).alias("marks"), F.coalesce("marks_q", F.array().cast("array<double>")).alias("marks_q"))
    return joined.withColumn("other_q", F.greatest(F.lit(0.0), 1 - F.aggregate("marks_q", F.lit(0.0), lambda a, x: a + x)))


def class_distance(classes: Column, class_q: Column) -> Column:
    total = F.greatest(F.aggregate(classes, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
    parts = let(total, lambda n: F.zip_with(classes, class_q, lambda c, q: _divergence(c / n, q)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def word_distance(lowered: Column, marks: Column, marks_q: Column, other_q: Column) -> Column:
    """The words' hashes, their lowest bit cleared, are sorted together with the marks: each mark then ends the run of its
    word, whose length is the word's count. Bins that the document lacks add half of their share."""
    hashes = F.transform(lowered, lambda w: F.xxhash64(w).bitwiseAND(F.lit(~1)))

    def of_sorted(s: Column) -> Column:
        n = F.size(s) - F.size(marks)
        last = lambda starts, r: F.coalesce(F.get(starts, r + 1), F.size(s)) - 1
        part = lambda c, q: F.when(c > 0, _divergence(c / n, q) - q / 2).otherwise(0.0)

        def of_starts(starts: Column) -> Column:
            marked = F.transform(starts, lambda a, r: F.when(F.get(s, last(starts, r)).bitwiseAND(F.lit(1)) == 1, last(starts, r) - a))
            return let(F.filter(marked, lambda c: c.isNotNull()), of_counts)

        def of_counts(found: Column) -> Column:
            known = F.aggregate(F.zip_with(found, marks_q, part), F.lit(0.0), lambda a, x: a + x)
            rest = n - F.aggregate(found, F.lit(0), lambda a, x: a + x)
            return let(rest, lambda x: F.sqrt(F.greatest(F.lit(0.0), 0.5 + known + part(x, other_q))))

        return let(run_starts(s, lambda x: x.bitwiseOR(F.lit(1))), of_starts)

    return let(F.sort_array(F.concat(hashes, marks)), of_sorted)


def judge(docs: DataFrame, limits: Limits = Limits(), rows: bool = False) -> DataFrame:
    """One row per document: the counts, base_failed, both distances and the verdict ``kept``.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one, so repeated rows get equal
    verdicts; a null language is one with the empty one; an empty table gives no rows; very long texts are arrays of words
    in one row. Columns other than doc_id, lang and text aren't read, unless
    ``rows`` asks for them in the struct ``source_row``.
    """
    frame = with_references(counts(docs), references(docs, limits), docs)
    n = F.size("ws").cast("bigint")
    frame = frame.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("ws")).cast("bigint").alias("n_repeat_words"),
        class_distance(F.col("classes"), F.col("class_q")).alias("char_distance"),
        F.when(n > 0, word_distance(F.transform("ws", lambda w: F.lower(w)), F.col("marks"), F.col("marks_q"), F.col("other_q"))).otherwise(F.lit(0.0)).alias("word_distance"),
        *(["source_row"] if rows else []),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = (F.col("char_distance") <= limits.chars) & (F.col("word_distance") <= limits.words)
    return frame.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ((F.col("n_words") < limits.min_words) | near)).alias("kept"),
        "char_distance", "word_distance", *(["source_row"] if rows else []),
    )
