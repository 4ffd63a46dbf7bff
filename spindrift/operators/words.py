"""Texts as weights over a vocabulary's features. The vocabulary (word, prime, weight) is a table of the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.lineage import kept
from spindrift.operators.search import pair_with

#: Unicode's white space, as a character class body of Java's and RE2's patterns.
WHITE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Rows of a vocabulary that may be broadcast; a larger one meets the words by a shuffle of counts.
BROADCAST_WORDS = 200_000

#: Primes that texts may have as columns, for products without a join.
COLUMNS = 32


def _words(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, word: a row for each occurrence of a word. What isn't a letter goes from the whole text at once."""
    letters = F.regexp_replace(F.lower(text), rf"[^\p{{L}}{WHITE}]+", "")
    return texts.select(*keys, F.explode_outer(F.split(letters, f"[{WHITE}]+")).alias("word")).where("word <> ''")


def word_counts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, word, n: words in small letters, without what isn't a letter; a null text has none. Counted per task before
    the shuffle."""
    return _words(texts, keys, text).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def tag_vocabulary(texts: DataFrame, tag: str, text: str = "text", least: int = 1) -> DataFrame:
    """A vocabulary from tagged texts: word, prime (a tag), weight: which tenths of the word's occurrences the tag has, at
    least ``least`` of them. Texts without a tag don't count."""
    n = word_counts(texts.where(F.col(tag).isNotNull()), [tag], text)
    of_word = n.groupBy("word").agg(F.sum("n").alias("all"))
    weight = F.floor(10 * F.col("n") / F.col("all")).cast("bigint")
    return n.join(of_word, "word").select("word", F.col(tag).alias("prime"), weight.alias("weight")).where(F.col("weight") >= least)


def lookup(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Rows of ``words`` with the primes and weights of their word, in any case; unknown words have no row."""
    known = vocabulary.select(F.col("word").alias("_word"), "prime", "weight")
    known = F.broadcast(known) if known.count() <= BROADCAST_WORDS else known
    return words.join(known, F.lower(word) == F.col("_word")).drop("_word")


def decompose(texts: DataFrame, vocabulary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, prime, weight, share: the weights of a text's words per prime, and their share of all of the text's weights.
    Texts without a known word have no row. Words meet a small vocabulary as they stand, a larger one by counts."""
    known = kept(vocabulary.select("word", "prime", "weight"))
    if known.count() <= BROADCAST_WORDS:
        found = _words(texts, [key], text).join(F.broadcast(known), "word").withColumn("n", F.lit(1).cast("bigint"))
    else:
        found = word_counts(texts, [key], text).join(known, "word")
    by_prime = found.groupBy(key, "prime").agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))
    return by_prime.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(key)))


def dominant(decomposed: DataFrame, primes: int) -> DataFrame:
    """Rows whose share is above an even one among ``primes``."""
    return decomposed.where(F.col("share") > 1.0 / primes)


def _norms(decomposed: DataFrame, key: str) -> DataFrame:
    w = F.col("weight").cast("double")
    return decomposed.groupBy(key).agg(F.sqrt(F.sum(w * w)).alias("norm"))


def _columns(decomposed: DataFrame, key: str, primes: list[str], mark: str) -> DataFrame:
    """A row per text: its weights as a column per prime (null: none), and their norm."""
    w = [F.sum(F.when(F.col("prime") == p, F.col("weight").cast("double"))).alias(f"{mark}{i}") for i, p in enumerate(primes)]
    squares = F.sum(F.col("weight").cast("double") * F.col("weight"))
    return decomposed.groupBy(key).agg(*w, F.sqrt(squares).alias(f"{mark}_norm"))


def similarity(base: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query, key, cosine of the weights, for all that share a prime (0 for the others, which have no row).

    ``queries`` are decomposed texts too. Where the queries have up to COLUMNS primes, texts carry a column for each and
    products are made where a text meets a query, without a shuffle of pairs. Otherwise Spark pairs them by the prime, and
    sums the products per pair."""
    primes = sorted(r[0] for r in queries.select("prime").distinct().limit(COLUMNS + 1).collect())
    if 0 < len(primes) <= COLUMNS:
        asked = kept(_columns(queries, key, primes, "_q").withColumnRenamed(key, "query"))
        pairs = pair_with(kept(_columns(base, key, primes, "_w")), asked)
        products = [F.col(f"_w{i}") * F.col(f"_q{i}") for i in range(len(primes))]
        dot = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in products])
        shared = reduce(lambda a, b: a | b, [p.isNotNull() for p in products])
        return pairs.where(shared).select("query", key, (dot / (F.col("_w_norm") * F.col("_q_norm"))).alias("similarity"))
    q = queries.select(F.col(key).alias("query"), F.col("prime"), F.col("weight").cast("double").alias("_q"))
    products = base.select(key, "prime", F.col("weight").cast("double").alias("_w")).join(q, "prime")
    dots = products.groupBy("query", key).agg(F.sum(F.col("_w") * F.col("_q")).alias("dot"))
    of_query = _norms(queries, key).select(F.col(key).alias("query"), F.col("norm").alias("_nq"))
    joined = dots.join(_norms(base, key), key).join(of_query, "query")
    return joined.select("query", key, (F.col("dot") / (F.col("norm") * F.col("_nq"))).alias("similarity"))


def _pattern(prime: Column, seed: int) -> Column:
    return F.xxhash64(prime, F.lit(seed))


def fingerprint(decomposed: DataFrame, key: str, words: int = 16) -> DataFrame:
    """key, fp: 64 x ``words`` bits, the exclusive or of the patterns of the primes with half the largest weight or more."""
    top = F.max("weight").over(Window.partitionBy(key))
    strong = decomposed.withColumn("_top", top).where(2 * F.col("weight") >= F.col("_top"))
    folds = [F.bit_xor(_pattern(F.col("prime").cast("string"), i)).alias(f"f{i}") for i in range(words)]
    return strong.groupBy(key).agg(*folds).select(key, F.array(*[f"f{i}" for i in range(words)]).alias("fp"))
