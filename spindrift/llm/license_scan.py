"""Licence scan by diagonal voting, in DataFrame functions alone.

All rolling word k-grams of the documents are joined with the positions of the templates' k-grams. A hit votes for the
diagonal (text position minus template position); votes of a template on neighbouring diagonals of a document are merged, from
each diagonal on that has any, and merged spans are verified by the share of the template's k-grams that they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, text_of

K = 3
#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening passages of public licences, and their labels.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike", "cc-by-sa"),
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def licence_words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters. A-Z count as a-z; words with other letters are left as they are,
    for no template holds one."""
    return F.filter(F.split(text, _SEPARATORS), lambda w: w != "")


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(w)))


def kgrams(ws: Column, k: int = K) -> Column:
    """Hashes of the k-grams in text order."""

    def of_hashes(wh: Column) -> Column:
        last = F.size(wh) - k
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(wh, i + j) for j in range(k)]))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>"))

    return let(_hashes(ws), of_hashes)


def templates(spark: SparkSession) -> DataFrame:
    """gram, template, label, is_phrase, tpos, n_grams: a few hundred rows, fixed by PHRASES and PASSAGES."""
    rows = [(i, text, label, i < len(PHRASES)) for i, (text, label) in enumerate(PHRASES + PASSAGES)]
    frame = spark.createDataFrame(rows, "template int, text string, label string, is_phrase boolean")
    frame = frame.withColumn("grams", kgrams(licence_words(F.col("text"))))
    return frame.select("template", "label", "is_phrase", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("tpos", "gram"))


def licence_spans(docs: DataFrame, min_share: float = 0.6) -> DataFrame:
    """One row per verified span: doc_id, row (a hash of the text), label, is_phrase, start, end (words), share.

    A phrase needs all of its k-grams on one diagonal; a passage ``min_share`` of them on diagonals that lie within its
    length of each other, and its span is at most twice its length. Null and empty texts have no spans; a text that occurs
    twice under one doc_id has its spans once.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    grams = text.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(kgrams(licence_words(F.col("text")))).alias("pos", "gram"))
    hits = grams.join(F.broadcast(templates(spark)), "gram")
    votes = hits.groupBy("doc_id", "row", "template", "label", "is_phrase", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("found"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    phrases = votes.where(F.col("is_phrase") & (F.size("found") == F.col("n_grams")))
    phrases = phrases.select("doc_id", "row", "label", "is_phrase", F.col("low").alias("start"), "high", F.lit(1.0).alias("share"))
    # A passage may begin at any diagonal: what follows within the template's length belongs to it, so that hits before it
    # can't stretch its span. Of the windows that begin near each other the fullest stays, of these the shortest, first one.
    by, unit = Window.partitionBy("doc_id", "row", "template"), 1_000
    scaled = lambda c: F.floor(c * unit / F.col("n_grams"))
    ahead = by.orderBy(scaled(F.col("diagonal"))).rangeBetween(0, unit)
    windows = votes.where(~F.col("is_phrase")).select(
        "doc_id", "row", "template", "label", "is_phrase", "n_grams",
        F.min("low").over(ahead).alias("start"), F.max("high").over(ahead).alias("high"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("found").over(ahead)))) / F.col("n_grams")).alias("share"),
    ).where((F.col("share") >= min_share) & (F.col("high") - F.col("start") <= 2 * F.col("n_grams"))).distinct()
    rank = F.struct("share", (F.col("start") - F.col("high")).alias("short"), (-F.col("start")).alias("first"))
    near = by.orderBy(scaled(F.col("start"))).rangeBetween(-unit, unit)
    best = windows.withColumn("rank", rank).withColumn("best", F.max("rank").over(near)).where(F.col("rank") == F.col("best"))
    spans = phrases.unionByName(best.select("doc_id", "row", "label", "is_phrase", "start", "high", "share"))
    return spans.select("doc_id", "row", "label", "is_phrase", F.col("start").cast("bigint").alias("start"), (F.col("high") + K).cast("bigint").alias("end"), "share")


def licence_labels(docs: DataFrame, min_share: float = 0.6) -> DataFrame:
    """One row per document: its words, places of phrases and labels; ``score`` is the best span's share, 0 without one.

    Null and empty texts have no words and no labels; rows that repeat a doc_id, or have none, each get a row by their own
    text; very long texts are arrays of words in one row; an empty table gives no rows; columns other than doc_id and text
    aren't read.
    """
    spans = licence_spans(docs, min_share)
    phrase = F.col("is_phrase")
    found = spans.groupBy("doc_id", "row").agg(
        F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = text.select("doc_id", F.xxhash64("text").alias("row"), F.size(licence_words(F.col("text"))).cast("bigint").alias("n_words"))
    found = found.withColumnRenamed("doc_id", "of_doc").withColumnRenamed("row", "of_row")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
