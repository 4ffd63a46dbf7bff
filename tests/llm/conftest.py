import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated texts, and columns whose names clash with the operators' own."""
    long_text = "alpha beta gamma delta epsilon zeta eta theta iota kappa.\n" * 400
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "one", "en", "s", 3),
        (5, long_text, "en", "s", 1), (6, long_text, "en", "s", 1), (7, "Ünï cödé ✓ 漢字 \U0001f600 " * 30, "de", None, 7),
        (8, "x" * 5000, None, "s", 5000), (9, "a b c d e f g h i j k l m n o p q r s t u v", "en", "s", 9),
        (10, "a b c d e f g h i j k l m n o p q r s t u v", "en", "s", 9),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    for name in ("pos", "gram", "ids", "n_words", "key", "line", "hash", "_uid", "u1", "r1", "_t", "_row", "source_row", "range", "guest", "next", "sig", "h", "removed"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.orderBy("doc_id").collect()]
