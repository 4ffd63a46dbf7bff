"""The pipeline's stages against plain Python, each on its own input."""

import re

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from spindrift.llm import secret_scan
from test_corpus_ops import _deduped

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_stages(request, spark, which):
    docs = request.getfixturevalue(which).select(*corpus_pipeline.COLUMNS)
    if which == "odd":
        copy = docs.where("doc_id in (5, 9)").withColumn("doc_id", F.col("doc_id") + 100)
        docs = docs.union(copy)
    docs = docs.persist()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == corpus_pipeline.COLUMNS and dict(after.dtypes) == dict(docs.dtypes)
        after = after.persist()
        got = {r["doc_id"]: r for r in after.collect()}
        if name == "quality rules":
            assert all(got[k]["text"] == before[k] for k in got)
            for k in set(before) - set(got):
                n, *_, repeated = brute.quality(before[k])
                assert n < 20 or 100 * repeated > 30 * n or n >= 50
        elif name == "line dedup":
            expected = _deduped(sorted(before.items()))
            left = {k: t for k, (t, gone) in expected.items() if not (gone and not brute.WS.search(t or ""))}
            assert {k: r["text"] for k, r in got.items()} == left
        elif name.startswith("n-gram"):
            groups = brute.jaccard_components(sorted(before.items()))
            assert set(got) == {k for k, (_, c) in groups.items() if c == k}
        else:
            assert set(got) == set(before)
            for k, r in got.items():
                spans = secret_scan.pattern_spans(before[k] or "") + secret_scan.structural_spans(before[k] or "")
                assert ("[SECRET]" in (r["text"] or "")) >= bool(spans) and not re.search("AKIA[A-Z0-9]{14}", r["text"] or "")
        docs = after


def test_run_covers_what_is_left(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and max(p["offset"] + p["length"] for p in pieces) <= 4096
