"""The separator scan against a plain walk over the same files."""

import numpy as np
import public_tokenizers
import pytest
from spindrift.llm import bpe, token_files


@pytest.mark.parametrize("block", [2, 6, 64, 4096])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rnd = np.random.default_rng(block)
    expected = []
    for name in ("a", "b", "c", "d"):
        ids = rnd.integers(0, 4 if name != "b" else 900, 700).astype("<u2")
        if name == "a":
            ids[-1] = 0
        if name == "d":
            ids = ids[:0]
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        start, ordinal = 0, 0
        for i in np.flatnonzero(ids == 0).tolist():
            expected.append((f"{name}.bin", ordinal, start, i - start, True))
            start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            expected.append((f"{name}.bin", ordinal, start, len(ids) - start, False))
    found = token_files.token_counts(spark, f"file://{tmp_path}", 0, block).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_written_counts(request, spark, tmp_path, which):
    import tiktoken

    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(frame.repartition(3), folder, path, public_tokenizers.PATTERN, 50256)
    counts = token_files.token_counts(spark, folder, 50256, 512).join(manifest, ["file", "ordinal"], "full")
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == {k: len(library.encode_ordinary(t or "")) for k, t in rows}
