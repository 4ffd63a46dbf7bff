"""Files of codes: round trips, pieces, blocks, failures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.sources import codes


def _rows(n, tensors=("a", "b#7", "ü/c")):
    rnd = np.random.default_rng(1)
    return [(t, "norm" if t == "a" else "attention", 64, i, [int(x) for x in rnd.integers(-32768, 32768, 17)]) for t in tensors for i in range(n)]


def test_container_round_trip(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/c", _rows(60)
    frame = spark.createDataFrame(rows, codes.SCHEMAS["container"])
    codes.write_codes(frame, folder, tasks=5)
    assert len(os.listdir(tmp_path / "c")) > 1 and not any(x.startswith("_") for x in os.listdir(tmp_path / "c"))
    back = codes.read_codes(spark, folder, block=7)
    assert back.rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    codes.write_codes(frame.where("row < 3"), folder)  # overwrites
    assert codes.read_codes(spark, folder).count() == 9
    codes.write_codes(frame.where("row < 0"), f"file://{tmp_path}/none")
    assert codes.read_codes(spark, f"file://{tmp_path}/none").count() == 0


def test_cache_round_trip(spark, tmp_path):
    rows = [(r[3], r[4]) for r in _rows(100, ("a",))]
    codes.write_codes(spark.createDataFrame(rows, codes.SCHEMAS["cache"]), f"file://{tmp_path}/c", "cache", tasks=3)
    assert sorted(tuple(r) for r in codes.read_codes(spark, f"file://{tmp_path}/c", "cache", block=9).collect()) == rows


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    frame = spark.createDataFrame(_rows(40), codes.SCHEMAS["container"]).withColumn("n_cols", F.when(F.col("row") == 39, F.raise_error(F.lit("stop"))).otherwise(F.col("n_cols")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        codes.write_codes(frame, f"file://{tmp_path}/c", tasks=4)
    assert not os.path.exists(tmp_path / "c") or os.listdir(tmp_path / "c") == []


def test_bytes_of_a_container(spark, tmp_path):
    """Header and codes as the format has them; other files are refused."""
    codes.write_codes(spark.createDataFrame([("t", "conv2d", 9, 0, list(range(17)))], codes.SCHEMAS["container"]), f"file://{tmp_path}/c", tasks=1)
    (name,) = os.listdir(tmp_path / "c")
    raw = (tmp_path / "c" / name).read_bytes()
    assert raw == b"BGZ7" + b"\x01\0\0\0" + b"\x01\0\0\0t" + b"\x02" + b"\x01\0\0\0" + b"\x09\0\0\0" + np.arange(17, dtype="<i2").tobytes()
    (tmp_path / "c" / name).write_bytes(b"GGUF" + raw[4:])
    with pytest.raises(Exception, match="not a container"):
        codes.read_codes(spark, f"file://{tmp_path}/c").collect()


def test_palettes_and_layers():
    rnd = np.random.default_rng(2)
    c, a = rnd.integers(-32768, 32768, (256, 17)), rnd.integers(0, 256, 1000)
    found, entries, gaps = codes.palette_of(codes.palette_bytes(c, a))
    assert (found == c).all() and (entries == a).all() and gaps.shape == (256, 256) and gaps.max() == 65535 and (np.diag(gaps) == 0).all()
    words = rnd.integers(0, 2**63, (8, 64)).astype(np.uint64)
    raw = codes.layers_bytes(words, 3)
    back, style = codes.layers_of(raw)
    assert len(raw) == 4101 and (back == words).all() and style == 3
    for bad in (raw[:-1], b"PAL9" + raw[4:]):
        with pytest.raises(ValueError):
            codes.layers_of(bad)
    with pytest.raises(ValueError):
        codes.palette_of(codes.palette_bytes(c, a)[:-1])


def test_tensors_indexed_in_blocks(spark, tmp_path):
    from spindrift.sources import tensors

    rnd = np.random.default_rng(3)
    rows = [(n, i, [float(x) for x in rnd.normal(size=40)]) for n, k in (("blk.0.attn_q.weight", 9), ("blk.0.ffn_up.weight", 5), ("token_embd.weight", 3)) for i in range(k)]
    tensors.write_safetensors(spark.createDataFrame(rows, "name string, row bigint, v array<double>"), f"file://{tmp_path}/m")
    found = {r["tensor"]: (r["layer"], r["n_rows"], r["n_cols"], r["bytes_before"], r["bytes_after"]) for r in codes.index_tensors(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/c").collect()}
    assert found == {"blk.0.attn_q.weight": ("attention", 9, 40, 1440, 306), "blk.0.ffn_up.weight": ("feed_forward", 5, 40, 800, 170), "token_embd.weight": ("embedding", 3, 40, 480, 102)}
    got = {(r["tensor"], r["row"]): r["code"] for r in codes.read_codes(spark, f"file://{tmp_path}/c").collect()}
    for name, i, v in rows:
        x = np.asarray(v, np.float32).astype(float)
        want = [x[[j for j in range(40) if j % 17 == b * 11 % 17]].mean() * 256 for b in range(17)]
        assert all(abs(a - b) <= 0.5001 for a, b in zip(got[name, i], want))
