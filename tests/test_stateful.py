"""Stateful streams against their batch twins, over several triggers and a restart from the checkpoint."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.streaming import stateful

SCHEMA = "key string, ts timestamp, seq bigint, value double, print bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _parts():
    rnd = np.random.default_rng(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", start + datetime.timedelta(minutes=i), i, float(rnd.random() if i < 60 else 40 + rnd.random()), int(rnd.integers(0, 256))) for i in range(120)]
    return [rows[:50], rows[50:80], rows[80:]]


def _drain(spark, build, parts, folder, mode):
    """Three triggers, each in a query of its own that goes on from the checkpoint of the one before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = build(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"))
        query = out.writeStream.outputMode(mode).foreachBatch(lambda b, n, i=i: b.write.parquet(f"{folder}/out/part={i}-{n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("part")


def _same(found, twin):
    plain = lambda f: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.select(*sorted(twin.columns)).collect()), key=repr)
    assert plain(found) == plain(twin)


@pytest.mark.parametrize("name", ["beliefs", "iterations", "recalibration"])
def test_equals_the_twin_over_restarts(spark, tmp_path, name):
    build, twin = {
        "beliefs": (stateful.update_beliefs, lambda t: stateful.beliefs_twin(t)),
        "iterations": (stateful.record_iterations, stateful.iterations_twin),
        "recalibration": (lambda s: stateful.recalibrate(s, 7), lambda t: stateful.recalibration_twin(t, 7)),
    }[name]
    parts = _parts()
    if name == "beliefs":
        parts = [[(k, t, s, min(v, 1.0), p) for k, t, s, v, p in part] for part in parts]
    found = _drain(spark, build, parts, str(tmp_path), "update")
    want = twin(spark.createDataFrame([r for part in parts for r in part], SCHEMA))
    assert found.count() == 120
    _same(found, want)
    if name == "recalibration":
        assert want.where("alert").count() > 0 and want.select("threshold").distinct().count() > 1


def test_crystallization_freezes_by_a_timer(spark, tmp_path):
    parts = _parts()
    rows = spark.createDataFrame([r for part in parts for r in part], SCHEMA)
    found = _drain(spark, lambda s: stateful.crystallize(s, 8, 20, 600_000), parts, str(tmp_path), "append")
    want = stateful.crystallize_twin(rows, 8, 20, 600_000)
    assert want.where("gate = 'Freeze'").count() == 3
    _same(found, want)
    assert stateful.crystallize_twin(rows, 8, 41, 600_000).count() == 0
    assert stateful.crystallize_twin(rows.where(F.col("seq") < 0), 8, 20, 1).count() == 0
