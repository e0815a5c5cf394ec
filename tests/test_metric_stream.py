"""The collector as a stream against the batch fold."""

import datetime as dt
import random

import pytest

from scriptloom.operators import metrics
from scriptloom.streaming import metric_log

FAMILIES = {"loss": ("mean", ("train", "eval"), 2), "tokens": ("sum", ("train",), 1), "logit": ("max", ("train", "eval"), 3), "grad": ("norm", ("train",), 1), "rate": ("last", ("train",), 5)}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "id long, ts timestamp, step int, phase string, name string, value double"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def test_late_and_repeated_rows_equal_the_batch(spark, rocks, tmp_path):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for step in range(40):
        for k in range(12):
            ts = start + dt.timedelta(seconds=60 * step + 4 * k)
            rows.append((len(rows), ts, step, rng.choice(["train", "train", "eval"]), rng.choice([*FAMILIES, "stray"]), rng.choice([None, rng.uniform(-9, 9)])))
    arriving = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.choice([0, 0, 0, 200, 400])), r[0]))  # late by up to 400 s
    arriving += [(10**6, start + dt.timedelta(days=1), 0, "train", "stray", 1.0)]  # the watermark passes all
    for i, at in enumerate(range(0, len(arriving), 80)):
        part = arriving[at : at + 80] + rng.sample(arriving[max(0, at - 20) : at + 1], 1)  # and one of before again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"{i:03d}"))
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    stream = metric_log.collected_stream(log, FAMILIES, delay="10 minutes", row_id="id")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.phase, r.step, r.name): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = metrics.collected(spark.createDataFrame(rows, SCHEMA).where("value is not null"), FAMILIES)
    want = {(r.phase, r.step, r.name): r.value for r in batch.collect()}
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)  # each step once


def test_other_state_stores_are_refused(spark, tmp_path):
    log = spark.readStream.schema(SCHEMA).json(str(tmp_path))
    with pytest.raises(ValueError, match="RocksDB"):
        metric_log.collected_stream(log, FAMILIES)
