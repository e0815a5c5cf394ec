"""Streams: metric logs folded by step, and request results collected as they arrive."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptloom.sources.tables import RESPONSES


def flushed_stream(log: DataFrame, period: int, always: str = "eval", delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Streaming (phase, step, window, n, mean) of the steps that emit, from rows (ts,
    step, phase, value). A step's rows lie near in time: state for a step goes once the
    watermark has passed its window, so state is bounded by the delay."""
    emits = (F.col("step") % period == 0) | (F.col("phase") == always)
    return (
        log.withWatermark("ts", delay)
        .where(emits)
        .groupBy(F.window("ts", window), "phase", "step")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    )


STEP_STATE = "n long, total double, most double, squares double, last_at long, last double, due long"
COLLECTED = "phase string, step long, name string, value double"


class _Family(StatefulProcessor):
    """The open steps of one metric in one phase. A step's first row sets a timer; when the
    watermark passes it, the step's value is emitted and its state goes."""

    def __init__(self, kinds: dict[str, str], span_ms: int):
        self.kinds, self.span = kinds, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step long", STEP_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for step, of in batch.groupby("step"):
                step, values = int(step), of["value"].astype(float)
                at = of["ts"].astype("datetime64[ms]").astype("int64")
                newest = at.to_numpy().argmax()
                n, total, most, squares, last_at, last = len(of), values.sum(), values.max(), (values * values).sum(), int(at.iloc[newest]), float(values.iloc[newest])
                due = int(at.min()) + self.span
                held = self.steps.getValue((step,)) if self.steps.containsKey((step,)) else None
                if held:
                    n, total, most, squares = n + held[0], total + held[1], max(most, held[2]), squares + held[3]
                    if held[4] > last_at:
                        last_at, last = held[4], held[5]
                    due = min(due, held[6])
                self.steps.updateValue((step,), (n, float(total), float(most), float(squares), last_at, last, due))
                self.handle.registerTimer(due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        done = [(k[0], v) for k, v in self.steps.iterator() if v[6] <= now]
        rows = []
        for step, (n, total, most, squares, _, last, _) in done:
            self.steps.removeKey((step,))
            value = {"mean": total / n, "sum": total, "max": most, "norm": squares**0.5, "last": last}[self.kinds[key[1]]]
            rows.append((key[0], step, key[1], value))
        yield pd.DataFrame(rows, columns=["phase", "step", "name", "value"])


def collected_stream(log: DataFrame, families: dict[str, tuple[str, tuple[str, ...], int]], always: str = "eval", delay: str = "10 minutes", span_ms: int = 60_000, row_id: str | None = None) -> DataFrame:
    """``metrics.collected`` of a stream (ts, step, phase, name, value): each metric folded as its
    family says, one value a step, emitted once the watermark has passed ``span_ms`` after the
    step's first row. So rows may be late by ``delay`` and a step may take that span; rows that
    are later are dropped. With ``row_id`` rows that come again within the delay count once.

    State is kept for each metric and phase: its open steps. It needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    provider = log.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if "RocksDB" not in provider:
        raise ValueError("collected_stream needs spark.sql.streaming.stateStore.providerClass to name the RocksDB provider")
    rows = log.withWatermark("ts", delay)
    if row_id:
        rows = rows.dropDuplicatesWithinWatermark([row_id])
    routed = F.lit(False)
    for name, (_, phases, period) in families.items():
        routed = routed | ((F.col("name") == name) & F.col("phase").isin(*phases) & ((F.col("phase") == always) | (F.col("step") % period == 0)))
    kept = rows.where(routed & F.col("value").isNotNull()).select("ts", F.col("step").cast("long").alias("step"), "phase", "name", F.col("value").cast("double").alias("value"))
    fold = _Family({name: kind for name, (kind, _, _) in families.items()}, span_ms)
    return kept.groupBy("phase", "name").transformWithStateInPandas(fold, COLLECTED, "Append", "EventTime")


def collect_responses(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Append new response files of a folder to a Parquet table, each once; ends when
    there are no more. Run again to poll."""
    stream = spark.readStream.schema(RESPONSES).option("multiLine", True).json(folder)
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_states(requests: DataFrame, table: str) -> DataFrame:
    """(batch, requests, collected, state) of requests (batch, custom_id) against the responses
    that ``collect_responses`` wrote: a batch has 'ended' once each of its requests has a
    response, whatever its outcome; else it is 'in_progress'. A response that came twice counts
    once; responses to other requests and requests without an id do not count."""
    answered = requests.sparkSession.read.schema(RESPONSES).parquet(table).select("custom_id").distinct()
    asked = requests.select("batch", "custom_id").distinct()
    counted = asked.join(answered.withColumn("_a", F.lit(1)), "custom_id", "left").groupBy("batch")
    rows = counted.agg(F.count("custom_id").alias("requests"), F.count("_a").alias("collected"))
    return rows.withColumn("state", F.when(F.col("requests") == F.col("collected"), "ended").otherwise("in_progress"))


def collect_until_ended(
    requests: DataFrame, folder: str, table: str, checkpoint: str, interval_s: float = 60.0, limit_s: float | None = None, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Collects responses run by run until all batches have ended, or no more than ``limit_s``
    seconds; returns their ``batch_states``. What came is in the table after each run, so a call
    that was interrupted is simply made again and goes on where it stopped."""
    spark = requests.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)  # readable before the first response
    end = None if limit_s is None else time.monotonic() + limit_s
    while True:
        collect_responses(spark, folder, table, checkpoint)
        states = batch_states(requests, table)
        if states.where(F.col("state") != "ended").isEmpty() or (end is not None and time.monotonic() + interval_s > end):
            return states
        sleep(interval_s)
