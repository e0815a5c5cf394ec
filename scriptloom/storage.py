"""Tables in the folder that driver and executors share, and positions in a global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir. Where that is unset, a local session (tests) gets
    a temporary folder; on a cluster that would be no shared one, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/scriptloom/{uuid.uuid4().hex}"


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end: for work whose results are
    collected or written elsewhere by then. May be nested."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table: lineage ends, nothing is computed again. The table
    stays, unless ``scratch`` deletes it."""
    path = shared_folder(df.sparkSession)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LOW = (1 << 33) - 1


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with its 0-based place in a global order, without a single-task window: a
    range exchange sorts, each task numbers its rows, and the tasks' counts (one number
    a task) give the offsets."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    starts, total = {}, 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts[r["part"]], total = total, total + r["count"]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    first = df.sparkSession.createDataFrame(list(starts.items()), "_p long, _s long")  # one row a task
    joined = rows.withColumn("_p", part).join(F.broadcast(first), "_p")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_s") + F.col("_m").bitwiseAND(_LOW)).alias(name))


#: Bytes of values that a broadcast may hold.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` from a written table, with a broadcast hint if the bytes of its values allow
    it, else without, so that a join shuffles both sides."""
    rows = written(df)
    row = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in rows.columns), F.lit(16))
    size = rows.agg(F.sum(row).alias("size")).first().size or 0
    return F.broadcast(rows) if size <= (BROADCAST_BYTES if most is None else most) else rows
