"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\\x20\\x09-\\x0D"


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are deleted at the end. Only for work
    whose results are written by then, as ``Stored(..., keep=True)``."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            remove(spark, path)


def shared_dir(spark: SparkSession, keep: bool = False) -> str:
    """A new folder name below the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset in a local
    session, as in tests, is a temporary folder set instead; elsewhere it raises, for
    executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptloom-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/scriptloom/{uuid.uuid4().hex}"
    if not keep and (made := _SCRATCH.get()) is not None:
        made.append(path)
    return path


class Stored:
    """A DataFrame written as Parquet to the shared folder: its lineage ends there,
    so a lost executor costs a read, not a recomputation. ``per_file``: the most rows of
    a file, for tables of few but large rows, which a reader would else hold by the file."""

    def __init__(self, df: DataFrame, codec: str = "snappy", keep: bool = False, per_file: int | None = None):
        self.spark = df.sparkSession
        self.path = shared_dir(self.spark, keep)
        writer = df.write.option("compression", codec)
        (writer.option("maxRecordsPerFile", per_file) if per_file else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no later plan reads."""
        remove(self.spark, self.path)


def store(df: DataFrame, codec: str = "snappy", per_file: int | None = None) -> DataFrame:
    return Stored(df, codec, per_file=per_file).df


#: Bytes of values that a broadcast may hold.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame) -> DataFrame:
    """A stored table, with a broadcast hint if the bytes of its values allow it; else joins
    shuffle it."""
    row = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(16))
    size = df.agg(F.sum(row).alias("size")).first().size or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def lowered(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Lower-cased words [^\\x20\\x09-\\x0D]+ of a text, as an array; null text: none."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), f"[{SPACES}]+"), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """The same words in Python: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id's decimal text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def pieces(batches: Iterable[pa.RecordBatch], text_at: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about max_bytes of text, to bound a worker's memory."""
    for b in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_pylist()):
            size += n
            if size >= max_bytes:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many texts to a Python worker at once, to bound its memory; the
    session's own setting stays if it is smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of several runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def parts(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
