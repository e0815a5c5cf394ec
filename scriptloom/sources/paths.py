"""Path patterns and shard lists (driver side; listings go through Spark's file systems)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.storage import with_position


_NUMBERS = re.compile(r"^(?P<head>.*?)\{(?P<first>\d+)\.\.(?P<last>\d+)\}(?P<tail>.*)$", re.S)


def brace_range(pattern: str) -> list[str]:
    """The names that the first {a..b} of a pattern stands for; numbers are as wide as a."""
    parts = _NUMBERS.match(pattern)
    if parts is None:
        return [pattern]
    numbers = range(int(parts["first"]), int(parts["last"]) + 1)
    return [f"{parts['head']}{n:0{len(parts['first'])}d}{parts['tail']}" for n in numbers]


def _found(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in (fs.globStatus(path) or [])]


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths of a pattern: its first {a..b} range in order, else a sorted glob."""
    names = brace_range(pattern)
    if len(names) > 1:
        return [p for n in names for p in _found(spark, n)]
    return sorted(_found(spark, pattern))


def expand_all(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Sorted distinct paths of several patterns."""
    return sorted({p for x in patterns for p in expand(spark, x)})


def shard_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, path) of a list file: one path a line; blank lines and # comments do not count."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "path"))
    lines = lines.select("line", F.trim("path").alias("path")).where((F.col("path") != "") & ~F.startswith("path", F.lit("#")))
    return with_position(lines, "line").select("position", "path")


def write_shard_list(paths: list[str], spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([(p,) for p in paths], "value string").coalesce(1).write.mode("overwrite").text(folder)
