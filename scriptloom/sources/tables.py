"""Readers and writers of transcripts, labels, manifests, responses and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.text import key_parts
from scriptloom.sources.heads import heads

LABELS = "key string, unformatted string, formatted string, validation string, attempts int"
MANIFEST = "key string, split string, shard string, duration_s double, n_mel_frames int, unformatted string, formatted string"
RESPONSES = "custom_id string, stop_reason string, text string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
_FILE = "_metadata.file_path"


def transcripts(spark: SparkSession, root: str, keep_empty: bool = False) -> DataFrame:
    """(key, chapter, utt, path, text) of all *.trans.txt below a folder: a line is a key,
    a space and the text; blank lines do not count, empty texts only if kept."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(root)
    rows = read.select(F.trim("value").alias("line"), F.col(_FILE).alias("file")).where(F.col("line") != "")
    parts = rows.select(key_parts(F.col("line")).alias("p"), "file").select("p.key", "p.text", "file")
    rows = parts.select(
        "key",
        F.regexp_extract("file", r"([^/]+)\.trans\.txt$", 1).alias("chapter"),
        F.regexp_extract("key", r"(\d+)\D*$", 1).alias("utt"),
        F.concat(F.regexp_extract("file", r"^(.*)/", 1), F.lit("/"), "key", F.lit(".flac")).alias("path"),
        "text",
    )
    return rows if keep_empty else rows.where(F.col("text") != "")


def with_audio(rows: DataFrame, root: str) -> DataFrame:
    """Transcript rows whose audio file exists. Only the listing is read, no content."""
    spark = rows.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.flac").load(root).select("path")
    return rows.join(files.distinct(), "path", "left_semi")


def chapters(rows: DataFrame) -> DataFrame:
    """(chapter, utterances array<struct<key, text>>), texts lower case, in key order."""
    pair = F.struct("key", F.lower("text").alias("text"))
    return rows.groupBy("chapter").agg(F.array_sort(F.collect_list(pair)).alias("utterances"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with ``line``, a text that sorts in file order: file, start of the split, number in
    it. Nothing is exchanged for it. A missing validation stays null, which means ok."""
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    place = F.concat_ws("\x01", F.col(_FILE), number(F.col("_metadata.file_block_start")), number(F.monotonically_increasing_id()))
    return spark.read.schema(LABELS).json(path).withColumn("line", place)


def write_labels(rows: DataFrame, folder: str) -> None:
    rows.orderBy("key").write.mode("overwrite").option("ignoreNullFields", True).json(folder)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file a request; files may come in any order."""
    return spark.read.schema(RESPONSES).option("multiLine", True).json(folder)


def write_results(rows: DataFrame, path: str) -> None:
    """CSV or JSON by the path's ending."""
    writer = rows.coalesce(1).write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, md5, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def flac_seconds(spark: SparkSession, root: str) -> DataFrame:
    """(path, seconds) from the stream-info header, the first 42 bytes: 20 bits of rate, 36 bits
    of samples."""
    files = heads(spark, root, 42, ".flac")
    head = F.hex(F.substring("head", 19, 8))
    number = lambda h: F.conv(h, 16, 10).cast("long")
    rate, samples = number(F.substring(head, 1, 5)), number(F.substring(head, 8, 9))
    ok = F.hex(F.substring("head", 1, 4)) == "664C6143"
    return files.select("path", F.when(ok & (rate > 0), samples / rate).alias("seconds"))
