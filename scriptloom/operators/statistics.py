"""Corpus statistics that grow with the corpus.

Counts are additive, so a shard is counted once and its counts are kept: a folder of
Parquet tables partitioned by shard, with rows (kind, prev, token, n). Adding shards reads
only these; baselines, document frequencies and vocabularies of all shards come from the
counts. A shard that is counted again replaces its counts, so a run that broke off is
repeated without harm. Utterances must not be split over shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.operators import corpus
from scriptloom.storage import written

COUNTS = "kind string, prev string, token string, n long, shard string"


def shard_counts(words: DataFrame) -> DataFrame:
    """(kind, prev, token, n, shard) of rows (shard, key, words), in one pass over them: an
    utterance gives its tokens, its neighbours, its first token, its distinct tokens and
    itself."""
    w, none = F.col("words"), F.lit(None).cast("string")

    def row(kind: str, token, prev=none):
        return F.struct(F.lit(kind).alias("kind"), prev.alias("prev"), token.alias("token"))

    tokens = F.transform(w, lambda t: row("unigram", t))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: row("bigram", b, a))
    first = F.transform(F.slice(w, 1, 1), lambda t: row("first", t))
    distinct = F.transform(F.array_distinct(w), lambda t: row("document", t))
    every = F.concat(tokens, pairs, first, distinct, F.array(row("utterances", none)))
    rows = words.where(w.isNotNull()).select(F.col("shard").cast("string").alias("shard"), F.explode(every).alias("c"))
    return rows.groupBy("shard", "c.kind", "c.prev", "c.token").agg(F.count("*").alias("n")).select("kind", "prev", "token", "n", "shard")


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def counted_shards(spark: SparkSession, folder: str) -> list[str]:
    """The shards whose counts are there, by the folder's partitions; names only."""
    return sorted(r.shard for r in counts(spark, folder).where("kind = 'utterances'").select("shard").distinct().collect())


def add(words: DataFrame, folder: str, again: bool = False) -> None:
    """Count the shards of (shard, key, words) that have no counts yet (``again``: all that are
    given). Where ``words`` comes from a table partitioned by shard, others are not read."""
    known = [] if again else counted_shards(words.sparkSession, folder)
    new = words.where(~F.col("shard").isin(known)) if known else words
    made = written(shard_counts(new))
    if not made.isEmpty():
        made.repartition("shard", F.pmod(F.xxhash64("token"), F.lit(16))).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("shard").parquet(folder)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all shards; none if no shard was counted yet."""
    if not _there(spark, folder):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(folder)


def _total(spark: SparkSession, folder: str, kind: str, *by: str, n: str = "n") -> DataFrame:
    return counts(spark, folder).where(F.col("kind") == kind).groupBy(*by).agg(F.sum("n").alias(n))


def baselines(spark: SparkSession, folder: str, vocabulary: int | None = None) -> DataFrame:
    """As ``corpus.baselines`` of all counted shards."""
    pairs = _total(spark, folder, "bigram", "prev", "token").withColumnRenamed("token", "cur")
    return corpus.baselines_of_counts(written(_total(spark, folder, "unigram", "token")), pairs, _total(spark, folder, "first", "token"), vocabulary)


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """(token, df) of all counted shards."""
    return _total(spark, folder, "document", "token", n="df")


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(token, id) of all counted shards, ids from 0 in token order."""
    return corpus.dense_ids(_total(spark, folder, "unigram", "token"))
