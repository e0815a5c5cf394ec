"""Document pipeline: toxicity, near duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run()
writes every stage's rows to the shared folder and reads them again, so that a lost
executor costs one stage at most. All stages but the last return the columns of docs.
Rows without text pass the filters; their encoding is the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import decontamination, near_copies, secret_scan, sentencepiece_codec, stages, toxicity
from scriptloom.llm.common import Stored, scratch, sized, small_batches, store
from scriptloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of a half or more go. The model learns from the
    labels of the documents."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = stages.packed(docs, score=toxicity.score_column(F.col("text"), model))
    return scored.where(F.col("score") < 0.5).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, Jaccard similarity of 0.8 or
    more, checked exactly) the document with the smallest id stays."""
    small_batches(spark)
    classes = near_copies.near_copy_classes(docs, stages.text_hash())
    return stages.keep_firsts(docs, classes)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contained_items(docs, items)
    leaks = store(found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct())
    return stages.without(docs, leaks, hashed=F.xxhash64("text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the texts; copied examples stay."""
    small_batches(spark)
    read = docs.select("doc_id", "text", "source", "lang", stages.text_hash().alias("_hash"))
    found = secret_scan.scan(read, ["doc_id", "_hash"], F.col("text"), F.col("source"), F.concat_ws("/", "source", "lang"))
    live = F.filter("added", lambda s: s["kind"] == "live")
    marked = store(found.select(F.col("doc_id").alias("_doc"), "_hash", live.alias("_live")).where("size(_live) > 0").dropDuplicates(["_doc", "_hash"]))
    rows = stages.packed(docs, id=F.col("doc_id"), hash=stages.text_hash())
    match = F.col("id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash"))
    masked = rows.join(sized(marked), match, "left").select("row", "_live", secret_scan.redact_column(F.col("row.text"), F.col("_live")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("_live").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long"))}
    return masked.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as token ids, with their number."""
    small_batches(spark)
    coded = docs.select("doc_id", "lang", "source", sentencepiece_codec.encode(F.col("text"), tokenizer_path("piece_bpe_32k.model")).alias("ids"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither the learned model nor the fingerprints; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on the way is deleted once its rows are
    written, and these once the next stage's are."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):
            made = Stored(stage(spark, docs, sf_dir), keep=True)
        if last is not None:
            last.drop()
        docs, last = made.df, made
    return docs
