"""Corpus statistics and vocabularies over utterance tables (key, text)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import let, normalize, tokens
from scriptloom.storage import with_position, written


def words_of(df: DataFrame, key: str, text: str, words: Column | None = None) -> DataFrame:
    """(key, words) of each utterance."""
    return df.select(F.col(key).alias("key"), (tokens(normalize(F.col(text))) if words is None else words).alias("words"))


def token_rows(words: DataFrame) -> DataFrame:
    return words.select("key", F.posexplode("words").alias("pos", "token"))


def unigrams(words: DataFrame) -> DataFrame:
    return words.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def bigrams(words: DataFrame) -> DataFrame:
    """Neighbours within an utterance, paired inside its array: no window, no exchange
    but that of the counts."""
    pairs = let(
        F.col("words"),
        lambda w: F.when(
            F.size(w) > 1,
            F.transform(F.sequence(F.lit(2), F.size(w)), lambda i: F.struct(F.element_at(w, i - 1).alias("prev"), F.element_at(w, i).alias("cur"))),
        ),
    )
    return words.select(F.explode(pairs).alias("p")).select("p.prev", "p.cur").groupBy("prev", "cur").agg(F.count("*").alias("n"))


def first_tokens(words: DataFrame) -> DataFrame:
    return words.where(F.size("words") > 0).groupBy(F.element_at("words", 1).alias("token")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, prefix: str) -> DataFrame:
    """One row: total, distinct and the entropy in nats, of counts n. From sums of n and
    n ln n, so that the counts are read once."""
    n = F.col("n")
    total = F.coalesce(F.sum(n), F.lit(0))
    return counts.agg(
        total.alias(f"{prefix}_tokens"),
        F.count("*").alias(f"{prefix}_types"),
        F.when(total > 0, F.log(total) - F.sum(n * F.log(n)) / total).alias(f"{prefix}_loss"),
    )


def baselines(words: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """One row of corpus baselines in nats. ``bigram_loss`` divides by all occurrences of
    the word before, final ones too; ``bigram_cond_entropy`` by those that have a
    successor. ``vocabulary``: size for the uniform loss and the coverage (default: the
    distinct words)."""
    words = written(words)
    return baselines_of_counts(written(unigrams(words)), bigrams(words), first_tokens(words), vocabulary)


def baselines_of_counts(one: DataFrame, two: DataFrame, firsts: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """The same from counts: (token, n), (prev, cur, n) and (token, n) of first tokens."""
    n = F.col("n")
    by_prev = two.groupBy("prev").agg(F.sum(n).alias("s"), F.sum(n * F.log(n)).alias("nln"), F.count("*").alias("types"))
    joined = by_prev.join(one.select(F.col("token").alias("prev"), n.alias("of_prev")), "prev")
    pair = joined.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("bigram_tokens"),
        F.coalesce(F.sum("types"), F.lit(0)).alias("bigram_types"),
        (-(F.sum("nln") - F.sum(F.col("s") * F.log("of_prev"))) / F.sum("s")).alias("bigram_loss"),
        (-(F.sum("nln") - F.sum(F.col("s") * F.log("s"))) / F.sum("s")).alias("bigram_cond_entropy"),
    )
    first = entropy(firsts, "first").drop("first_types").withColumnRenamed("first_tokens", "n_utterances").withColumnRenamed("first_loss", "first_token_loss")
    # three tables of one row each, put side by side
    row = entropy(one, "unigram").withColumn("_k", F.lit(1)).join(pair.withColumn("_k", F.lit(1)), "_k").join(first.withColumn("_k", F.lit(1)), "_k").drop("_k")
    size = F.lit(vocabulary) if vocabulary else F.col("unigram_types")
    return (
        row.withColumn("uniform_loss", F.log(size))
        .withColumn("vocab_coverage", F.col("unigram_types") / size)
        .withColumn("unigram_perplexity", F.exp("unigram_loss"))
        .withColumn("bigram_perplexity", F.exp("bigram_loss"))
    )


def document_frequency(words: DataFrame) -> DataFrame:
    """(token, df): utterances that hold a token."""
    return words.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def token_union(*tables: DataFrame, extra: list | None = None) -> DataFrame:
    """Distinct tokens of several tables (key, words) and single extra ones."""
    found = None
    for t in tables:
        one = t.select(F.explode("words").alias("token"))
        found = one if found is None else found.unionAll(one)
    if extra:
        found = found.unionAll(found.sparkSession.createDataFrame([(x,) for x in extra], found.schema))
    return found.distinct()


def dense_ids(tokens_: DataFrame) -> DataFrame:
    """(token, id): ids from 0 in token order."""
    return with_position(written(tokens_.select("token")), "token", name="id")  # the range exchange reads twice


def first_free_id(used: DataFrame, special: DataFrame, ids: DataFrame) -> DataFrame:
    """One row ``id``: the smallest special id that is not used, else the largest other
    id that is not. Null if all are used: the caller raises."""
    free_special = special.join(used, "id", "left_anti").agg(F.min("id").alias("a"), F.lit(1).alias("k"))
    free = ids.join(special, "id", "left_anti").join(used, "id", "left_anti").agg(F.max("id").alias("b"), F.lit(1).alias("k"))
    return free_special.join(free, "k").select(F.coalesce("a", "b").alias("id"))


#: Bytes of a table's most frequent rows that every worker holds.
HEAD_BYTES = 8 << 20


def map_elements(rows: DataFrame, column: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """``rows`` with the elements of an array replaced by their targets, in order; elements that
    the table lacks vanish.

    The head of the table, its most frequent rows up to ``HEAD_BYTES``, goes to the workers,
    which replace elements in place. Only other elements are exchanged, so that words that
    every text holds meet in no task; they return to their places by position. A table that
    fits into the head needs no exchange at all."""
    table = written(table.select(F.col(source).alias("_from"), F.col(target).alias("_to")))
    size = F.coalesce(F.octet_length(F.col("_from").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("_to").cast("string")), F.lit(0)) + 16
    total, n = table.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    head = table
    if total > HEAD_BYTES:
        rows = written(rows)
        counts = rows.select(F.explode(column).alias("_from")).groupBy("_from").agg(F.count("*").alias("_n"))
        most = max(1, HEAD_BYTES * n // total)
        ranked = table.join(counts, "_from").orderBy(F.desc("_n"), "_from").limit(most)
        head = written(ranked.select("_from", "_to"))
        held = head.agg(F.sum(size)).first()[0] or 0
        if held > HEAD_BYTES:  # frequent elements may be longer than others
            head = ranked.select("_from", "_to").limit(max(1, most * HEAD_BYTES // held))
    known = head.toArrow()
    keys, values = known["_from"].combine_chunks(), known["_to"].combine_chunks()

    @F.arrow_udf(f"array<{table.schema['_to'].dataType.simpleString()}>")
    def place(arrays: pa.Array) -> pa.Array:
        """Each element's target, or null."""
        flat = arrays.flatten()
        found = values.take(pc.index_in(flat, value_set=keys.cast(flat.type)))
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, found)

    placed = rows.withColumn("_got", place(column))
    others = [F.col(f"`{c}`") for c in rows.columns if c != column]
    if total <= HEAD_BYTES:
        return placed.select(*others, F.array_compact("_got").alias(column))
    placed = written(placed.withColumn("_row", F.monotonically_increasing_id()))
    pairs = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("_got")).alias("pos"), F.col(column).alias("value"), F.col("_got").alias("to")), lambda p: p["value"].isNotNull() & p["to"].isNull())
    asked = placed.select("_row", F.explode(pairs).alias("p")).select("_row", F.col("p.pos").alias("_pos"), F.col("p.value").alias("_from"))
    answered = asked.join(table, "_from").groupBy("_row").agg(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_to").alias("to"))).alias("_more"))
    here = F.filter(F.transform("_got", lambda to, pos: F.struct(pos.alias("pos"), to.alias("to"))), lambda p: p["to"].isNotNull())
    merged = F.when(F.col("_more").isNull(), F.array_compact("_got")).otherwise(F.array_sort(F.concat(here, "_more"))["to"])
    return placed.join(answered, "_row", "left").select(*others, merged.alias(column))


def encode(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, ids): words as ids in order; words without an id vanish."""
    return map_elements(words.select("key", F.col("words").alias("ids")), "ids", vocabulary, "token", "id")


def decode(ids: DataFrame, vocabulary: DataFrame, between: str = " ") -> DataFrame:
    """(key, text) of (key, ids); ids outside the vocabulary are skipped."""
    found = map_elements(ids.select("key", "ids"), "ids", vocabulary, "id", "token")
    return found.select("key", F.array_join("ids", between).alias("text"))


def duration_summary(rows: DataFrame, group: str, part: str, seconds: str) -> DataFrame:
    """(group, parts, seconds): distinct parts and total duration of each group."""
    return rows.groupBy(group).agg(F.countDistinct(part).alias("parts"), F.sum(seconds).alias("seconds"))


def chapter_durations(rows: DataFrame, chapter: str, key: str, seconds: str) -> DataFrame:
    """(chapter, seconds, keys): total duration and the utterances of each chapter, in order."""
    return rows.groupBy(chapter).agg(F.sum(seconds).alias("seconds"), F.array_sort(F.collect_list(key)).alias("keys"))


def best_within_budget(summary: DataFrame, group: str, budget: float) -> DataFrame:
    """The group with most parts whose duration is within the budget; first by name of equals."""
    return summary.where((F.col("seconds") <= budget) & (F.col("parts") > 0)).orderBy(F.desc("parts"), F.col(group).cast("string")).limit(1)


def holdout(parts: DataFrame, part: str, seconds: str, n: int) -> DataFrame:
    """(part, seconds, held_out): the n shortest parts are held out, one at least remains."""
    most = max(0, min(n, parts.count() - 1))
    chosen = parts.orderBy(seconds, part).limit(most).select(part).withColumn("held_out", F.lit(True))
    return parts.join(F.broadcast(chosen) if most <= 100_000 else chosen, part, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def principal_components(vectors: DataFrame, column: str, k: int):
    """(components k x dim, share of variance of each) of centred vectors, by the
    distributed covariance of MLlib."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="v", outputCol="pca").fit(vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("v")))
    return model.pc.toArray().T, model.explainedVariance.toArray()
