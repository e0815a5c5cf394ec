"""Interaction audit of document filters: what each filter removes in every order.

Built-in expressions turn each document's failures into a mask of five bits; the bit for
copies needs the least id of each text. Counts by part and mask are all that any order
needs, so that 120 orders cost no pass over the documents:

1. a narrow row a document: digest of the text, four bits, part, id, label flags;
2. groups of equal text, part and flags, with their least id and how many rows have it;
3. the least id of a text over its groups splits each group into first and later rows;
4. at most 32 cells a part; orders and steps are laid out from them.

Texts are compared by SHA-256 and length in bytes. Texts travel nowhere: exchanges carry
narrow rows, pre-aggregated, so a text that a third of the rows share is a few groups.

Null texts count as empty, null parts as the empty string. An empty text has no words: it
fails A, not B, C or D. Rows without an id have no smaller id and are none, so they never
fail E; they have no labels. Rows that repeat an id count each; equal texts of one id are
no copies of one another. A document is good or toxic if any of its label rows says so; an
empty table gives no parts. Only the named columns are read, whatever else a table holds.
Texts of any length work, one at a time in a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import SPACES

FILTERS = "ABCDE"
#: A: least words. B: least share of distinct words, in hundredths. C: most capitals, in
#: hundredths of the characters. D: characters that junk holds.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, JUNK = 200, 50, 2, "[#$%&*|]"


def _marks(text: Column, words: Column) -> Column:
    """Bits of the failures that a text alone decides."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        n < LEAST_WORDS,
        distinct * F.lit(100).cast("long") < n * F.lit(LEAST_DISTINCT).cast("long"),
        capitals * F.lit(100).cast("long") > F.length(text) * F.lit(MOST_CAPITALS).cast("long"),
        text.rlike(JUNK),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic) with the numbers of documents by failure mask, at
    most 32 for a part. ``docs`` needs doc_id, text and source; ``labels`` doc_id, quality
    and toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    rows = read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("bytes"), _marks(F.col("text"), F.col("words")).alias("bits"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    flags = labels.groupBy(F.col("doc_id").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marked = rows.join(flags, "id", "left").select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    same = ["digest", "bytes", "bits", "part", "good", "toxic"]
    each = marked.groupBy(*same, "id").agg(F.count("*").alias("n"))
    groups = each.groupBy(*same).agg(
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("at_least"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"),
    )
    first = F.min("least").over(Window.partitionBy("digest", "bytes"))
    split = groups.withColumn("firsts", F.col("without") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    copies = F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))
    parted = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("firsts").alias("n")), copies)).alias("c"))
    counted = parted.where("c.n > 0").groupBy("part", "c.mask")
    return counted.agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def _total(cells: Column, field: str, wanted) -> Column:
    """Sum of a field over the cells whose mask is wanted."""
    return F.aggregate(F.filter(cells, lambda c: wanted(c["mask"])), F.lit(0).cast("long"), lambda sum_, c: sum_ + c[field])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    parts = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    laid = parts.select("*", F.explode(orders).alias("filter_order"))
    laid = laid.select("*", F.posexplode(F.array(*(F.substring("filter_order", i, 1) for i in range(1, 6)))).alias("at", "letter"))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("at"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = laid.select("part", "cells", "filter_order", (F.col("at") + 1).alias("step"), bits(F.col("letter")).alias("bit"), bits(before).alias("gone"))
    cells, bit, gone = F.col("cells"), F.col("bit"), F.col("gone")
    removed = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(gone) == 0)
    # of the orders of a mask's filters each is first in an equal share
    shares = F.aggregate(
        F.filter(cells, lambda c: c["mask"].bitwiseAND(bit) != 0), F.lit(0).cast("long"), lambda sum_, c: sum_ + (c["n"] * 120 / F.bit_count(c["mask"])).cast("long")
    )
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total(cells, "n", lambda m: m.bitwiseAND(bit.bitwiseOR(gone)) == 0).alias("kept"),
        _total(cells, "n", removed).alias("removed"),
        _total(cells, "n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(gone) != 0)).alias("redundant"),
        _total(cells, "n", lambda m: m == bit).alias("unique_fails"),
        _total(cells, "good", removed).alias("good_lost"),
        _total(cells, "toxic", removed).alias("toxic_lost"),
        shares.alias("shapley"),
    )
