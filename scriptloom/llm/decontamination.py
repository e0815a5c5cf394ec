"""Benchmark decontamination: which documents contain which test items.

Containment of an item's five-word shingles, verified exactly. Candidates come from a
size-partitioned MinHash search that misses nothing:

* A document that contains the share t of an item of q shingles lacks at most
  m = q - ceil(t q) of them. So of any m + d shingles of the item at least d are in the
  document. Items of one size have the same m; documents with fewer than ceil(t q)
  shingles are not searched for them.
* The index holds m + d of an item's shingles (its bottom sketch): those of fewest items
  first, by MinHash among these, d from 1 to m + 1 as far as the item has shingles of its
  own. What many items share (a common phrase) is in a sketch only if that part alone
  may be the share t of the item, so such phrases make no pairs.
* A document and an item are a candidate if d shingles of the sketch are in the document.
  The document's length does not matter, where banded MinHash would lose short items in
  long documents.

Items of the same shingles are one class until the end.

Everything is DataFrame operations. The index and the verified pairs are broadcast if
the bytes of their values, which are summed up, allow it (``common.sized``); beyond that
they are shuffled. Until then a document's shingles meet the index where they are made.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered. Fewer words than a shingle: the whole
sequence is the one shingle. Null and empty texts have none: such items match nothing,
such documents match no item, and no rows give no rows. Repeated documents match alike;
repeated items (id and text) count once; an id with several texts has all of them tested.
Very long texts are arrays of their words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import sized, store, word_array

SHINGLE, CONTAINED = 5, 0.8


def _needed(n: Column, share: float) -> Column:
    return F.ceil(n * F.lit(share) - 1e-9)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside it is a bound variable, so no
    optimizer rule can copy its expression into a loop."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of a text's shingles."""

    def rolling(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))

    def hashes(h: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "), F.size(h)))
        return F.when(F.size(h) >= k, rolling(h)).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word_array(text), lambda w: F.xxhash64(w)), hashes)


def shingle_texts(text: Column, k: int = SHINGLE) -> Column:
    """A text's distinct shingles."""

    def texts(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, several).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(word_array(text), texts))


def _classes(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, class) of each item text that has shingles, and (class, text, _i) with one
    text and the shingles of each class."""
    shingled = tests.withColumn("_i", F.array_sort(shingle_texts(F.col("text")))).where("size(_i) > 0")
    # no shingle holds a line feed, so the joined text tells sets apart
    tests = store(shingled.withColumn("class", F.sha2(F.array_join("_i", "\n"), 256)))
    return tests, store(tests.groupBy("class").agg(F.min_by(F.struct("text", "_i"), "text").alias("r")).select("class", "r.*"))


def _sketches(classes: DataFrame, share: float) -> DataFrame:
    """(class, needed, demand, hash): the index."""
    hashes = store(classes.select("class", F.explode(F.array_distinct(shingle_hashes(F.col("text")))).alias("hash")))
    ranked = hashes.join(hashes.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    sets = ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("h"), F.count_if(F.col("n") == 1).alias("own"))
    q = F.size("h")
    sets = sets.withColumn("needed", _needed(q, share)).withColumn("lacks", F.size("h") - F.col("needed"))
    size = F.greatest(F.col("lacks") + 1, F.least(F.col("own"), 2 * F.col("lacks") + 1)).cast("int")
    return sets.select("class", "needed", (size - F.col("lacks")).alias("demand"), F.explode(F.slice("h.hash", F.lit(1), size)).alias("hash"))


def _candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class) of documents that hold as much of a sketch as they must."""
    hashed = docs.select("doc_id", "text_hash", F.explode(let(shingle_hashes(F.col("text")), lambda h: F.array(F.struct(F.size(h).alias("n"), h.alias("h"))))).alias("s"))
    searched = hashed.select("doc_id", "text_hash", "s.n", F.explode("s.h").alias("hash"))
    met = searched.join(index, "hash").where("n >= needed")
    held = met.groupBy("doc_id", "text_hash", "class").agg(F.size(F.collect_set("hash")).alias("held"), F.first("demand").alias("demand"))
    return held.where("held >= demand").select("doc_id", "text_hash", "class")


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = CONTAINED) -> DataFrame:
    """(doc_id, text_hash, item_id, shared, item_shingles) for every document and item
    of which the document contains at least ``share`` of the shingles."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    tests, classes = _classes(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct())
    found = store(_candidates(docs, sized(store(_sketches(classes, share))))).withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    # verification: the texts of the candidates only
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
    texts = docs.join(sized(store(found.select("_d", "_t").distinct())), same, "left_semi")
    in_docs = store(texts.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", shingle_texts(F.col("text")).alias("_s")))
    pairs = found.join(in_docs, same).join(sized(store(classes.select("class", "_i"))), "class")
    counted = pairs.select("doc_id", "text_hash", "class", F.size(F.array_intersect("_s", "_i")).cast("long").alias("shared"), F.size("_i").cast("long").alias("item_shingles"))
    held = counted.where(F.col("shared") >= _needed(F.col("item_shingles"), share))
    return held.join(sized(store(tests.select("item_id", "class").distinct())), "class").select("doc_id", "text_hash", "item_id", "shared", "item_shingles")
