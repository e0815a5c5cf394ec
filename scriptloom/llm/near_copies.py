"""Near copies by shingle sets: wide candidate search, then an exact check.

A text is its set of ``shingle``-word shingles (fewer words are one shingle). Two texts
link if the Jaccard similarity of these sets is at least ``least``, computed exactly;
classes are the connected components of such links. Candidates come from two searches:

* SimHash fingerprints of the same shingles, linked by ball hashing (simhash.py). At a
  similarity of 0.8 two fingerprints of 64 bits differ in ten bits on average, so this
  finds the closest copies only.
* ``BANDS`` keys a text, each of ``ROWS`` minimum hashes. A pair of similarity s shares a
  key with probability 1 - (1 - s ** ROWS) ** BANDS: 0.997 at 0.8, 0.99999 at 0.9. This is
  the only place where a link can be missed.

Texts that share a key are compared without emitting all pairs of a bucket: first each
with the smallest text of all its buckets; links are contracted to classes; then each with
the smallest of those buckets whose smallest is of another class; then, in buckets that
still hold several classes, the texts outside the largest class with all that are not of
their own. A pair that is never compared lies in one class already, so no class is lost.

Equal texts are one row before anything is compared. Texts without words are one class.
Repeated rows are rows of their own in the result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import simhash
from scriptloom.llm.common import pieces, sized, store, words_of
from scriptloom.llm.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 8
#: Shingle sets that a worker keeps while it checks pairs.
KEPT = 64
_DRAW = np.random.default_rng(42)
_MULTIPLY = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(text)
    lines = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, len(lines)))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        h = shingles[at : at + 1024, None] * _MULTIPLY + _ADD
        least = np.minimum(least, (h ^ h >> np.uint64(29)).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def _similar(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _emitter(shingle: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            keys, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles_of(t.as_py(), shingle)
                keys.append(bands_of(s) if len(s) else np.zeros(1, np.int64))
                ids.append(np.full(len(keys[-1]), i, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "h"])

    return emit


def _sorted_pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fingerprint_pairs(texts: DataFrame, shingle: int) -> DataFrame:
    """Candidates (a, b) among texts (h, text) whose fingerprints are alike or linked."""
    prints = store(texts.select("h", simhash.fingerprint_column(F.col("text"), shingle).alias("fp")))
    heads = store(prints.groupBy("fp").agg(F.min("h").alias("head")))
    alike = prints.join(heads, "fp").where("h <> head").select(*_sorted_pair(F.col("h"), F.col("head")))
    links = simhash.fingerprint_links(heads.select("fp")).distinct()
    for side in ("a", "b"):
        links = links.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), side)
    return alike.unionAll(links.select(*_sorted_pair(F.col("head_a"), F.col("head_b"))))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose texts are near copies."""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        kept: dict[int, np.ndarray] = {}

        def shingles(h: int, text: pa.StringScalar) -> np.ndarray:
            found = kept.pop(h, None)
            kept[h] = found = shingles_of(text.as_py(), shingle) if found is None else found
            if len(kept) > KEPT:
                del kept[next(iter(kept))]
            return found

        out = []
        for i, j, s, t in zip(a.to_pylist(), b.to_pylist(), x, y, strict=True):
            one, two = shingles(i, s), shingles(j, t)
            fewer, more = sorted((len(one), len(two)))
            # sets too unlike in size need no comparison; two of none are alike
            out.append(1.0 if not more else 0.0 if fewer < least * more else _similar(one, two))
        return pa.array(out, pa.float64())

    left, right = (texts.select(F.col("h").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard("a", "b", "text_a", "text_b").alias("s"))
    return store(scored.where(F.col("s") >= least).select("a", "b"))


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, class, s) of rows (h, class, text): each text's shingle hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            sets = [shingles_of(t.as_py(), shingle).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["h", "class", "s"])

    return texts.select("h", "class", "text").mapInArrow(made, "h long, class long, s array<long>")


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that can have a Jaccard similarity of ``least``, of rows
    (h, class, s) with sets of hashes; no such pair is left out.

    Elements are ordered by how many sets hold them, the rarest first. With an overlap of at
    least o two sets share one of their first n - o + 1 elements each. Of a pair the smaller
    set needs 2 least / (1 + least) of its elements in both, the larger one ``least`` of its
    own; these bounds give the lengths of the two prefixes. What comes behind a shared
    element bounds the overlap once more. Where an element's texts are mostly of one class,
    only those outside it meet the others."""
    n = F.size("s")
    rarity = sized(store(sets.select(F.explode("s").alias("e")).groupBy("e").agg(F.count("*").alias("c"))))
    each = sets.where(n > 0).select("h", "class", n.alias("n"), F.explode("s").alias("e")).join(rarity, "e")
    ranked = each.groupBy("h", "class", "n").agg(F.array_sort(F.collect_list(F.struct("c", "e")))["e"].alias("s"))  # a text's own elements
    needed = lambda share: F.ceil(share * F.col("n") - 1e-9).cast("int")
    small, large = needed(2 * least / (1 + least)), needed(least)
    first = ranked.select("h", "class", "n", (F.col("n") - small).alias("last"), F.posexplode(F.slice("s", F.lit(1), F.col("n") - large + 1)).alias("at", "e"))
    met = store(first)
    per = met.groupBy("e", "class").agg(F.count("*").alias("c")).groupBy("e")
    mixed = per.agg(F.count("*").alias("classes"), F.max_by("class", F.struct("c", "class")).alias("main")).where("classes > 1").select("e", "main")
    left = store(met.join(mixed, "e"))
    x, y = left.where("at <= last").alias("x"), left.alias("y")
    both = F.ceil(least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    alike = (
        (F.col("x.e") == F.col("y.e"))
        & (F.col("x.class") != F.col("y.class"))
        & (F.struct("x.n", "x.h") < F.struct("y.n", "y.h"))
        & (F.col("x.n") >= large_part(F.col("y.n"), least))
        & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= both)
    )
    minor = F.col("class") != F.col("main")
    found = x.where(minor).join(y, alike).select("x.h", F.col("y.h").alias("g")).unionAll(x.where(~minor).join(y.where(minor), alike).select("x.h", F.col("y.h").alias("g")))
    return found.select(*_sorted_pair(F.col("h"), F.col("g"))).distinct()


def large_part(n: Column, least: float) -> Column:
    """The fewest elements of a set that can be alike to one of n."""
    return F.ceil(least * n - 1e-9)


def _verified_sets(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose stored sets are alike."""

    @F.arrow_udf("double")
    def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
        both = ((np.asarray(s.values), np.asarray(t.values)) for s, t in zip(x, y, strict=True))
        return pa.array([_similar(s, t) for s, t in both], pa.float64())

    left, right = (sets.select(F.col("h").alias(c), F.col("s").alias(f"set_{c}")) for c in ("a", "b"))
    return store(pairs.join(left, "a").join(right, "b").where(jaccard("set_a", "set_b") >= least).select("a", "b"))


def near_copy_classes(docs: DataFrame, text_hash: Column, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = store(docs.select("doc_id", text_hash.alias("text_hash")))
    firsts = store(rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_doc")))
    texts = store(docs.select(text_hash.alias("h"), "text").dropDuplicates(["h"]))
    keys = store(texts.select("h", "text").mapInArrow(_emitter(shingle), "key long, h long"))
    leaders = keys.groupBy("key").agg(F.min("h").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    met = store(keys.join(leaders, "key"))
    first = met.where("h <> leader").groupBy("h").agg(F.min("leader").alias("leader")).select(*_sorted_pair(F.col("h"), F.col("leader")))
    tried = store(first.unionAll(_fingerprint_pairs(texts, shingle)).distinct())
    links = _verified(tried, texts, shingle, least)
    # the smallest of buckets that are of another class
    roots = components(links)
    sides = (roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}")) for c in ("h", "leader"))
    apart = met.where("h <> leader").select("h", "leader").distinct()
    for c, side in zip(("h", "leader"), sides, strict=True):
        apart = apart.join(side, c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    apart = apart.where("of_h <> of_leader").select(*_sorted_pair(F.col("h"), F.col("leader"))).distinct()
    second = store(apart.join(tried, ["a", "b"], "left_anti"))
    tried = tried.unionAll(second)
    links = links.unionAll(_verified(second, texts, shingle, least))
    # what is left: pairs across the classes of a bucket
    roots = components(links).select(F.col("node").alias("h"), "root")
    classed = store(met.join(roots, "h", "left").select("key", "h", F.coalesce("root", "h").alias("class")))
    per = classed.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key")
    mixed = per.agg(F.count("*").alias("classes"), F.max_by("class", F.struct("n", "class")).alias("main")).where("classes > 1")
    several = store(classed.join(mixed.select("key", "main"), "key"))
    if not several.isEmpty():
        odd = several.select("h", "class").distinct()
        sets = store(_shingle_sets(texts.join(odd, "h"), shingle))
        across = store(prefix_pairs(sets, least).join(tried, ["a", "b"], "left_anti"))
        links = links.unionAll(_verified_sets(across, sets, least))
    roots = components(links).withColumnRenamed("node", "text_hash")
    linked = store(firsts.join(roots, "text_hash"))
    smallest = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    joined = linked.join(smallest, "root").select("text_hash", "component_id")
    classes = store(firsts.join(joined, "text_hash", "left").select("text_hash", F.coalesce("component_id", "first_doc").alias("component_id")))
    return rows.join(classes, "text_hash").select("doc_id", "text_hash", "component_id")
