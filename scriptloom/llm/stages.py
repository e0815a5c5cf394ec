"""Filtering steps on whole document tables, for pipelines.

Texts are joined only with lists of (doc_id, text hash): a list whose bytes allow it is
broadcast (``common.sized``); a longer one is shuffled with the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import sized, store


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, ...): each row as one struct beside new columns, so that no name of an input
    column can clash with one used here. ``select("row.*")`` unpacks."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def without(docs: DataFrame, listed: DataFrame, how: str = "left_anti", hashed: Column | None = None) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash) is not (left_anti) or is (left_semi) in
    ``listed`` (a stored table with columns _doc, _hash)."""
    rows = packed(docs, id=F.col("doc_id"), hash=text_hash() if hashed is None else hashed)
    match = F.col("id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash"))
    return rows.join(sized(listed), match, how).select("row.*")


def one_of_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of rows with equal (doc_id, text), listed in ``repeated``, one stays."""
    if repeated.isEmpty():
        return docs
    again = packed(without(docs, repeated, "left_semi"), id=F.col("doc_id"), hash=text_hash())
    return without(docs, repeated).unionByName(again.dropDuplicates(["id", "hash"]).select("row.*"))


def keep_firsts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id; rows without an id stay.
    ``classes``: (doc_id, text_hash, component_id) for every row."""
    classes = store(classes.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "component_id"))
    later = store(classes.where("_doc <> component_id").select("_doc", "_hash").distinct())
    repeated = store(classes.where("_doc = component_id").groupBy("_doc", "_hash").count().where("count > 1").select("_doc", "_hash"))
    return one_of_each(without(docs, later), repeated)
