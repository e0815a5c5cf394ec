"""Set operations and guards over keys, members and configurations."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extra_and_missing(got: Column, wanted: Column) -> Column:
    """struct<extra, missing> of two key arrays, each sorted."""
    return F.struct(F.array_sort(F.array_except(got, wanted)).alias("extra"), F.array_sort(F.array_except(wanted, got)).alias("missing"))


def complete(members: Column, required: list[str]) -> Column:
    """Whether an array of members holds all required ones."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), members)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def later_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one of the last source. Partial maxima before the exchange."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """Rows of several tables with the same columns by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def mixed_key_sets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(keys, groups): the distinct sets of items that groups hold; more than one row
    means that groups are not alike."""
    sets = rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("keys"))
    return sets.groupBy("keys").agg(F.count("*").alias("groups"))


def labels_fit(first: Column, second: Column, most: int) -> Column:
    """Whether both label forms have at most so many tokens."""
    return F.greatest(F.size(first), F.size(second)) <= most


def config_changes(old: dict, new: dict, keys: list[str]) -> list[str]:
    """Keys whose value a resumed run may not change but does."""
    return [k for k in keys if old.get(k) != new.get(k)]


def largest_accepted(accepts: Callable[[int], bool], most: int) -> int:
    """The largest n up to ``most`` that ``accepts``, where all smaller ones are accepted
    too; 0 if there is none. Doubles until it is refused, then bisects the last gap."""
    top = 1
    while top <= most and accepts(top):
        top *= 2
    refused = range(top // 2 + 1, min(top, most + 1))
    return top // 2 + bisect_left(refused, True, key=lambda n: not accepts(n))


def splits_like(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose split begins so; on a partition column only these folders are read."""
    return rows.where(F.startswith(column, F.lit(prefix)))


def within_frames(rows: DataFrame, column: str, most: int = 3000) -> DataFrame:
    """Rows of at most so many feature frames."""
    return rows.where(F.col(column) <= most)
