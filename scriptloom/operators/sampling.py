"""Deterministic samples, shuffles, splits and batches.

Order comes from md5(seed, key), so every engine and every partitioning gives the same
rows; the drawn rows differ from those of a sequential random generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.storage import with_position


def shuffle_key(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def epoch_seed(seed: int, stage: int = 0, epoch: int = 0) -> int:
    return seed + 10_000 * stage + epoch


def shuffled(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """``df`` with its position in the seeded order."""
    return with_position(df.withColumn("_o", shuffle_key(F.col(key), seed)), "_o", key).drop("_o")


def sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """The first n rows in seeded order."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def sample_two_stage(df: DataFrame, key: str, n: int, seed: int | str, keep: Column) -> DataFrame:
    """Of 2n sampled rows those that ``keep`` admits, of these n; maybe fewer."""
    return sample(sample(df, key, 2 * n, seed).where(keep), key, n, f"{seed}/2")


def sample_per_group(df: DataFrame, groups: list[str], key: str, n: int, seed: int | str) -> DataFrame:
    """n rows of each group. A rank limit prunes before the exchange."""
    order = Window.partitionBy(*groups).orderBy(shuffle_key(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def interleaved(df: DataFrame, key: str, seed: int | str, ranks: int) -> DataFrame:
    """Every row's rank: positions of the seeded order dealt out in turn."""
    return shuffled(df, key, seed).withColumn("rank", (F.col("position") % ranks).cast("int"))


def buffered(df: DataFrame, key: str, buffer: int, seed: int | str, *order: Column | str) -> DataFrame:
    """A shuffle of a stream through a bounded buffer: ``stream``, a row's place in the given
    order, and ``place``, where it comes out, fewer than ``buffer`` places away. Each row waits for
    a number of rows below ``buffer`` that its hash gives, so neither a task nor a reader holds
    more than that, and the same seed gives the same order under any partitioning. A buffer of
    1 keeps the order."""
    if buffer < 1:
        raise ValueError("a buffer holds one row at least")
    hashed = shuffle_key(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)
    waits = F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") % buffer
    placed = with_position(df, *order, name="stream")
    moved = placed.withColumn("_w", F.col("stream") + waits).withColumn("_h", hashed)
    return with_position(moved, "_w", "_h", "stream", name="place").drop("_w", "_h")


def batches_by_length(df: DataFrame, length: str, size: int, *ties: str, drop_last: bool = False) -> DataFrame:
    """Batches of ``size`` rows of ascending length; ties in the given order."""
    placed = with_position(df, length, *ties)
    placed = placed.withColumn("batch", F.floor(F.col("position") / size))
    if drop_last:
        placed = placed.where(F.col("batch") < df.count() // size)
    return placed


def first_batches(batched: DataFrame, most: int, batch: str = "batch") -> DataFrame:
    """The rows of the first ``most`` batches."""
    return batched.where(F.col(batch) < most)


def variant(key: Column, variants: list[str], seed: int) -> Column:
    """One of several texts for each key, the same on every run and engine: by the first 48
    bits of md5(seed, key)."""
    number = F.conv(F.substring(shuffle_key(key, seed), 1, 12), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(v) for v in variants]), (number % len(variants) + 1).cast("int"))


def cyclic(cursor: Column, batches: int) -> Column:
    """Batch of an iterator that starts over at its end."""
    return F.pmod(cursor, F.lit(batches))
