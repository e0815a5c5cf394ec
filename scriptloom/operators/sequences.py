"""Operators over ordered utterances: chunks, neighbours, running values.

Sums and moving averages are linear in their state, so a group of any size is split over
tasks (``linear_scan``), as are states that merge (``segmented_scan``). Packing has a module
of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scriptloom.storage import with_position, written


def linear_scan(df: DataFrame, value: str, keep: float, add: float, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the running state s = keep * s + add * x of each group, which its first
    value starts and nulls leave alone.

    A range exchange cuts groups anywhere. Each task folds its rows once, and where its
    first group may have begun in an earlier task it keeps the fold as a linear function
    of the state it does not know. One row a task is enough to pass the states on."""
    names = df.columns
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    added = {"__t": pa.int32(), "__i": pa.int64(), "__first": pa.bool_(), "__a": pa.float64(), "__b": pa.float64(), "__c": pa.float64()}
    kinds = {"__t": "int", "__i": "long", "__first": "boolean", "__a": "double", "__b": "double", "__c": "double"}
    schema = df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, first, key, a, b, c = TaskContext.get().partitionId(), 0, True, None, 1.0, 0.0, None
        for batch in batches:
            keys = list(zip(*[batch.column(names.index(g)).to_pylist() for g in group], strict=True)) if group else [()] * batch.num_rows
            out = []
            for k, x in zip(keys, batch.column(names.index(value)).to_pylist(), strict=True):
                if k != key:
                    first, key, a, b, c = row == 0, k, 1.0, 0.0, None
                if x is not None:
                    x = float(x)
                    a, b, c = keep * a, keep * b + add * x, x if c is None else keep * c + add * x
                out.append((task, row, first, a, b, c))
                row += 1
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, t) for x, t in zip(columns, added.values(), strict=True)]], names=[*names, *added])

    made = written(ranged.mapInArrow(run, schema))
    key = F.struct(F.lit(0).alias("_"), *group)
    ends = made.groupBy("__t").agg(F.min_by(key, "__i").alias("begin"), F.max_by(key, "__i").alias("end"), F.max_by(F.struct("__first", "__a", "__b", "__c"), "__i").alias("last"))
    passed, state, of = [], None, None
    for r in ends.orderBy("__t").collect():  # one row a task
        begun = state if of == r.begin else None
        passed.append((r["__t"], begun))
        carried = r.last["__first"] and begun is not None
        state, of = r.last["__a"] * begun + r.last["__b"] if carried else r.last["__c"], r.end
    states = F.broadcast(df.sparkSession.createDataFrame(passed, "__t int, __s double"))
    known = F.when(F.col("__first") & F.col("__s").isNotNull(), F.col("__a") * F.col("__s") + F.col("__b")).otherwise(F.col("__c"))
    return made.join(states, "__t").select(*[F.col(f"`{n}`") for n in names if n != name], known.alias(name))


def moving_average(df: DataFrame, value: str, alpha: float, group: list[str], order: list[str], name: str = "ema") -> DataFrame:
    """Exponential moving average that starts at each group's first value; nulls keep it."""
    return linear_scan(df, value, alpha, 1 - alpha, group, order, name)


def chunk_targets(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Each row with its chunk (0, 1, ...) of ``most`` rows within its group, its place in
    the group and the group's rows."""
    w = Window.partitionBy(group)
    placed = df.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("rows", F.count("*").over(w))
    return placed.withColumn("chunk", F.floor(F.col("place") / most).cast("int"))


def chunk_context(df: DataFrame, group: str, order: str, most: int, overlap: int = 3) -> DataFrame:
    """(group, chunk, order, place): up to ``overlap`` rows on either side of each chunk of
    groups with several chunks. A row knows itself which seams it is near, so there is
    no self-join."""
    placed = chunk_targets(df, group, order, most).where(F.col("rows") > most)
    at = F.col("place") % most
    last = F.floor((F.col("rows") - 1) / most)
    # a chunk that is shorter than the overlap lets rows reach over it
    spans = F.sequence(F.lit(1), F.lit(-(-overlap // most)))
    later = F.filter(F.transform(spans, lambda k: F.col("chunk") + k.cast("int")), lambda c: (c <= last) & (c * most - F.col("place") <= overlap))
    start_of_next = lambda c: F.least((c + 1) * most, F.col("rows"))
    earlier = F.filter(F.transform(spans, lambda k: F.col("chunk") - k.cast("int")), lambda c: (c >= 0) & (F.col("place") - start_of_next(c) < overlap))
    return placed.select(group, F.explode(F.concat(later, earlier)).alias("chunk"), order, "place").withColumn("chunk", F.col("chunk").cast("int"))


def even_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows evenly spread over the order of the key, first and last included; all rows
    if there are no more than n."""
    placed = with_position(df, key)
    total = placed.count()
    if n >= total:
        return placed
    if n <= 1:
        return placed.where("position = 0")
    gap = (total - 1) / (n - 1)
    index = F.col("position")
    # i = round-half-up of index / gap is the only candidate whose place can be index
    i = F.floor(index / gap + 0.5)
    hit = F.exists(F.array(i - 1, i, i + 1), lambda k: k.between(0, n - 1) & (F.floor(k * F.lit(gap) + 0.5) == index))
    return placed.where(hit)


def of_spaced_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """The rows of n groups evenly spread over the order of their names."""
    return df.join(even_spaced(df.select(group).distinct(), group, n).select(group), group, "left_semi")


def segmented_scan(df: DataFrame, group: list[str], order: list[Column], inputs: list[str], step: Callable, merge: Callable, kind: str, name: str) -> DataFrame:
    """``df`` with the state that the earlier rows of its group leave behind, for any state that
    is associative: what two runs of rows leave is ``merge`` of what each leaves.

    ``step(state, *inputs)`` gives the state after a row, from an empty list at a group's
    first; ``merge(earlier, later)`` works on lists and on Columns alike. A range exchange
    cuts groups anywhere; each task folds its rows as a stream, and what its first group
    holds in earlier tasks is merged in afterwards. One row a task tells that."""
    names = df.columns
    by = [*[F.col(f"`{g}`") for g in group], *order]
    added = {"__t": T.IntegerType(), "__i": T.LongType(), "__first": T.BooleanType(), "__s": T.DataType.fromDDL(kind)}
    arrow = [to_arrow_type(t) for t in added.values()]
    schema = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, first, key, state = TaskContext.get().partitionId(), 0, True, None, []
        for batch in batches:
            keys = list(zip(*[batch.column(names.index(g)).to_pylist() for g in group], strict=True)) if group else [()] * batch.num_rows
            out = []
            for k, *values in zip(keys, *[batch.column(names.index(c)).to_pylist() for c in inputs], strict=True):
                if not row or k != key:
                    first, key, state = row == 0, k, []
                out.append((task, row, first, state))
                state, row = step(state, *values), row + 1
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, t) for x, t in zip(columns, arrow, strict=True)]], names=[*names, *added])

    made = written(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema))
    key = F.struct(F.lit(0).alias("_"), *group)
    last = F.struct("__first", "__s", F.struct(*inputs).alias("inputs"))
    ends = made.groupBy("__t").agg(F.min_by(key, "__i").alias("begin"), F.max_by(key, "__i").alias("end"), F.max_by(last, "__i").alias("last"))
    passed, state, of = [], [], None
    for r in ends.orderBy("__t").collect():  # one row a task
        begun = state if of == r.begin else []
        passed.append((r["__t"], begun))
        left = step(r.last["__s"], *r.last.inputs)
        state, of = merge(begun, left) if r.last["__first"] else left, r.end
    known = F.broadcast(df.sparkSession.createDataFrame(passed, T.StructType([T.StructField("__t", T.IntegerType()), T.StructField("__begun", added["__s"])])))
    full = F.when(F.col("__first") & (F.size("__begun") > 0), merge(F.col("__begun"), F.col("__s"))).otherwise(F.col("__s"))
    return made.join(known, "__t").select(*[F.col(f"`{n}`") for n in names if n != name], full.alias(name))


def valid_neighbours(df: DataFrame, group: str, order: str, key: str, valid: Column, per_side: int = 2, name: str = "neighbours") -> DataFrame:
    """Each row with the keys of up to ``per_side`` nearest valid rows on each side, in order.

    Two scans, one in each direction, whose state is the last valid keys; a group of any
    size is split over tasks. Rows that tie in the order are ordered by the key."""

    def step(state: list, ok: bool, k) -> list:
        return [*state, k][-per_side:] if ok else state

    def merge(earlier, later):
        if isinstance(earlier, list):
            return (earlier + later)[-per_side:]
        both = F.concat(earlier, later)
        return F.slice(both, F.greatest(F.size(both) - per_side + 1, F.lit(1)), per_side)

    kind = f"array<{df.schema[key].dataType.simpleString()}>"
    rows = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    for order_by, side in ((F.asc, "_before"), (F.desc, "_after")):
        rows = segmented_scan(rows, [group], [order_by(order), order_by(key)], ["_valid", key], step, merge, kind, side)
    return rows.withColumn(name, F.concat("_before", F.reverse("_after"))).drop("_valid", "_before", "_after")


def previous(df: DataFrame, group: str, order: str, value: str, name: str = "prev") -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(group).orderBy(order)))


def shifted_labels(df: DataFrame, sample: list[str], pos: str, label: str, name: str = "target") -> DataFrame:
    """Position i predicts the label at i + 1."""
    return df.withColumn(name, F.lead(label).over(Window.partitionBy(*sample).orderBy(pos)))


def counters(df: DataFrame, order: str) -> DataFrame:
    """Global step numbers from 1, in order."""
    return with_position(df, order, name="step").withColumn("step", F.col("step") + 1)


