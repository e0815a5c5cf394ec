"""Sequential packing of ordered rows, on as many tasks as the range exchange has.

A shard that opens at a row closes at a place that only the sizes behind it decide. So
every row has a pointer to where the next shard would open, and the shards of a group are
the rows that its first row reaches along pointers:

1. a range exchange cuts the order anywhere, groups included; one row a task tells how
   sizes add up across tasks;
2. pointers that stay in a task are found by binary search in its running sums. Rows whose
   shard would close in a later task ask that task (a band search on the sums);
3. within a task an entry leads to the last shard that opens there; that shard's pointer
   leads to an entry of a later task. Pointer doubling over entries finds the one entry of
   each task that is reached, in log2(tasks) rounds;
4. with its entry each task numbers its rows as a stream.

No task sees more than its range and the questions put to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.storage import bounded, scratch, written

_PLACES = {"__t": ("int", pa.int32()), "__i": ("long", pa.int64()), "__g": ("long", pa.int64()), "__v": ("long", pa.int64())}
_ROW_LIMIT = 1 << 62


class Rule:
    """When a shard that opened at a row closes before a later one: its sum before that row
    reaches ``limit``, or (``inclusive``) its sum with that row exceeds it; or it holds
    ``most_rows`` rows."""

    def __init__(self, limit: int, inclusive: bool, most_rows: int | None = None):
        if limit < (0 if inclusive else 1) or (most_rows is not None and most_rows < 1):
            raise ValueError("limits must be positive")
        self.limit, self.inclusive, self.most_rows = limit, inclusive, most_rows or _ROW_LIMIT

    def closing(self, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The first of rising keys that closes a shard, for sums before it plus the limit."""
        return np.searchsorted(keys, sums, "right" if self.inclusive else "left")


class Part:
    """Pointers within one task's rows. ``leaving`` rows point behind the task."""

    def __init__(self, groups: np.ndarray, sizes: np.ndarray, rule: Rule):
        n = self.n = len(sizes)
        after = np.cumsum(sizes)
        self.before = after - sizes
        self.keys = after if rule.inclusive else self.before
        rows = np.arange(n)
        target = np.maximum(rule.closing(self.keys, self.before + rule.limit), rows + 1)
        target = np.minimum(target, rows + min(rule.most_rows, n))
        self.head = int(np.searchsorted(groups, groups[0], "right")) if n else 0
        self.tail = int(np.searchsorted(groups, groups[-1], "left")) if n else 0
        ends = np.searchsorted(groups, groups, "right")
        inside = target < ends
        self.leaving = ~inside & (ends == n)
        jump = np.append(np.where(inside, target, n), n)
        last, hops = np.arange(n + 1), np.ones(n + 1, np.int64)
        while (jump < n).any():
            on = jump < n
            last, hops, jump = np.where(on, last[jump], last), hops + np.where(on, hops[jump], 0), jump[jump]
        self.last, self.hops = last[:n], hops[:n]


def pack(df: DataFrame, size: str, rule: Rule, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row's shard in its group, from 0. Sizes are integers of
    zero or more (null: zero). Rows that tie in the order come in any order."""
    if df.schema[size].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("sizes must be integers")
    rows = written(_placed(df, size, group, order))
    tasks = _tasks(rows, group, rule)
    with scratch(df.sparkSession):  # what it finds is collected, a row a task
        numbers = _entries(rows, tasks, rule) if tasks else {}
    return _numbered(rows, df.columns, name, numbers, rule)


def _placed(df: DataFrame, size: str, group: list[str], order: list[str]) -> DataFrame:
    """Rows in order with task, place in the task, number of the group in the task and size."""
    names = df.columns
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    schema = df.select("*", *[F.lit(None).cast(k).alias(c) for c, (k, _) in _PLACES.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, number, last = TaskContext.get().partitionId(), 0, -1, None
        for b in batches:
            keys = list(zip(*[b.column(names.index(g)).to_pylist() for g in group], strict=True)) if group else [()] * b.num_rows
            numbers = []
            for k in keys:
                if number < 0 or k != last:
                    number, last = number + 1, k
                numbers.append(number)
            sizes = np.array([v or 0 for v in b.column(names.index(size)).to_pylist()], np.int64)
            if len(sizes) and sizes.min() < 0:
                raise ValueError("a size is negative")
            places = (np.full(b.num_rows, task), np.arange(row, row + b.num_rows), np.array(numbers, np.int64), sizes)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, t) for x, (_, t) in zip(places, _PLACES.values(), strict=True)]], names=[*names, *_PLACES])

    return ranged.mapInArrow(run, schema)


def _tasks(rows: DataFrame, group: list[str], rule: Rule) -> list[dict]:
    """What the driver knows, one entry a task in order: sizes and rows of its first and last
    group, and what that first group holds in earlier tasks."""
    key = F.any_value(F.struct(F.lit(0).alias("_"), *[F.col(f"`{g}`") for g in group])).alias("key")
    each = rows.groupBy("__t", "__g").agg(key, F.sum("__v").alias("size"), F.count("*").alias("rows"), F.max_by("__v", "__i").alias("end"))
    ends = each.groupBy("__t").agg(F.min_by(F.struct("key", "size", "rows", "end"), "__g").alias("head"), F.max_by(F.struct("key", "size", "rows"), "__g").alias("tail"), F.count("*").alias("groups"))
    tasks: list[dict] = []
    for r in ends.orderBy("__t").collect():
        carried = bool(tasks) and tasks[-1]["tail"] == r.head.key
        size, count = (tasks[-1]["size"], tasks[-1]["rows"]) if carried else (0, 0)
        whole = r.groups == 1
        tasks.append({
            "t": r["__t"], "carried": carried, "whole": whole, "tail": r.tail.key, "offset": size, "row": count,
            "most": size + r.head.size - (0 if rule.inclusive else r.head.end), "last": count + r.head.rows - 1,
            "size": (size if whole else 0) + r.tail.size, "rows": (count if whole else 0) + r.tail.rows,
        })
    return tasks


def _entries(rows: DataFrame, tasks: list[dict], rule: Rule) -> dict[int, tuple[int, int]]:
    """For each task whose first group began earlier: the first row of that group at which a
    shard opens (its rows, if none does) and that shard's number."""
    spark = rows.sparkSession
    at = {x["t"]: k for k, x in enumerate(tasks)}
    until = list(range(len(tasks)))  # the last task that the tail of each reaches
    for k in range(len(tasks) - 2, -1, -1):
        if tasks[k + 1]["carried"]:
            until[k] = until[k + 1] if tasks[k + 1]["whole"] else k + 1
    longest = max(u - k for k, u in enumerate(until))
    if not longest:
        return {}
    most, last = (np.array([x[c] for x in tasks]) for c in ("most", "last"))
    names = [x["t"] for x in tasks]
    crossing = [x["t"] for k, x in enumerate(tasks) if until[k] > k or x["carried"]]
    narrow = rows.select("__t", "__i", "__g", "__v").where(F.col("__t").isin(crossing)) if len(crossing) < len(tasks) else rows.select("__t", "__i", "__g", "__v")

    def part_of(table: pa.Table) -> tuple[Part, int]:
        table = table.sort_by("__i")
        return Part(table["__g"].to_numpy(), table["__v"].to_numpy(), rule), at[table["__t"][0].as_py()]

    questions = "q int, t int, i long, sum long, row long"
    asked_kind = pa.schema([("q", pa.int32()), ("t", pa.int32()), ("i", pa.int64()), ("sum", pa.int64()), ("row", pa.int64())])

    def ask(table: pa.Table) -> pa.Table:
        """Each leaving row's question to the task where its shard closes. One more row (q -1)
        tells of the group that begins here and leaves: its last shard's row, and how many
        shards it opens here."""
        part, k = part_of(table)
        x, i = tasks[k], np.flatnonzero(part.leaving)
        if until[k] == k:
            return asked_kind.empty_table()
        offset, count = (x["offset"], x["row"]) if x["whole"] else (0, 0)
        sums = part.before[i] - part.before[part.tail] + offset + rule.limit
        row = i - part.tail + count + rule.most_rows
        later = slice(k + 1, until[k] + 1)
        q = np.minimum(rule.closing(most[later], sums), np.searchsorted(last[later], row, "left")) + k + 1
        found = q <= until[k]
        columns = [np.array(names)[q[found]], np.full(found.sum(), x["t"]), i[found], sums[found], row[found]]
        if not (x["whole"] and x["carried"]):
            begun = (-1, x["t"], part.last[part.tail], part.hops[part.tail], 0)
            columns = [np.append(c, v) for c, v in zip(columns, begun, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, asked_kind, strict=True)], schema=asked_kind)

    answers = "t int, i long, q int, j long, exit long, hops long"
    answer_kind = pa.schema([(c, pa.int32() if c in "tq" else pa.int64()) for c in ("t", "i", "q", "j", "exit", "hops")])

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        """Where the shard of each question closes, and the last shard that opens from there on
        in this task (-1: the group ends here)."""
        if not asked.num_rows:
            return answer_kind.empty_table()
        part, k = part_of(table)
        sums, row = (asked[c].to_numpy() for c in ("sum", "row"))
        j = np.minimum(rule.closing(part.keys[: part.head] + tasks[k]["offset"], sums), row - tasks[k]["row"])
        j = np.maximum(j, 0)
        leaves = part.leaving[part.last[j]] & (until[k] > k)
        columns = {"j": j, "exit": np.where(leaves, part.last[j], -1), "hops": part.hops[j]}
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else asked[f.name].combine_chunks().cast(f.type) for f in answer_kind], schema=answer_kind)

    asked = written(narrow.groupBy("__t").applyInArrow(ask, questions))
    questioned = asked.where("q >= 0")
    known = written(narrow.groupBy("__t").cogroup(questioned.groupBy("q")).applyInArrow(answer, answers))
    starts = asked.where("q < 0").select("t", "i", F.col("sum").alias("n"))
    opened = {r.t: r.n for r in starts.collect()}  # one row a task
    asks = known.select("t", "i", F.col("q").alias("to_t"), F.col("j").alias("to_i"))
    entries = written(known.select(F.col("q").alias("a_t"), F.col("j").alias("a_i"), "exit", "hops").distinct())
    step = written(entries.join(asks, (F.col("a_t") == F.col("t")) & (F.col("exit") == F.col("i"))).select("a_t", "a_i", "to_t", "to_i", "hops"))
    kind = "t int, i long, n long"
    reached = {r[0]: tuple(r) for r in starts.join(asks, ["t", "i"]).select("to_t", "to_i", "n").collect()}  # at most one a task, here and below
    for left in range((longest - 1).bit_length(), 0, -1):
        here = bounded(spark.createDataFrame(list(reached.values()), kind))
        on = (F.col("t") == F.col("a_t")) & (F.col("i") == F.col("a_i"))
        reached |= {r[0]: tuple(r) for r in step.join(here, on).select("to_t", "to_i", F.col("n") + F.col("hops")).collect()}
        if left > 1:
            a, b = step.alias("a"), step.alias("b")
            twice = a.join(b, (F.col("a.to_t") == F.col("b.a_t")) & (F.col("a.to_i") == F.col("b.a_i")))
            step = written(twice.select("a.a_t", "a.a_i", "b.to_t", "b.to_i", (F.col("a.hops") + F.col("b.hops")).alias("hops")))
    here = bounded(spark.createDataFrame(list(reached.values()), kind))
    beyond = {r.t: r.n for r in entries.join(here, (F.col("a_t") == F.col("t")) & (F.col("a_i") == F.col("i"))).select("t", (F.col("n") + F.col("hops")).alias("n")).collect()}
    found, following = {}, 0
    for k, x in enumerate(tasks):
        if x["carried"]:
            found[x["t"]] = reached[x["t"]][1:] if x["t"] in reached else (_ROW_LIMIT, following)
            if x["whole"]:
                following = beyond.get(x["t"], following)
                continue
        if until[k] > k:
            following = opened[x["t"]]
    return found


def _numbered(rows: DataFrame, columns: list[str], name: str, numbers: dict[int, tuple[int, int]], rule: Rule) -> DataFrame:
    kept = [c for c in columns if c != name]
    arranged = rows.repartition("__t").sortWithinPartitions("__t", "__i").select(*[F.col(f"`{c}`") for c in kept], *_PLACES)
    schema = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("int").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = group = None
        number = held = count = 0
        for b in batches:
            out = []
            for t, i, g, v in zip(*[b.column(c).to_pylist() for c in _PLACES], strict=True):
                if t != task:
                    task, group = t, 0
                    entry, first = numbers.get(t, (0, 0))
                    number = first - 1
                if g != group:
                    group, number, held, count = g, 0, 0, 0
                elif not g and i <= entry:
                    number, held, count = first - (i < entry), 0, 0
                elif (held + v > rule.limit if rule.inclusive else held >= rule.limit) or count >= rule.most_rows:
                    number, held, count = number + 1, 0, 0
                held, count = held + v, count + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(out, pa.int32())], names=[*kept, name])

    return arranged.mapInArrow(run, schema)


def shard_pack(df: DataFrame, size: str, threshold: int, group: list[str], order: list[str], name: str = "shard_index") -> DataFrame:
    """Shard number within each group: a new shard opens before a row once the current
    one holds the threshold; the excess is not carried over."""
    return pack(df, size, Rule(threshold, False), group, order, name)


def submit_pack(df: DataFrame, size: str, most_bytes: int, most_rows: int, group: list[str], order: list[str], name: str = "batch_index") -> DataFrame:
    """Batch number: a batch closes before a row that would exceed its rows or bytes."""
    return pack(df, size, Rule(most_bytes, True, most_rows), group, order, name)
