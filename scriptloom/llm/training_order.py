"""Training-order materialisation of token sequences as binary shards.

Documents are taken in the order of their ids (equal ids by the hash of the text; rows
alike in both are interchangeable), each followed by an end id, and the whole stream is
cut into sequences of ``length`` tokens, the last one padded. Sequence i of n goes to the
slot that a keyed Feistel network over the next power of four, cycle-walked into
0..n-1, gives: a permutation, so that every sequence knows its slot from its number
alone. Shard s holds the slots from s * per_shard on, as many records as that, the last
shard the rest. A record is ``length`` little-endian 16-bit ids and one line feed, so a
slot is found by a division and a seek. Neither the sequences nor their slots depend on
how the input is partitioned.

Steps, each of them restartable:

1. Texts are encoded once, in blocks of whole documents, to a table bucketed by the
   task that wrote them.
2. Numbers of tokens, with no token, are sorted by document; sums by task and one sum a
   task give every document's place in the stream. These places are bucketed likewise,
   so that they meet the blocks without moving a token.
3. Every block is cut at the sequence borders. Its pieces travel once, compressed and
   one row for each shard they go to. A task takes a range of shards, sorts its rows by
   shard, lays out one shard after the other and writes a file for each, so that the number
   of tasks does not grow with the data.

``done`` lists shards that are already written; they are left out before the shuffle.
Spark's own text writer writes the bytes, so any store works, tasks are retried and a
job's files appear together. Null and empty texts contribute an end id. No rows give no
sequences and no files. Very long texts span blocks of their own and any number of
sequences. Repeated rows are documents like others. Columns but doc_id and text are not
read. Ids must fit 16 bits; others raise.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import file_system, pieces, remove, runs, shared_dir, sized, store

#: From texts to all their ids and the number of each text's.
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
PAD = 0
#: Tokens and documents of a block at most, and tokens that a task deals out at once.
BLOCK_TOKENS, BLOCK_DOCS, AT_ONCE = 1 << 20, 4096, 1 << 23
#: Records of a row that a shard is written from.
RECORDS = 128


@dataclass(frozen=True)
class Layout:
    """What a reader needs to find a slot."""

    length: int
    per_shard: int
    sequences: int

    @property
    def stride(self) -> int:
        return 2 * self.length + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


class Permutation:
    """A keyed bijection of 0..n-1: four Feistel rounds, cycle-walked."""

    ROUNDS = 4

    def __init__(self, n: int, key: str):
        self.n = n
        self.bits = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.bits) - 1)
        digest = hashlib.sha256(key.encode()).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(self.ROUNDS)]

    def _round(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (half ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.bits), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.bits)) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self._once(np.asarray(x, dtype=np.uint64), back)
            while (out := x >= np.uint64(self.n)).any():
                x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, index) -> np.ndarray:
        return self._walk(index, False)

    def indices(self, slot) -> np.ndarray:
        return self._walk(slot, True)


class Bucketed:
    """A table in the shared folder, bucketed by a column: two of them with as many buckets
    join on it without an exchange."""

    def __init__(self, df: DataFrame, column: str, buckets: int):
        self.spark, self.path, self.name = df.sparkSession, shared_dir(df.sparkSession), f"scriptloom_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, column).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        remove(self.spark, self.path)


def _encode(encoder: Callable[[], Encoder]):
    """Blocks of encoded documents from rows (doc_id, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block = encoder(), TaskContext.get().partitionId(), 0

        def made(keys: pa.Array, hashes: pa.Array, counts: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (keys, hashes, pa.array(counts, pa.int32()))]
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), *lists, pa.array([tokens.astype("<u2").tobytes()])]
            block += 1
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "keys", "hashes", "counts", "ids"])

        for batch in pieces(batches, 2):
            tokens, counts = encode(batch.column(2))
            if len(tokens) and not 0 <= tokens.min() <= tokens.max() < 1 << 16:
                raise ValueError("an id does not fit 16 bits")
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(counts):  # at least a document, else as many as fit
                before = ends[begin] - counts[begin]
                end = min(begin + BLOCK_DOCS, max(begin + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS, side="right"))))
                yield made(*(batch.column(i).slice(begin, end - begin) for i in (0, 1)), counts[begin:end], tokens[before : ends[end - 1]])
                begin = end

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, pos, n) with the tokens before each in its task."""
    task, before = TaskContext.get().partitionId(), 0
    for b in batches:
        ends = before + np.cumsum(b.column(3).to_numpy(), dtype=np.int64)
        starts = np.concatenate(([before], ends[:-1])).astype(np.int64)[: b.num_rows]
        before = int(ends[-1]) if b.num_rows else before
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, task, np.int32)), *b.columns[:3], pa.array(starts), pa.array(ends)], names=["task", "part", "block", "pos", "start", "end"])


def _places(blocks: DataFrame, buckets: int) -> tuple[Bucketed, int]:
    """(part, at, starts) of each block: its documents' places in the stream; and the tokens
    of all."""
    each = blocks.select("part", "block", F.posexplode(F.arrays_zip("keys", "hashes", "counts")).alias("pos", "d"))
    # the last keys tell apart what is alike, so that no value fills a partition
    order = [F.col("d.keys").asc_nulls_first(), F.col("d.hashes").asc(), F.xxhash64("part", "block", "pos").asc()]
    ranged = each.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "block", "pos", F.col("d.counts").alias("n"))
    summed = store(ranged.mapInArrow(_sums, "task int, part int, block int, pos int, start long, end long"))
    bases, total = [], 0
    for r in summed.groupBy("task").agg(F.max("end").alias("n")).orderBy("task").collect():  # one row a task
        bases.append((r.task, total))
        total += r.n
    tasks = sized(blocks.sparkSession.createDataFrame(bases, "task int, base long"))
    found = summed.join(tasks, "task").groupBy("part", F.col("block").alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("start") + F.col("base")).alias("start")))).alias("s"))
    return Bucketed(found.select("part", "at", F.col("s.start").alias("starts")), "part", buckets), total


def _pieces(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(sequence, place in it, first token, tokens) of the pieces into which sequence
    borders cut documents that lie one after the other in a block."""
    first, last = starts // length, (starts + counts - 1) // length
    many = last - first + 1
    doc = np.repeat(np.arange(len(starts)), many)
    sequence = runs(first, many)
    begin = np.maximum(starts[doc], sequence * length)
    end = np.minimum(starts[doc] + counts[doc], (sequence + 1) * length)
    token = begin - starts[doc] + (np.cumsum(counts) - counts)[doc]
    return sequence, begin - sequence * length, token, end - begin


def _deal(layout: Layout, key: str, done: np.ndarray):
    """Rows (shard, data) from rows (counts, ids, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, squeeze = Permutation(layout.sequences, key), zstandard.ZstdCompressor(level=3).compress
        held, size = [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            starts, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            sequence, at, token, n = _pieces(starts, counts, layout.length)
            slot = order.slots(sequence)
            shard = slot // layout.per_shard
            keep = np.flatnonzero(~np.isin(shard, done))
            keep = keep[np.lexsort((at[keep], slot[keep]))]
            borders = np.flatnonzero(np.diff(shard[keep])) + 1
            for some in np.split(keep, borders) if len(keep) else ():
                head = np.concatenate(([len(some)], slot[some], at[some], n[some])).astype("<i8").tobytes()
                data = squeeze(head + ids[runs(token[some], n[some])].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([shard[some[0]]], pa.int32()), pa.array([data])], names=["shard", "data"])

        for batch in batches:
            for counts, ids, starts in zip(*[batch.column(i) for i in range(3)], strict=True):
                held.append((starts.values.to_numpy().astype(np.int64), counts.values.to_numpy().astype(np.int64), np.frombuffer(ids.as_buffer(), "<u2")))
                size += len(held[-1][2])
                if size >= AT_ONCE:
                    yield from dealt()
                    held, size = [], 0
        if held:
            yield from dealt()

    return run


def _lay_out(layout: Layout):
    """Rows (shard, n, value) with the bytes of each shard, cut into ``RECORDS`` records without
    their last line feeds, from all its rows (shard, data), which follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, records, current = zstandard.ZstdDecompressor().decompress, None, -1

        def laid() -> Iterator[pa.RecordBatch]:
            table = records.view(np.uint8).reshape(-1, layout.stride - 1)
            for n, a in enumerate(range(0, len(table), RECORDS)):
                lines = np.full((len(table[a : a + RECORDS]), layout.stride), 10, np.uint8)
                lines[:, :-1] = table[a : a + RECORDS]
                columns = [pa.array([current], pa.int32()), pa.array([n], pa.int32()), pa.array([lines.tobytes()[:-1]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "n", "value"])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != current:
                    if records is not None:
                        yield from laid()
                    current, first = shard, shard * layout.per_shard
                    records = np.full(min(layout.per_shard, layout.sequences - first) * layout.length, PAD, "<u2")
                raw = spread(data.as_py())
                many = int(np.frombuffer(raw, "<i8", 1)[0])
                slot, at, n = np.frombuffer(raw, "<i8", 3 * many, 8).reshape(3, many)
                records[runs((slot - first) * layout.length + at, n)] = np.frombuffer(raw, "<u2", offset=8 + 24 * many)
        if records is not None:
            yield from laid()

    return run


def write(docs: DataFrame, encoder: Callable[[], Encoder], folder: str, key: str, length: int = 1024, per_shard: int = 4096, done: list[int] | None = None, most_tasks: int = 10_000) -> Layout:
    """Write the shards of ``docs`` (doc_id long, text) below ``folder``. ``encoder`` makes,
    on a worker, a function that gives the ids of a column of texts. Shards that the folder
    holds already, as after a run that broke off, are left out, like those of ``done``; so
    writing twice gives the same rows. At most ``most_tasks`` tasks write, several shards each
    if there are more. A folder of another layout or key raises ValueError."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    buckets = max(1, min(rows.rdd.getNumPartitions(), 20_000))
    encoded = rows.mapInArrow(_encode(encoder), "part int, block int, keys array<long>, hashes array<long>, counts array<int>, ids binary")
    blocks = places = None
    try:
        blocks = Bucketed(encoded, "part", buckets)
        places, total = _places(blocks.df, buckets)
        layout = Layout(length, per_shard, -(-total // length))
        before = layout_of(spark, folder)
        if before.sequences:
            its_key = spark.read.schema("key string").json(f"{folder}/_layout").first().key
            if (before, its_key) != (layout, key):
                raise ValueError(f"the folder has shards of {before} and key {its_key}, not of {layout} and key {key}")
        if layout.sequences:
            skipped = np.array(sorted({*(done or []), *written_shards(spark, folder)}), np.int64)
            # the second condition must not become a key, for the tables are bucketed by the first
            match = (blocks.df["part"] == places.df["part"]) & (blocks.df["block"] - places.df["at"] == 0)
            joined = blocks.df.join(places.df, match).select("counts", "ids", "starts")
            dealt = joined.mapInArrow(_deal(layout, key, skipped), "shard int, data binary")
            each = -(-layout.shards // most_tasks)
            sent = dealt.repartitionById(-(-layout.shards // each), F.floor(F.col("shard") / each).cast("int"))
            laid = (sent.sortWithinPartitions("shard") if each > 1 else sent).mapInArrow(_lay_out(layout), "shard int, n int, value binary")
            # the writer takes rows by shard, which this order gives it
            laid = laid.sortWithinPartitions("shard", "n")
            if not before.sequences:
                spark.createDataFrame([(*asdict(layout).values(), key)], "length int, per_shard int, sequences long, key string").coalesce(1).write.mode("overwrite").json(f"{folder}/_layout")
            laid.select("shard", F.col("value").cast("string")).write.mode("append").partitionBy("shard").text(folder)
    finally:
        for table in (blocks, places):
            if table is not None:
                table.drop()
    return layout


def written_shards(spark: SparkSession, folder: str) -> list[int]:
    """The shards that a folder holds, whole."""
    fs, path = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[6:]) for n in names if n.startswith("shard="))


def layout_of(spark: SparkSession, folder: str) -> Layout:
    """The layout that ``write`` left in a folder; no sequences where it left none."""
    fs, path = file_system(spark, f"{folder}/_layout")
    if not fs.exists(path):
        return Layout(1, 1, 0)
    return Layout(**spark.read.schema("length int, per_shard int, sequences long").json(f"{folder}/_layout").first().asDict())


def read(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, shard, position, ids binary) of the slots from ``start`` to before ``stop``;
    only their shards are opened. Shards that are not written yet have no rows."""
    layout = layout_of(spark, folder)
    stop = layout.sequences if stop is None else min(stop, layout.sequences)
    wanted = [f"{folder}/shard={s}" for s in written_shards(spark, folder) if start < (s + 1) * layout.per_shard and s * layout.per_shard < stop]
    schema = "slot long, shard int, position long, ids binary"
    if not wanted:
        return spark.createDataFrame([], schema)
    length, step, per_shard = layout.length, layout.stride, layout.per_shard

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = np.frombuffer(content.as_buffer(), np.uint8)
                if len(table) % step:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                table = table.reshape(-1, step)
                at = np.arange(len(table))
                at = at[(shard * per_shard + at >= start) & (shard * per_shard + at < stop)]
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(at), [None, pa.py_buffer(np.ascontiguousarray(table[at, :-1]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + at), pa.array(np.full(len(at), shard, np.int32)), pa.array(at * step), ids.cast(pa.binary())], names=["slot", "shard", "position", "ids"])

    files = spark.read.format("binaryFile").load(wanted).select(F.regexp_extract("path", r"shard=(\d+)/[^/]*$", 1).cast("int").alias("shard"), "content")
    return files.mapInArrow(records, schema)
