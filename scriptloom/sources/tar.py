"""Tar archives of samples as a Spark data source, for reading and writing.

``spark.read.format("tar_samples")`` gives rows (shard, key, ext, payload). Options: ``path``
(a folder, or archives separated by commas), ``split`` (a member's key ends at the first dot
of its name, ``first``, or at the first of ``suffixes`` that fits, ``suffix``), ``shard`` and
``key`` (only these), ``split_bytes`` (of one input partition). With ``pushdown`` equality
filters take the place of ``shard`` and ``key``; the session must allow that
(spark.sql.python.filterPushdown.enabled).

Beside an archive lies its index: members by name with their places, as Parquet in small row
groups. A reader of one key reads the row groups whose names can hold it and the payloads,
whatever the archive's size; large archives are split by row groups. An archive without an
index of its own size is streamed whole by one task.

``df.write.format("tar_samples")`` writes an archive a shard. Each task writes to a staging
folder under names of its own and sends them with its commit message; the driver moves the
files of the tasks that were committed, and an abort deletes the folder. A task that fails
or runs twice leaves nothing. All rows of a shard must come to one task (``write`` sees to it).

Stores: what pyarrow.fs opens (mounted folders, HDFS, S3, GCS). Payloads are held in batches
of about 8 MB. A null payload is an empty member.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

SUFFIXES = (".mel.npy", ".unformatted.txt", ".formatted.txt")
REQUIRED = ("mel.npy", "unformatted.txt", "formatted.txt")
SCHEMA = "shard string, key string, ext string, payload binary"
ARROW = pa.schema([("shard", pa.string()), ("key", pa.string()), ("ext", pa.string()), ("payload", pa.binary())])
INDEX = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
#: Members of a row group of an index; bytes of payload in a batch and in an input partition.
GROUP, BATCH_BYTES, SPLIT_BYTES = 512, 8 << 20, 128 << 20


def split_name(name: str, suffixes: tuple[str, ...] | None) -> tuple[str, str]:
    name = name.rpartition("/")[2]
    if suffixes:
        for s in suffixes:
            if name.endswith(s):
                return name[: -len(s)], s.lstrip(".")
    key, _, ext = name.partition(".")
    return key, ext


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(path)


class _Slice(InputPartition):
    """The k-th of ``of`` parts of an archive."""

    def __init__(self, path: str, k: int, of: int, size: int):
        super().__init__((path, k, of, size))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(",")) if options.get("split") == "suffix" else None
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted = {c: options[c] for c in ("shard", "key") if c in options}

    def partitions(self):
        slices = []
        for path in self.paths:
            fs, at = store_of(path)
            found = [fs.get_file_info(at)]
            if found[0].type == pafs.FileType.Directory:
                found = [i for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith(".tar")]
            scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
            for info in sorted(found, key=lambda i: i.path):
                if info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError(path)
                if self.wanted.get("shard") in (None, shard_name(info.path)):
                    of = 1 if "key" in self.wanted else max(1, -(-info.size // self.split_bytes))
                    slices += [_Slice(scheme + info.path, k, of, info.size) for k in range(of)]
        return slices

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        path, k, of, size = partition.value
        rows, held = [], 0
        for name, payload in self._members(path, k, of, size):
            key, ext = split_name(name, self.suffixes)
            if self.wanted.get("key") in (None, key):
                rows.append({"shard": shard_name(path), "key": key, "ext": ext, "payload": payload()})
                held += len(rows[-1]["payload"])
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _members(self, path: str, k: int, of: int, size: int):
        """(name, reader of the payload) of this part's members."""
        fs, at = store_of(path)
        places = self._places(fs, at, k, of, size)
        if places is None:
            if not k:
                with fs.open_input_stream(at) as stream, tarfile.open(fileobj=stream, mode="r|") as archive:
                    for member in archive:
                        if member.isfile():
                            yield member.name, lambda m=member: archive.extractfile(m).read()
            return
        with fs.open_input_file(at) as file:
            for table in places:
                for name, offset, length in zip(*[c.to_pylist() for c in table.columns], strict=True):
                    yield name, lambda o=offset, n=length: file.read_at(n, o)

    def _places(self, fs: pafs.FileSystem, at: str, k: int, of: int, size: int) -> Iterator[pa.Table] | None:
        """Rows of the index for this part, in the order of the archive; None without an index
        that was made for an archive of this size."""
        if fs.get_file_info(f"{at}.index").type != pafs.FileType.File:
            return None
        index = pq.ParquetFile(fs.open_input_file(f"{at}.index"))
        if index.schema_arrow.metadata.get(b"archive_bytes") != str(size).encode():
            return None
        n, key = index.num_row_groups, self.wanted.get("key")

        def chosen() -> Iterator[pa.Table]:
            for g in range(n * k // of, n * (k + 1) // of):
                names = index.metadata.row_group(g).column(0).statistics
                # a key's members are the key itself, or begin with it and a dot
                if key is None or names is None or not names.has_min_max or (names.min < f"{key}/" and names.max >= key) or "/" in names.min + names.max:
                    yield index.read_row_group(g)

        return chosen()


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("shard",), ("key",)) and self.wanted.get(f.attribute[0]) in (None, f.value):
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f


@dataclass
class _Staged(WriterCommitMessage):
    """Archives of one task: (shard, staged name)."""

    shards: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.stage = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        fs, folder = store_of(self.folder)
        fs.create_dir(f"{folder}/{self.stage}")
        done: dict[str, str] = {}
        now: _Open | None = None
        for batch in iterator:
            for shard, key, ext, payload in zip(*[batch.column(c).to_pylist() for c in ("shard", "key", "ext", "payload")], strict=True):
                if now is None or shard != now.shard:
                    if now:
                        now.close()
                    if shard in done:
                        raise ValueError(f"the rows of shard {shard} do not come together; use tar.write")
                    now = _Open(fs, f"{folder}/{self.stage}", shard)
                    done[shard] = now.name
                now.add(f"{key}.{ext}" if ext else key, payload or b"")
        if now:
            now.close()
        return _Staged(list(done.items()))

    def commit(self, messages) -> None:
        fs, folder = store_of(self.folder)
        staged = [pair for m in messages if m is not None for pair in m.shards]
        if len({s for s, _ in staged}) < len(staged):
            raise ValueError("a shard came to several tasks; use tar.write")
        for shard, name in staged:
            for ending in (".tar", ".tar.index"):
                target = f"{folder}/{shard}{ending}"
                if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(target).type == pafs.FileType.File:
                    fs.delete_file(target)  # some stores do not move over a file
                fs.move(f"{folder}/{self.stage}/{name}{ending}", target)
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, folder = store_of(self.folder)
        if fs.get_file_info(f"{folder}/{self.stage}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.stage}")


class _Open:
    """An archive being written, with its index."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: str):
        self.fs, self.shard, self.name = fs, shard, uuid.uuid4().hex
        self.path = f"{folder}/{self.name}.tar"
        self.stream = fs.open_output_stream(self.path)
        self.archive = tarfile.open(fileobj=self.stream, mode="w|")
        self.rows: list[tuple[str, int, int]] = []

    def add(self, name: str, payload: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(payload)
        self.archive.addfile(info, io.BytesIO(payload))
        self.rows.append((name, self.archive.offset - -(-len(payload) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE, len(payload)))

    def close(self) -> None:
        self.archive.close()
        self.stream.close()
        size = self.fs.get_file_info(self.path).size
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), INDEX, strict=True)], schema=INDEX.with_metadata({"archive_bytes": str(size)}))
        with self.fs.open_output_stream(f"{self.path}.index") as out:
            pq.write_table(table, out, row_group_size=GROUP)


def shard_name(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".tar")


class TarSamples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def read_members(spark: SparkSession, paths: list[str], split: str = "first", shard: str | None = None, key: str | None = None) -> DataFrame:
    """Members of archives or of folders of archives; ``shard`` and ``key`` read only these.
    Filters are pushed down where the session allows it."""
    spark.dataSource.register(TarSamples)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("tar_samples").option("path", ",".join(paths)).option("split", split).option("pushdown", pushdown)
    for name, value in (("shard", shard), ("key", key)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load()


def samples(members: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(shard, key, one binary column a required extension): complete samples only."""
    columns = [F.max_by("payload", F.when(F.col("ext") == e, 1)).alias(e.replace(".", "_")) for e in required]
    wide = members.where(F.col("ext").isin(*required)).groupBy("shard", "key").agg(*columns)
    return wide.dropna(subset=[e.replace(".", "_") for e in required])


def write(members: DataFrame, folder: str) -> DataFrame:
    """Write (shard, key, ext, payload) as one archive a shard; (shard, members, bytes) of the
    folder's archives, from their indexes."""
    spark = members.sparkSession
    spark.dataSource.register(TarSamples)
    arranged = members.select("shard", "key", "ext", "payload").repartition("shard").sortWithinPartitions("shard", "key", "ext")
    arranged.write.format("tar_samples").option("path", folder).mode("append").save()
    indexes = spark.read.schema("name string, offset long, size long").option("pathGlobFilter", "*.tar.index").parquet(folder)
    shard = F.regexp_replace(F.col("_metadata.file_name"), r"\.tar\.index$", "").alias("shard")
    return indexes.select(shard, "size").groupBy("shard").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


def relabel(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Members with new texts: those of failed and unlabelled samples go, features pass
    through. ``verdicts``: key, failed, new_formatted, new_unformatted."""
    joined = members.join(verdicts, "key").where(~F.col("failed"))
    text = F.when(F.col("ext") == "formatted.txt", F.col("new_formatted")).when(F.col("ext") == "unformatted.txt", F.col("new_unformatted"))
    return joined.select("shard", "key", "ext", F.coalesce(text.cast("binary"), "payload").alias("payload"))


def unwritten(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of shards that an earlier run has not finished."""
    return rows.join(done.select("shard").distinct(), "shard", "left_anti")
