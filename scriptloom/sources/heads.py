"""The first bytes of files, however long these are.

``spark.read.format("file_heads")``: rows (path, length, head) of the files below ``path``
whose names end with ``suffix``; ``bytes`` says how many. Tasks open each file and read by
position, so that a listing of large recordings costs some bytes a file. Stores that
pyarrow.fs opens; ``heads`` falls back to Spark's binary files for others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptloom.sources.tar import store_of

SCHEMA = "path string, length long, head binary"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary())])
#: Files of an input partition.
FILES = 1000
#: Schemes that pyarrow.fs opens.
DIRECT = ("", "file", "hdfs", "s3", "gs", "gcs")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(files)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix, self.bytes = options["path"], options.get("suffix", ""), int(options.get("bytes", 64))

    def partitions(self):
        fs, at = store_of(self.root)
        prefix = self.root[: len(self.root) - len(at)] if self.root.endswith(at) else ""
        found = [fs.get_file_info(at)]
        if found[0].type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        files = sorted((prefix + i.path, i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(self.suffix))
        return [_Files(files[k : k + FILES]) for k in range(0, len(files), FILES)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, _ = store_of(self.root)
        rows = []
        for path, at, size in partition.value:
            with fs.open_input_file(at) as file:
                rows.append({"path": path, "length": size, "head": file.read_at(min(self.bytes, size), 0)})
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def heads(spark: SparkSession, root: str, n: int, suffix: str = "") -> DataFrame:
    """(path, length, head) of the files below ``root``: their first ``n`` bytes."""
    scheme = root.partition(":")[0] if ":" in root.partition("/")[0] else ""
    if scheme not in DIRECT:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
        return files.select("path", "length", F.substring("content", 1, n).alias("head"))
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("path", root).option("suffix", suffix).option("bytes", n).load()
