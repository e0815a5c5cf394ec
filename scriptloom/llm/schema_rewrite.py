"""Rewrite of Parquet files whose schema has drifted, by field ids.

A table is a folder of Parquet files whose columns carry field ids. Some files have other
names, another order, missing columns or other types than the evolved schema:

* ``footers`` reads the footer of each file, in tasks, into a map of files: how the file
  drifts (bits as below), its columns and the ids that it lacks;
* ``rewrite`` scans the drifting files with Spark's own reader, which matches field ids and
  widens types, under the evolved schema. The reader gives null for a missing column; the
  map says which files lack it, so that their rows get the default and stored nulls stay.
  ``_metadata.row_index`` restores the order of rows. Each file is replaced by one file of
  the same name; files that do not drift are never opened for writing.

Drift bits: 1 names, 2 order, 4 missing columns, 8 types.

``ordered_files`` lays a table out as numbered files: a range sort, then ranks as zipWithIndex
gives them (the counts of the sorted partitions become offsets), in DataFrame form, so that
rows stay in the JVM. ``digests`` hashes the rows of each file as a stream.

Scale: rows go through exchanges by file; only one row a partition or a file (its footer)
reaches the driver. A task holds no file: it sorts with spilling, then writes or hashes.

Recovery: files are written by Spark's commit protocol to a folder beside the table and
moved in one by one, each by a rename that replaces the old file. A run that broke off is
repeated by calling ``rewrite`` again: what has been replaced no longer drifts.

Defined cases: null values are values of their own and stay null; an absent column's
default shows only in files that lack it. Long texts and repeated rows are rows like others;
rows that tie in the order are ordered by their other columns. An empty table gives no
files. Columns that the evolved schema does not name are left out; clashing names do no
harm, as rows travel in a struct. A file whose columns carry no ids raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import empty, file_system, remove, shared_dir, sized, store

NAMES, ORDER, MISSING, TYPES = 1, 2, 4, 8
ID = "parquet.field.id"
#: The Parquet type behind each supported Spark type.
PHYSICAL = {"bigint": "INT64", "int": "INT32", "double": "DOUBLE", "float": "FLOAT", "string": "BYTE_ARRAY", "timestamp_ntz": "INT64"}
FOOTERS = "file string, path string, drift int, missing array<int>, columns string, crossed boolean"


def evolved_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """A nullable schema of names and types, with field ids from 1 on."""
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t), True, {ID: i}) for i, (n, t) in enumerate(columns, 1)])


@contextmanager
def field_ids(spark: SparkSession, vectorized: bool = True):
    """Readers that are planned inside match columns by field id; settings are put back."""
    wanted = {"spark.sql.parquet.fieldId.read.enabled": "true"} | ({} if vectorized else {"spark.sql.parquet.enableVectorizedReader": "false"})
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ordered_files(df: DataFrame, schema: T.StructType, order: list[Column], rows_a_file) -> tuple[DataFrame, int]:
    """Rows (file_no, row, values) of ``df`` in a global order, and the number of rows. ``values``
    is a struct of the schema's columns; ``rows_a_file`` maps the number of rows to that of
    each file."""
    values = F.struct(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    rows = df.select(*keys, values.alias("values"))
    by = [f"k{i}" for i in range(len(order))] + [f"values.`{f.name}`" for f in schema]
    placed = store(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("values", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a partition
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["count"]
    if not total:
        return empty(df.sparkSession, T.StructType([T.StructField("file_no", T.LongType()), T.StructField("row", T.LongType()), T.StructField("values", schema)])), 0
    offsets = df.sparkSession.createDataFrame(starts, "part long, start long")
    row = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(row.alias("row"), "values")
    return ranked.select(F.expr(f"row div {rows_a_file(total)}").alias("file_no"), "row", "values"), total


def write_files(spark: SparkSession, rows: DataFrame, columns: list[Column], folder: str) -> None:
    """Rows (file_no, row, values) as one Parquet file for each number, moved into ``folder``.
    Columns come from ``values`` and carry field ids in their metadata."""
    stage = shared_dir(spark, keep=True)
    laid = rows.repartition("file_no").sortWithinPartitions("file_no", "row")
    laid.select(F.col("file_no").alias("_file_no"), *columns).write.partitionBy("_file_no").parquet(stage)
    _publish(spark, stage, folder)
    remove(spark, stage)


def _publish(spark: SparkSession, stage: str, folder: str) -> None:
    """Each file of ``stage``/_file_no=N replaces ``folder``/N.parquet: renames only."""
    jvm = spark.sparkContext._jvm
    fs, top = file_system(spark, stage)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(top.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    for part in fs.listStatus(top):
        name = part.getPath().getName()
        if name.startswith("_file_no="):
            made = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
            if len(made) != 1:
                raise RuntimeError(f"{name} has {len(made)} files; maxRecordsPerFile must not split it")
            target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{int(name.partition('=')[2]):08d}.parquet")
            context.rename(made[0], target, options)


def footers(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """One row a file of a folder: how it drifts from ``schema``, the ids that it lacks and its
    columns, from the footers; ``crossed`` if a column has the name of another one of another
    type. Tasks read footers by position where pyarrow knows the store; else Spark brings the
    files' bytes."""
    want = [(f.metadata[ID], f.name, PHYSICAL[f.dataType.simpleString()]) for f in schema]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    direct = folder.partition(":")[0] in ("file", "hdfs", "s3", "gs") or folder.startswith("/")
    made = pa.schema([("file", pa.string()), ("path", pa.string()), ("drift", pa.int32()), ("missing", pa.list_(pa.int32())), ("columns", pa.string()), ("crossed", pa.bool_())])
    listed = files.select("path", F.lit(None).cast("binary").alias("content") if direct else "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                if direct:
                    plain = unquote(path.removeprefix("file:")) if path.startswith("file:") else path
                    fs, at = pyarrow.fs.FileSystem.from_uri("/" + plain.lstrip("/") if path.startswith(("file:", "/")) else path)
                    source = fs.open_input_file(at)
                else:
                    source = pa.BufferReader(content.as_buffer())
                with source, pq.ParquetFile(source) as f:
                    ids = [int((c.metadata or {}).get(b"PARQUET:field_id", b"-1")) for c in f.schema_arrow]
                    held = [(i, c.name, c.physical_type) for i, c in zip(ids, (f.schema.column(k) for k in range(len(ids))), strict=True)]
                if any(i < 0 for i in ids):
                    raise ValueError(f"{path} has columns without field ids")
                here = set(ids)
                known = [w for w in want if w[0] in here]
                by_id = {i: (n, t) for i, n, t in held}
                drift = NAMES * any(by_id[i][0] != n for i, n, _ in known) + ORDER * (ids != [w[0] for w in known])
                drift += MISSING * (len(known) < len(want)) + TYPES * any(by_id[i][1] != t for i, _, t in known)
                kind_of = {n: t for _, n, t in want}
                crossed = any(kind_of.get(n, t) != t for i, n, t in held if (i, n) not in {w[:2] for w in want})
                rows.append((path.rpartition("/")[2], path, drift, [i for i, _, _ in want if i not in here], ",".join(n for _, n, _ in held), crossed))
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in rows], made)

    return listed.mapInArrow(read, FOOTERS)


def _scan(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Rows (file, row, values) of files, by Spark's own reader."""
    values = F.struct(*(F.col(f"`{f.name}`") for f in schema)).alias("values")
    return spark.read.schema(schema).parquet(*paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), values)


def rewrite(spark: SparkSession, folder: str, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Replace each drifting file of ``folder`` by one in the evolved schema. Missing columns
    become their default (null if none is given). The result is the map of all files as
    they were."""
    before = store(footers(spark, folder, schema))
    drifting = before.where("drift <> 0")
    listed = drifting.select("path", "crossed").collect()  # a path a file, as any listing
    if listed:
        paths = [r.path for r in listed]
        # the vectorised reader takes a column's type by its name, so crossed names need the other
        with field_ids(spark, vectorized=not any(r.crossed for r in listed)):
            rows = _scan(spark, paths, schema).join(sized(drifting.select("file", "missing")), "file")
            filled = F.struct(*(
                F.when(F.array_contains("missing", f.metadata[ID]), F.lit(defaults.get(f.name)).cast(f.dataType)).otherwise(F.col("values")[f.name]).alias(f.name)
                for f in schema
            ))
            number = F.regexp_extract("file", r"^(\d+)\.parquet$", 1).cast("long")
            write_files(spark, rows.select(number.alias("file_no"), "row", filled.alias("values")), [_kept(f) for f in schema], folder)
    return before


def _kept(field: T.StructField, name: str | None = None, kind: str | None = None) -> Column:
    """A value under its field id, perhaps by another name or of another type."""
    value = F.col("values")[field.name]
    return (value.cast(kind) if kind else value).alias(name or field.name, metadata={ID: field.metadata[ID]})


def drifted_columns(schema: T.StructType, drift: int, swap: tuple[str, str], missing: set[str], kinds: dict[str, str]) -> list[Column]:
    """The columns of a file that drifts by the given bits: two names swapped, all but the
    first reversed, some missing, some of other types."""
    names = dict([swap, swap[::-1]]) if drift & NAMES else {}
    fields = [f for f in schema if not (drift & MISSING and f.name in missing)]
    if drift & ORDER:
        fields = fields[:1] + fields[:0:-1]
    return [_kept(f, names.get(f.name), kinds.get(f.name) if drift & TYPES else None) for f in fields]


def write_drifted(spark: SparkSession, ranked: DataFrame, folder: str, drift_of: Column, columns_of) -> None:
    """Rows (file_no, row, values) as files that drift as ``drift_of`` says. The rows are laid
    apart by drift once, so that each of the jobs (at most 16) reads its own."""
    fs, top = file_system(spark, folder)
    fs.mkdirs(top)
    apart = shared_dir(spark, keep=True)
    ranked.withColumn("_drift", drift_of).write.partitionBy("_drift").parquet(apart)
    stored = spark.read.schema(T.StructType([*ranked.schema.fields, T.StructField("_drift", T.IntegerType())])).parquet(apart)
    for (drift,) in sorted(stored.select("_drift").distinct().collect()):
        write_files(spark, stored.where(F.col("_drift") == drift), columns_of(drift), folder)
    remove(spark, apart)


def _field_text(value: Column, kind: T.DataType) -> Column:
    """A value as text: timestamps in microseconds since 1970 (UTC), doubles as the floor of
    2^20 times them (beyond the range of long: its ends), null as a question mark."""
    if kind == T.TimestampNTZType():
        days = F.datediff(value.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        seconds = (days * 24 + F.hour(value)) * 3600 + F.minute(value) * 60
        value = seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
    elif kind == T.DoubleType():
        value = F.floor(value * 1048576)
    return F.coalesce(value.cast("string"), F.lit("?"))


def digests(spark: SparkSession, folder: str, schema: T.StructType, key: str) -> DataFrame:
    """One row a file: rows, null values, and SHA-256 of the keys (comma-joined) and of the rows
    (newline-joined, fields joined by a bar), in the order of the rows. Files that have rows
    only."""
    nulls = sum((F.col("values")[f.name].isNull().cast("int") for f in schema), F.lit(0))
    line = F.concat_ws("|", *(_field_text(F.col("values")[f.name], f.dataType) for f in schema))
    rows = _scan(spark, [folder], schema)
    lines = rows.select("file", "row", _field_text(F.col("values")[key], schema[key].dataType).alias("key"), line.alias("line"), nulls.alias("nulls"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("file", "key", "line", "nulls")]
            for file, id_, text, missing in zip(*columns, strict=True):
                if now is None or file != now[0]:
                    if now:
                        yield _digest(now)
                    now = [file, 0, 0, hashlib.sha256(), hashlib.sha256()]
                between = b"" if not now[1] else b","
                now[3].update(between + id_.encode())
                now[4].update((b"\n" if between else b"") + text.encode())
                now[1] += 1
                now[2] += missing
        if now:
            yield _digest(now)

    kinds = "file string, n_rows bigint, n_nulls bigint, keys_sha256 string, rows_sha256 string"
    return lines.repartition("file").sortWithinPartitions("file", "row").select("file", "key", "line", "nulls").mapInArrow(hashed, kinds)


def _digest(state) -> pa.RecordBatch:
    file, n, nulls, keys, rows = state
    arrays = [pa.array([file]), pa.array([n], pa.int64()), pa.array([nulls], pa.int64()), pa.array([keys.hexdigest()]), pa.array([rows.hexdigest()])]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "n_rows", "n_nulls", "keys_sha256", "rows_sha256"])


def file_report(spark: SparkSession, folder: str, schema: T.StructType, before: DataFrame, key: str) -> DataFrame:
    """One row a file of the rewritten table: its digests, its drift and columns before and its
    columns now. Raises if a file still drifts."""
    after = store(footers(spark, folder, schema))
    if after.where("drift <> 0").limit(1).count():
        raise RuntimeError("a file still drifts")
    was = before.select("file", F.col("drift").alias("version"), F.col("columns").alias("start_columns"), (F.col("drift") != 0).alias("rewritten"))
    now = after.select("file", "path", "columns")
    return digests(spark, folder, schema, key).join(sized(was), "file").join(sized(now), "file")
