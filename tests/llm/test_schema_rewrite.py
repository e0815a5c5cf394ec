import hashlib
import math
import os
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import queries, schema_rewrite
from scriptloom.llm.queries import CLIENTS

NAMES = [n for n, _ in CLIENTS]


def plain(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def by_hand(rows):
    """What each final file holds, from the rows of clients as tuples."""
    crc = lambda x: zlib.crc32(x.encode())
    rows = sorted(rows, key=lambda r: (crc("" if r[0] is None else str(r[0])), -1 if r[0] is None else r[0]))
    per, files = 1 + len(rows) // 500, []
    for no in range(math.ceil(len(rows) / per)):
        version = crc(f"42:{no}") % 24
        version = 0 if version > 15 else version
        mine, start = [], list(NAMES)
        if version & 1:
            start[4], start[5] = start[5], start[4]
        if version & 4:
            start = [n for n in start if n not in ("nation_id", "source")]
        if version & 2:
            start = start[:1] + start[:0:-1]
        for r in rows[no * per : (no + 1) * per]:
            r = list(r)
            if version & 4:
                r[7], r[2] = -1, "none"
            if version & 8 and r[9] is not None:
                r[9] = float(np.float32(r[9]))
            mine.append(r)
        lines = []
        for r in mine:
            r = list(r)
            r[3] = None if r[3] is None else (r[3] - datetime(1970, 1, 1)) // pd.Timedelta(1, "us")
            r[9] = None if r[9] is None else math.floor(1048576 * r[9])
            lines.append("|".join("?" if x is None else str(x) for x in r))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        ids = ",".join("?" if r[0] is None else str(r[0]) for r in mine)
        files.append((no, version, len(mine), sum(x is None for r in mine for x in r), sha(ids), sha("\n".join(lines)), ",".join(start), ",".join(NAMES), version != 0))
    return files


def found(df):
    rows = sorted(df.collect(), key=lambda r: r.file_no)
    return rows, [(r.file_no, r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in rows]


def test_query_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/clients.parquet").select(*NAMES).collect()]
    made, got = found(queries.op12_schema_rewrite(spark, sf))
    assert got == by_hand(rows)
    assert {r.version for r in made} == set(range(16))
    folder = os.path.dirname(plain(made[0].path))
    assert sorted(f"{folder}/{n}" for n in os.listdir(folder) if not n.startswith((".", "_"))) == sorted(plain(r.path) for r in made)
    for r in made[:40]:
        file = pq.ParquetFile(plain(r.path))
        assert [int(f.metadata[b"PARQUET:field_id"]) for f in file.schema_arrow] == list(range(1, 11))
        assert file.schema_arrow.names == NAMES and file.metadata.num_rows == r.n_rows
        assert [file.schema.column(i).physical_type for i in (7, 9)] == ["INT64", "DOUBLE"]
    assert spark.conf.get("spark.sql.parquet.fieldId.read.enabled") == "false"


def clients(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'nation_id' else t}" for n, t in CLIENTS))


def test_nulls_ties_long_texts_and_other_columns(spark, tmp_path):
    when = datetime(2024, 3, 31, 2, 30, 0, 123456)
    rows = [(None,) * 10, (1, 2, "s", when, "n" * 200_000, "é|\n", "", 3, None, -0.1), (1, None, None, None, None, None, None, None, None, None)]
    rows += [(i, i, "s", datetime(1969, 12, 31, 23, 59, 59), "n", "e", "c", i, "g", i / 7) for i in range(2, 60)] + [(70, *[None] * 9)] * 3
    rows[2] = (2000, *rows[2][1:])
    df = clients(spark, rows).selectExpr("*", "1 as file_no", "2 as row", "'x' as `values`", "3 as _file_no", "4 as k0")
    df.write.parquet(f"{tmp_path}/clients.parquet")
    made, got = found(queries.op12_schema_rewrite(spark, str(tmp_path)))
    assert got == by_hand(rows)
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/none/clients.parquet")
    assert queries.op12_schema_rewrite(spark, f"{tmp_path}/none").collect() == []


def test_untouched_files_stay_and_a_second_run_changes_nothing(spark, tmp_path):
    schema = schema_rewrite.evolved_schema([("id", "bigint"), ("a", "string"), ("b", "double"), ("c", "bigint")])
    df = spark.createDataFrame([(i, f"t{i}" if i % 3 else None, i / 2, -i) for i in range(40)], "id long, a string, b double, c long")
    ranked, n = schema_rewrite.ordered_files(df, schema, [F.col("id")], lambda n: 10)
    folder = f"{tmp_path}/t"
    columns = lambda d: schema_rewrite.drifted_columns(schema, d, ("a", "id"), {"a"}, {"b": "float"})
    schema_rewrite.write_drifted(spark, ranked, folder, F.col("file_no").cast("int") * 5, columns)  # 0, 5, 10, 15
    seen = {f: (os.stat(f"{folder}/{f}").st_mtime_ns, os.stat(f"{folder}/{f}").st_ino) for f in os.listdir(folder)}
    before = schema_rewrite.rewrite(spark, folder, schema, {"a": "none"})
    drift = {r.file: (r.drift, r.missing) for r in before.collect()}
    assert n == 40 and drift == {"00000000.parquet": (0, []), "00000001.parquet": (5, [2]), "00000002.parquet": (10, []), "00000003.parquet": (15, [2])}
    now = {f: (os.stat(f"{folder}/{f}").st_mtime_ns, os.stat(f"{folder}/{f}").st_ino) for f in os.listdir(folder)}
    assert set(now) == set(seen) and [f for f in sorted(now) if f.endswith(".parquet") and now[f] == seen[f]] == ["00000000.parquet"]
    rows = sorted(tuple(r) for r in spark.read.parquet(folder).collect())
    assert rows == [(i, "none" if i // 10 % 2 else f"t{i}" if i % 3 else None, i / 2, -i) for i in range(40)]
    again = schema_rewrite.rewrite(spark, folder, schema, {"a": "none"})
    assert {r.drift for r in again.collect()} == {0}
    assert {f: (os.stat(f"{folder}/{f}").st_mtime_ns, os.stat(f"{folder}/{f}").st_ino) for f in os.listdir(folder)} == now


def test_refuses_files_without_ids(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    with pytest.raises(Exception, match="without field ids"):
        schema_rewrite.footers(spark, f"{tmp_path}/t", schema_rewrite.evolved_schema([("id", "bigint")])).collect()
