import hashlib
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from scriptloom.sources import tar

ROWS = [(f"s{i % 3}", f"k{i:04d}", e, (f"{i}/{e}" * (i % 7)).encode()) for i in range(900) for e in tar.REQUIRED] + [("s1", "no dots", "", None), ("s1", "ü.x", "long" * 40, b"1")]


def members(spark, rows=ROWS):
    return spark.createDataFrame(rows, tar.SCHEMA)


def key_rows(df):
    return sorted((r.shard, r.key, r.ext, bytes(r.payload)) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tar"))
    made = {r.shard: (r.members, r["bytes"]) for r in tar.write(members(spark), f"file:{path}").collect()}
    assert made == {s: (sum(r[0] == s for r in ROWS), sum(len(r[3] or b"") for r in ROWS if r[0] == s)) for s in ("s0", "s1", "s2")}
    return path


def test_round_trip(spark, folder):
    assert sorted(os.listdir(folder)) == [f"s{i}.tar{x}" for i in range(3) for x in ("", ".index")]
    want = sorted((s, k, e, p or b"") for s, k, e, p in ROWS if "." not in k)
    assert [r for r in key_rows(tar.read_members(spark, [folder])) if "." not in r[1] and "ü" not in r[1]] == want
    with tarfile.open(f"{folder}/s1.tar") as archive:  # any reader of tar files can read them
        assert len(archive.getnames()) == sum(r[0] == "s1" for r in ROWS)
    split = spark.read.format("tar_samples").option("path", f"file:{folder}").option("split_bytes", 100_000).load()
    assert key_rows(split) == key_rows(tar.read_members(spark, [folder]))
    assert split.rdd.getNumPartitions() > 6


def test_one_key_reads_little(spark, folder):
    """One row group of the index, and the payloads of its members that are asked for."""
    reader = tar._Reader({"path": f"{folder}/s1.tar", "key": "k0400"})
    (part,) = reader.partitions()
    tables = list(reader._places(*tar.store_of(part.value[0]), *part.value[1:]))
    assert 0 < sum(t.num_rows for t in tables) <= tar.GROUP  # of 902
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [r["ext"] for r in rows] == sorted(tar.REQUIRED)
    assert tar.read_members(spark, [folder], key="k0400", shard="s1").count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert tar.read_members(spark, [folder]).where("key = 'k0400' and shard = 's1'").count() == 3
        assert tar.read_members(spark, [folder]).where("key = 'k0400' and shard = 's2'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archives_without_or_with_a_stale_index(spark, folder, tmp_path):
    for name in ("s0.tar", "s1.tar", "s1.tar.index"):
        (tmp_path / name).write_bytes(open(f"{folder}/{name}", "rb").read())
    with tarfile.open(tmp_path / "s1.tar", "a") as archive:
        archive.addfile(tarfile.TarInfo("late.txt"))
    (tmp_path / "s1.tar").write_bytes((tmp_path / "s1.tar").read_bytes() + b"\0" * 10240)
    got = key_rows(tar.read_members(spark, [str(tmp_path)]))
    assert ("s1", "late", "txt", b"") in got and len(got) == 1 + sum(r[0] in ("s0", "s1") for r in ROWS)


def test_a_failing_job_leaves_nothing_and_the_old_archives(spark, folder):
    before = {f: hashlib.md5(open(f"{folder}/{f}", "rb").read()).hexdigest() for f in os.listdir(folder)}
    bad = members(spark).withColumn("payload", F.when(F.col("key") == "k0899", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="broken"):
        tar.write(bad, folder)
    assert {f: hashlib.md5(open(f"{folder}/{f}", "rb").read()).hexdigest() for f in os.listdir(folder)} == before
    apart = members(spark, [("x", f"k{i}", "t", b"1") for i in range(8)]).repartition(4)
    with pytest.raises(Exception, match="tar.write|several tasks"):
        apart.write.format("tar_samples").option("path", folder).mode("append").save()
    assert sorted(os.listdir(folder)) == sorted(before)


def test_a_task_that_fails_once_leaves_no_part(tmp_path):
    """The attempt that failed wrote under its own name; the commit takes the other's."""
    import pyarrow as pa

    writer = tar._Writer({"path": str(tmp_path)})

    def batches(fail):
        yield pa.RecordBatch.from_pylist([{"shard": "a", "key": "k", "ext": "t", "payload": b"1"}], tar.ARROW)
        if fail:
            raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(batches(True))
    message = writer.write(batches(False))
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".tar")]
    writer.commit([message, None])
    assert sorted(os.listdir(tmp_path)) == ["a.tar", "a.tar.index"]
    with tarfile.open(tmp_path / "a.tar") as archive:
        assert archive.getnames() == ["k.t"]


def test_empty_tables(spark, tmp_path):
    assert tar.write(members(spark).limit(0), str(tmp_path)).collect() == []
    assert tar.read_members(spark, [str(tmp_path)]).collect() == []
