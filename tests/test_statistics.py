"""Counts that grow with the corpus against those of the whole."""

import shutil

from scriptloom.operators import corpus, statistics

ROWS = [("a", 1, ["x", "y", "x"]), ("a", 2, []), ("b", 3, ["y", "y", "y"]), ("b", 4, ["z"]), ("c", 5, ["x", "z"]), ("c", 6, None), ("empty", 7, [])]


def whole(spark, rows):
    return spark.createDataFrame(rows, "shard string, key int, words array<string>")


def same(found, want):
    assert found.columns == want.columns
    for a, b in zip(found.first(), want.first(), strict=True):
        assert a == b or abs(a - b) < 1e-12


def test_parts_equal_the_whole_and_old_shards_are_not_read(spark, tmp_path):
    source, folder = str(tmp_path / "words"), str(tmp_path / "counts")
    whole(spark, ROWS).write.partitionBy("shard").parquet(source)
    read = lambda: spark.read.schema("key int, words array<string>, shard string").parquet(source)
    statistics.add(read().where("shard in ('a', 'empty')"), folder)
    assert statistics.counted_shards(spark, folder) == ["a", "empty"]
    for f in (tmp_path / "words" / "shard=a").glob("*.parquet"):
        f.write_bytes(b"unreadable")  # whoever reads it fails
    statistics.add(read(), folder)
    assert statistics.counted_shards(spark, folder) == ["a", "b", "c", "empty"]
    words = whole(spark, [r for r in ROWS if r[2] is not None]).select("key", "words")
    same(statistics.baselines(spark, folder, 10), corpus.baselines(words, 10))
    assert sorted(map(tuple, statistics.document_frequency(spark, folder).collect())) == sorted(map(tuple, corpus.document_frequency(words).collect()))
    assert sorted(map(tuple, statistics.vocabulary(spark, folder).collect())) == [("x", 0), ("y", 1), ("z", 2)]


def test_a_shard_that_is_counted_again_replaces_its_counts(spark, tmp_path):
    folder = str(tmp_path / "counts")
    statistics.add(whole(spark, ROWS), folder)
    statistics.add(whole(spark, ROWS), folder)  # nothing new
    statistics.add(whole(spark, [("b", 3, ["w"])]), folder, again=True)
    got = {(r.shard, r.token): r.n for r in statistics.counts(spark, folder).where("kind = 'unigram'").collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1, ("b", "w"): 1, ("c", "x"): 1, ("c", "z"): 1}
    shutil.rmtree(folder)
    assert statistics.counted_shards(spark, folder) == []
    statistics.add(whole(spark, []), folder)
