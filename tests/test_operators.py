import json

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import corpus, labels, metrics, packing, sampling, sequences
from scriptloom.sources import paths, tables, tar


def test_packing(spark):
    rows = spark.createDataFrame([("a", i, 4) for i in range(7)] + [("b", 0, None)], "g string, i int, size int")
    got = {(r.g, r.i): r.shard_index for r in packing.shard_pack(rows, "size", 10, ["g"], ["i"]).collect()}
    assert [got["a", i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2] and got["b", 0] == 0
    got = {(r.g, r.i): r.batch_index for r in packing.submit_pack(rows, "size", 10, 3, ["g"], ["i"]).collect()}
    assert [got["a", i] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3]
    assert packing.shard_pack(rows.limit(0), "size", 10, ["g"], ["i"]).collect() == []


def test_chunk_contexts(spark):
    rows = spark.createDataFrame([("c", i) for i in range(10)] + [("d", i) for i in range(3)], "chapter string, i int")
    got = {}
    for r in sequences.chunk_context(rows, "chapter", "i", 4, 3).collect():
        got.setdefault((r.chapter, r.chunk), []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {("c", 0): [4, 5, 6], ("c", 1): [1, 2, 3, 8, 9], ("c", 2): [5, 6, 7]}


@pytest.mark.parametrize("n, want", [(3, [0, 5, 9]), (1, [0]), (10, list(range(10))), (2, [0, 9]), (0, [0])])
def test_even_spaced(spark, n, want):
    rows = spark.createDataFrame([(f"c{i:02d}",) for i in range(10)], "c string")
    assert sorted(r.position for r in sequences.even_spaced(rows, "c", n).collect()) == want


def test_neighbours(spark):
    rows = spark.createDataFrame([("c", i, i not in (3, 4, 8)) for i in range(10)], "g string, i int, ok boolean")
    got = {r.i: r.neighbours for r in sequences.valid_neighbours(rows, "g", "i", "i", F.col("ok")).collect()}
    assert got[3] == [1, 2, 5, 6] and got[0] == [1, 2] and got[8] == [6, 7, 9] and got[5] == [1, 2, 6, 7]


def test_neighbours_across_tasks(spark):
    """One hot group and small ones, cut by a range exchange anywhere; runs without valid rows
    that span tasks."""
    import random

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), i, None if rng.random() < 0.1 else rng.random() < 0.3 and not 60 < i < 130) for i in range(240)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        df = spark.createDataFrame(rows, "g string, i int, ok boolean").withColumn("k", F.concat(F.lit("k"), "i"))
        got = {r.i: r.neighbours for r in sequences.valid_neighbours(df, "g", "i", "k", F.col("ok"), 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g, i, _ in rows:
        valid = [j for h, j, ok in rows if h == g and ok and j != i]
        assert got[i] == [f"k{j}" for j in [j for j in valid if j < i][-3:] + [j for j in valid if j > i][:3]]
    assert sequences.valid_neighbours(df.limit(0), "g", "i", "k", F.col("ok")).collect() == []


def test_samples_repeat_with_their_seed(spark):
    rows = spark.range(200).select(F.col("id").alias("k"))
    draw = lambda s: [r.k for r in sampling.sample(rows.repartition(5), "k", 20, s).collect()]
    assert draw(1) == draw(1) and draw(1) != draw(2)
    ranks = sampling.interleaved(rows, "k", 1, 3).groupBy("rank").count().collect()
    assert sorted(r["count"] for r in ranks) == [66, 67, 67]


def test_relabelling(spark):
    samples = spark.createDataFrame([("a", "old", b"m1"), ("b", "old", b"m2"), ("c", "old", b"m3")], "key string, formatted string, mel binary")
    rows = spark.createDataFrame([("a", "u", "A.", None, 1), ("b", "u", "B.", "ok", 1), ("b", "u", "B.", "failed", 2)], tables.LABELS)
    kept = labels.relabelled(samples, rows, drop_unlabelled=True).collect()
    assert [(r.key, r.formatted, bytes(r.mel)) for r in kept] == [("a", "A.", b"m1")]
    with pytest.raises(Exception, match="no label for c"):
        labels.relabelled(samples, rows).collect()
    counts = labels.relabel_counts(samples, rows).first()
    assert counts.asDict() == {"sample_total": 3, "sample_kept": 1, "sample_failed": 1, "sample_unlabelled": 1, "member_relabelled": 2}


def test_validation_life_cycle(spark):
    utterances = spark.createDataFrame(
        [(k, "c", t, 1, None, None, None) for k, t in (("u1", "it is so"), ("u2", "mister x"), ("u3", "no"), ("u4", "late"))],
        "key string, chapter string, unformatted string, attempts int, formatted string, validation string, failure string",
    )
    requests = spark.createDataFrame(
        [("r1", ["u1", "u2", "u3"], "succeeded", "end_turn"), ("r2", ["u3"], "errored", None), ("r3", ["u4"], "submitted", None)],
        "custom_id string, target_ids array<string>, state string, stop_reason string",
    )
    answers = spark.createDataFrame([("r1", json.dumps({"u1": "It is so.", "u2": "Mr. Y", "u3": "No!", "u9": "?"})), ("r3", "{}")], "custom_id string, text string")
    got = {r.key: (r.formatted, r.validation, r.failure) for r in labels.validated(utterances, requests, answers).collect()}
    assert got == {"u1": ("It is so.", "ok", None), "u2": ("Mr. Y", "failed", "alignment"), "u3": ("No!", "failed", "no_response"), "u4": (None, None, None)}
    extra = {tuple(r.extra_ids) for r in labels.judged_targets(requests, answers).where("custom_id = 'r1'").collect()}
    assert extra == {("u9",)}
    judged = labels.validated(utterances, requests, answers)
    more = labels.retry_requests(judged, requests, 3).collect()
    assert sorted((r.custom_id, r.context_ids) for r in more) == [("retry_u2_a2", ["u1"]), ("retry_u3_a2", ["u1"])]
    assert {r.plan for r in labels.retry_plan(judged, requests, 1).collect()} == {"capped"}
    shipped = {r.key: (r.formatted, r.validation) for r in labels.finalized(judged).collect()}
    assert shipped["u4"] == ("late", "failed") and shipped["u1"] == ("It is so.", "ok")


def test_metrics(spark):
    rows = spark.createDataFrame([("s", i, *x) for i, x in enumerate([(None, 1, 9.0), (1, 1, 2.0), (2, 1, 4.0), (3, 3, 6.0)])] + [("t", 0, 5, 5, 8.0)], "sample string, pos int, label int, pred int, loss double")
    r = metrics.loss_decomposition(rows, [], "sample", "pos", "label", "pred", "loss").first()
    assert (r.first_loss, r.rest_loss, r.n_positions, r.n_hits) == (5.0, 5.0, 4, 3)
    assert r.miss_loss == 4.0 and round(r.hit_loss, 6) == round(16 / 3, 6)
    pairs = spark.createDataFrame([("a", ["x", "y"], ["x"]), ("a", ["z"], ["z"]), ("b", [], ["q"])], "g string, r array<string>, h array<string>")
    got = {r.g: r.wer for r in metrics.word_error_rate(pairs, ["g"], F.col("r"), F.col("h")).collect()}
    assert round(got["a"], 6) == round(1 / 3, 6) and got["b"] != got["b"]
    names = spark.range(1).select(metrics.warnings(F.lit(1.0), F.lit(2.0), F.lit(0.6), F.lit(0.9), F.lit(60.0), F.lit(None).cast("double")).alias("w")).first().w
    assert names == ["collapse", "end_collapse", "entropy_high", "logits_high"]
    with pytest.raises(ValueError):
        metrics.stage_exit("other", *[F.lit(1)] * 4, 1, 1)


def test_vocabulary(spark):
    words = corpus.words_of(spark.createDataFrame([(1, "b a b"), (2, ""), (3, "zz a")], "k int, t string"), "k", "t")
    vocabulary = corpus.dense_ids(corpus.token_union(words.where("key = 1"), extra=["#"]))
    assert {r.token: r.id for r in vocabulary.collect()} == {"#": 0, "a": 1, "b": 2}
    coded = corpus.encode(words, vocabulary)
    assert {r.key: r.ids for r in coded.collect()} == {1: [2, 1, 2], 2: [], 3: [1]}
    assert {r.key: r.text for r in corpus.decode(coded, vocabulary).collect()} == {1: "b a b", 2: "", 3: "a"}


@pytest.mark.parametrize("head", [1 << 20, 300, 40])
def test_elements_by_a_head_and_an_exchanged_tail(spark, monkeypatch, head):
    """Frequent words are replaced in place, the others return to their places."""
    import random

    monkeypatch.setattr(corpus, "HEAD_BYTES", head)
    rng = random.Random(4)
    ids = {f"w{i}": i for i in range(60)}
    rows = [(k, [f"w{int(rng.paretovariate(0.7))}" if rng.random() < 0.9 else rng.choice(["?", None]) for _ in range(rng.randint(0, 30))]) for k in range(120)] + [(7, ["w1"]), (200, None)]
    df = spark.createDataFrame(rows, "key int, words array<string>")
    coded = corpus.encode(df, spark.createDataFrame(list(ids.items()), "token string, id long"))
    want = sorted((k, [ids[w] for w in words or [] if w in ids]) for k, words in rows)
    assert sorted((r.key, r.ids) for r in coded.collect()) == want
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (head < 1 << 20)
    back = corpus.decode(coded, spark.createDataFrame(list(ids.items()), "token string, id long"))
    assert sorted((r.key, r.text) for r in back.collect()) == [(k, " ".join(f"w{i}" for i in v)) for k, v in want]


def test_transcripts_and_lists(spark, tmp_path):
    folder = tmp_path / "in" / "train" / "1" / "2"
    folder.mkdir(parents=True)
    (folder / "1-2.trans.txt").write_text("1-2-0001 SECOND LINE\n\n1-2-0000 IT'S A\n1-2-0002\n")
    (folder / "1-2-0000.flac").write_bytes(b"fLaC" + bytes(4) + bytes(10) + (16000 << 44 | 24000).to_bytes(8, "big") + bytes(16))
    rows = tables.transcripts(spark, str(tmp_path / "in"))
    assert sorted((r.key, r.chapter, r.utt, r.text) for r in rows.collect()) == [("1-2-0000", "1-2", "0000", "IT'S A"), ("1-2-0001", "1-2", "0001", "SECOND LINE")]
    assert tables.transcripts(spark, str(tmp_path / "in"), keep_empty=True).count() == 3
    assert [r.key for r in tables.with_audio(rows, str(tmp_path / "in")).collect()] == ["1-2-0000"]
    assert tables.flac_seconds(spark, str(tmp_path / "in")).first().seconds == 1.5
    chapter = tables.chapters(rows).first()
    assert [u.text for u in chapter.utterances] == ["it's a", "second line"]
    (tmp_path / "list.txt").write_text("# c\n\n b.tar \na.tar\n")
    assert [tuple(r) for r in paths.shard_list(spark, str(tmp_path / "list.txt")).orderBy("position").collect()] == [(0, "b.tar"), (1, "a.tar")]
    for i in (0, 2):
        (tmp_path / f"s_00{i}.tar").write_bytes(b"")
    names = [p.rpartition("/")[2] for p in paths.expand(spark, f"{tmp_path}/s_{{000..003}}.tar")]
    assert names == ["s_000.tar", "s_002.tar"]


def test_heads_read_no_more_than_they_give(spark, tmp_path):
    from scriptloom.sources import heads

    (tmp_path / "a" / "b").mkdir(parents=True)
    with open(tmp_path / "a" / "b" / "long.flac", "wb") as f:
        f.write(b"fLaC")
        f.seek(1 << 33)  # 8 GB of nothing: a reader of whole files would not end
        f.write(b"x")
    (tmp_path / "a" / "short.flac").write_bytes(b"fL")
    (tmp_path / "other.txt").write_text("no")
    for root in (str(tmp_path), f"file:{tmp_path}"):
        rows = sorted((r.path.rpartition("/")[2], r.length, bytes(r.head)) for r in heads.heads(spark, root, 6, ".flac").collect())
        assert rows == [("long.flac", (1 << 33) + 1, b"fLaC\0\0"), ("short.flac", 2, b"fL")]
    assert heads.heads(spark, str(tmp_path), 6, ".none").collect() == []


def test_losses_of_slices_equal_those_of_whole_logits(spark):
    """Any slicing, in any order; ties, minus infinity, large logits, labels outside."""
    import math
    import random

    rng, inf = random.Random(8), float("-inf")
    rows, want = [], {}
    for k in range(60):
        x = [rng.choice([rng.uniform(-5, 5), 700.0, 3.0, inf]) for _ in range(rng.randint(1, 40))]
        x[rng.randrange(len(x))] = rng.choice([3.0, 900.0])
        label = rng.randrange(len(x) + 2)
        top = max(x)
        e = [math.exp(v - top) for v in x]
        norm = math.log(sum(e))
        entropy = norm - sum(p * (v - top) for p, v in zip(e, x) if p) / sum(e)
        want[k] = (norm + top - x[label] if label < len(x) else None, x.index(top), entropy)
        cuts = sorted({0, len(x), *(rng.randint(0, len(x)) for _ in range(rng.randint(0, 6)))})
        rows += [(k, a, x[a:b], label) for a, b in zip(cuts, cuts[1:])]
    rng.shuffle(rows)
    got = metrics.sliced_losses(spark.createDataFrame(rows, "k int, start int, logits array<double>, label int"), ["k"], "start", "logits", "label")
    for r in got.collect():
        loss, pred, entropy = want[r.k]
        assert r.pred == pred and abs(r.entropy - entropy) < 1e-9
        assert (r.loss is None) == (loss is None) and (loss is None or r.loss == loss or abs(r.loss - loss) < 1e-9)


def test_scratch_tables_go(spark):
    import os

    from scriptloom import storage

    files = lambda df: [f.removeprefix("file://") for f in df.inputFiles()]
    kept = storage.written(spark.range(3))
    with storage.scratch(spark):
        outer = storage.written(spark.range(4))
        with storage.scratch(spark):
            inner = storage.written(spark.range(5))
            held = {k: files(df) for k, df in {"kept": kept, "outer": outer, "inner": inner}.items()}
        assert [any(map(os.path.exists, held[k])) for k in ("kept", "outer", "inner")] == [True, True, False]
    assert [any(map(os.path.exists, held[k])) for k in ("kept", "outer")] == [True, False] and kept.count() == 3


def test_label_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"key":"a","formatted":"1"}\n{"key":"a","formatted":"2","validation":"failed"}\n{"key":"b","formatted":"3"}\n')
    rows = tables.labels(spark, str(tmp_path / "l.jsonl"))
    assert {r.key: r.formatted for r in labels.latest_labels(rows, "line").collect()} == {"a": "2", "b": "3"}
    assert {r.key: r.failed for r in labels.label_verdicts(rows).collect()} == {"a": True, "b": False}
    tables.write_labels(rows.drop("line"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    tables.write_results(rows, str(tmp_path / "r.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).count() == 3
    assert tables.checksums(spark, str(tmp_path / "l.jsonl")).first().bytes == (tmp_path / "l.jsonl").stat().st_size


def test_the_last_label_wins_over_files_and_splits(spark, tmp_path):
    """File order without a sort: files in several splits, keys again in later files."""
    want = {}
    for f in ("a.json", "a.json-b", "b.json"):
        rows = [(f"k{i * 7 % 40}", f"{f}:{i}") for i in range(300)]
        (tmp_path / f).write_text("".join(f'{{"key":"{k}","formatted":"{v}"}}\n' for k, v in rows))
        want |= dict(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tables.labels(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        assert {r.key: r.formatted for r in labels.latest_labels(rows, "line").collect()} == want
        assert [r.formatted for r in rows.orderBy("line").collect()] == [f"{f}:{i}" for f in ("a.json", "a.json-b", "b.json") for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tar_source(spark, tmp_path):
    rows = [("s0", k, e, f"{k}/{e}".encode()) for k in ("a", "b.c") for e in tar.REQUIRED] + [("s1", "x", "mel.npy", b"only")]
    out = tar.write(spark.createDataFrame(rows, tar.SCHEMA), str(tmp_path)).collect()
    assert sorted((r.shard, r.members) for r in out) == [("s0", 6), ("s1", 1)]
    assert sorted(p.name for p in tmp_path.glob("*.tar")) == ["s0.tar", "s1.tar"] and not list(tmp_path.glob(".*.part"))
    files = [f"{tmp_path}/s0.tar", f"{tmp_path}/s1.tar"]
    by_suffix = tar.samples(tar.read_members(spark, files, "suffix")).collect()
    assert sorted(r.key for r in by_suffix) == ["a", "b.c"]
    assert [r.key for r in tar.samples(tar.read_members(spark, files)).collect()] == ["a"]
    assert tar.read_members(spark, files, "suffix").where("shard = 's1'").count() == 1
    verdicts = spark.createDataFrame([("a", False, "F", "U"), ("b.c", True, None, None)], "key string, failed boolean, new_formatted string, new_unformatted string")
    new = {r.ext: bytes(r.payload) for r in tar.relabel(tar.read_members(spark, files, "suffix"), verdicts).collect()}
    assert new == {"mel.npy": b"a/mel.npy", "unformatted.txt": b"U", "formatted.txt": b"F"}


def test_streams(spark, tmp_path):
    from scriptloom.streaming import metric_log

    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"custom_id": f"r{i}", "text": "{}", "stop_reason": "end_turn"}))
    metric_log.collect_responses(spark, folder, table, state)
    (tmp_path / "in" / "9.json").write_text(json.dumps({"custom_id": "r9", "text": "{}"}))
    metric_log.collect_responses(spark, folder, table, state)
    assert sorted(r.custom_id for r in spark.read.parquet(table).collect()) == ["r0", "r1", "r2", "r9"]
    asked = spark.createDataFrame([("a", None), ("a", "r0"), ("a", "r1"), ("a", "r1"), ("b", "r9"), ("b", "late"), (None, "last")], "batch string, custom_id string")
    waits = []

    def arrives(seconds):  # what comes while the poller sleeps
        waits.append(seconds)
        name = ["late", "last"][len(waits) - 1]
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"custom_id": name, "stop_reason": "refusal"}))

    states = {r.batch: r.state for r in metric_log.batch_states(asked, table).collect()}
    assert states == {"a": "ended", "b": "in_progress", None: "in_progress"}
    stopped = metric_log.collect_until_ended(asked, folder, table, state, 5.0, 0.0, arrives)
    assert not waits and {r.batch: r.state for r in stopped.collect()} == states
    ended = metric_log.collect_until_ended(asked, folder, table, state, 5.0, None, arrives)
    assert waits == [5.0, 5.0]
    assert sorted((r.batch or "", r.requests, r.collected, r.state) for r in ended.collect()) == [("", 1, 1, "ended"), ("a", 2, 2, "ended"), ("b", 2, 2, "ended")]
    (tmp_path / "none").mkdir()
    fresh = metric_log.collect_until_ended(asked, str(tmp_path / "none"), str(tmp_path / "t2"), str(tmp_path / "c2"), 5.0, 0.0, arrives)
    assert {(r.collected, r.state) for r in fresh.collect()} == {(0, "in_progress")}
    assert metric_log.collect_until_ended(asked.limit(0), str(tmp_path / "none"), str(tmp_path / "t2"), str(tmp_path / "c2"), 5.0, None, arrives).isEmpty()
    log = spark.createDataFrame([("2024-01-01 00:00:10", 50, "train", 1.0), ("2024-01-01 00:00:20", 50, "train", 3.0), ("2024-01-01 00:00:30", 51, "train", 9.0), ("2024-01-01 00:00:40", 51, "eval", 5.0)], "t string, step int, phase string, value double")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")).withColumn("ts", F.to_timestamp("t")).drop("t")
    q = metric_log.flushed_stream(stream, 50).writeStream.format("memory").queryName("flushed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.phase, r.step, r["mean"]) for r in spark.table("flushed").collect()) == [("eval", 51, 5.0), ("train", 50, 2.0)]


def test_sets(spark):
    from scriptloom.functions import models
    from scriptloom.operators import sets

    for most in (0, 1, 2, 37, 100):
        for limit in (0, 1, 2, 3, 36, 37, 38, 64, 100, 1000):
            asked = []
            assert sets.largest_accepted(lambda n: asked.append(n) or n <= limit, most) == min(limit, most)
            assert len(asked) < 16 and all(1 <= n <= most for n in asked)
    assert sets.config_changes({"a": 1, "b": 2}, {"a": 1, "b": 3}, ["a", "b"]) == ["b"]
    row = spark.range(1).select(
        sets.disjoint(F.array(F.lit(1)), F.array(F.lit(2))).alias("d"),
        models.merge_entities(F.array(F.lit("it"), F.lit("is"), F.lit("so")), F.array(F.struct(F.lit(2).alias("end"), F.lit("a").alias("entity")), F.struct(F.lit(8).alias("end"), F.lit(".").alias("entity")))).alias("m"),
    ).first()
    assert row.d and row.m == ["a", "0", "."]


def test_principal_components_match_svd(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    components, shares = corpus.principal_components(rows, "embedding", 5)
    x = np.array([r.embedding for r in rows.collect()], float)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:5])
    assert np.allclose(np.abs((components * v[:5]).sum(axis=1)), 1, atol=1e-6)


def test_models_plug_in(spark):
    import io
    import wave

    import numpy as np

    from scriptloom.functions import models

    rows = spark.createDataFrame([(1, "we met anna and bob"), (2, ""), (3, None)], "i int, t string")
    tagger = lambda: lambda texts: [None if t is None else [i for i in (t.find("anna"), t.find("bob")) if i >= 0] for t in texts]
    got = {r.i: r.t for r in rows.select("i", models.proper_nouns(F.col("t"), tagger).alias("t")).collect()}
    assert got == {1: "we met Anna and Bob", 2: "", 3: None}
    upper = rows.select("i", models.model_column(F.col("t"), lambda: lambda x: [t and t.upper() for t in x], "string", 1).alias("t"))
    assert {r.i: r.t for r in upper.collect()} == {1: "WE MET ANNA AND BOB", 2: "", 3: None}
    with pytest.raises(Exception, match="answer every input"):
        rows.select(models.model_column(F.col("t"), lambda: lambda x: [], "string")).collect()

    def sound(rate, channels, seconds=0.5):
        t = np.arange(int(rate * seconds)) / rate
        tone = np.sin(2 * np.pi * 440 * t)
        frames = np.stack([tone, 0.5 * tone][:channels], axis=1)
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes((frames * 30000).astype("<i2").tobytes())
        return out.getvalue()

    def load():
        def decode(content):
            if content is None:
                return None
            with wave.open(io.BytesIO(content)) as f:
                return np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()) / 32768, f.getframerate()

        return lambda contents: [decode(c) for c in contents]

    files = spark.createDataFrame([(1, sound(16000, 1)), (2, sound(44100, 2)), (3, sound(8000, 1)), (4, None)], "i int, content binary")
    got = {r.i: r.a for r in files.select("i", models.audio_column(F.col("content"), load).alias("a")).collect()}
    assert got[4] is None
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 16000) * 30000 / 32768
    for i, level in ((1, 1), (2, 0.75), (3, 1)):
        assert got[i].seconds == 0.5 and np.abs(np.array(got[i].wave) - level * tone)[50:-50].max() < 0.01


def test_generation_rows_keep_padding_behind(spark):
    from scriptloom.functions import tensors

    row = spark.range(1).select(
        tensors.prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), -1).alias("p"),
        tensors.extended(F.array(F.lit(1), F.lit(-1)), F.array(F.lit(7), F.lit(8), F.lit(9)), F.lit(4), F.lit(2), F.lit(0)).alias("x"),
    ).first()
    assert row.p == [1, 2, -1, 3, -1] and row.x == [1, -1, 7, 8, 0, 0]


def test_prepare_refuses_other_settings(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("r",)], "custom_id string")
    with pytest.raises(ValueError, match="overlap"):
        labels.prepared({"overlap": 2, "root": "x"}, {"overlap": 3, "root": "x"}, *rows, rows)
    again = labels.prepared({"overlap": 3}, {"overlap": 3}, *rows, rows)
    assert [sorted(r[0] for r in t.collect()) for t in again] == [["a", "b"], ["r"]]
    assert [t.count() for t in labels.prepared(None, {"overlap": 3}, *rows)] == [2, 1]


def test_positions_over_many_partitions(spark):
    from scriptloom import storage

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        rows = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("v"), F.lit("x").alias("_p"))
        assert rows.rdd.getNumPartitions() > 0
        got = storage.with_position(rows.drop("_p"), "v").collect()
        assert sorted((r.v, r.position) for r in got) == [(i, i) for i in range(2000)]
        assert storage.with_position(rows.where("v < 0"), "v").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_scans_over_any_cut(spark, partitions):
    """Groups that span tasks, tasks that span groups, nulls at each end."""
    import random

    rng = random.Random(partitions)
    rows = [(g, i, None if rng.random() < 0.2 or i < 2 else rng.random()) for g, n in ((None, 3), ("a", 400), ("b", 1), ("c", 150), ("d", 2)) for i in range(n)]
    want = {}
    for g, i, x in rows:
        s, t = want.get((g, i - 1), (None, None))
        want[g, i] = (s, t) if x is None else (x if s is None else 0.9 * s + 0.1 * x, x if t is None else t + x)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, i int, x double")
        ema = {(r.g, r.i): r.ema for r in sequences.moving_average(df, "x", 0.9, ["g"], ["i"]).collect()}
        total = {(r.g, r.i): r.t for r in metrics.cumulative(df, ["g"], "i", "x", "t").collect()}
        whole = [r.t for r in sorted(metrics.cumulative(df.where("g = 'a'"), [], "i", "x", "t").collect(), key=lambda r: r.i)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(ema) == set(total) == set(want)
    assert all(w is None if t is None else abs(w - t) < 1e-9 for w, t in zip(whole, [total["a", i] for i in range(400)], strict=True))
    for k, (s, t) in want.items():
        for got, w in ((ema[k], s), (total[k], t)):
            assert got is None if w is None else abs(got - w) < 1e-9
    assert metrics.cumulative(df.limit(0), ["g"], "i", "x", "t").collect() == []


def test_losses_by_type_are_those_of_positions(spark):
    import random

    rng = random.Random(4)
    types = {(a, b): (rng.choice("xyz"), rng.random()) for a in "abc" for b in "xyz"}
    samples = [[rng.choice(sorted(types)) for _ in range(n)] for n in (0, 1, 1, 2, 5, 40)]
    rows = [(i, pos, *k, *types[k]) for i, ks in enumerate(samples) for pos, k in enumerate(ks)]
    positions = spark.createDataFrame(rows, "sample int, pos int, prev string, cur string, pred string, loss double")
    want = metrics.loss_decomposition(positions, [], "sample", "pos", "cur", "pred", "loss").first()
    at = spark.createDataFrame([(ks,) for ks in samples] + [(None,)], "at array<struct<prev:string,cur:string>>")
    table = spark.createDataFrame([(*k, *v) for k, v in types.items()], "prev string, cur string, pred string, loss double")
    got = metrics.loss_decomposition_by_type(at, "at", table, ["prev", "cur"], "pred", "loss").first()
    assert got.asDict() == pytest.approx(want.asDict())
    none = metrics.loss_decomposition_by_type(at.limit(0), "at", table, ["prev", "cur"], "pred", "loss").first()
    assert none.first_loss is None and none.n_positions == 0


def test_bounded_shuffle(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("shard"), F.lit("x").alias("place_of"))
    got = sampling.buffered(rows.repartition(7), "k", 20, 5, "shard", "k").collect()
    assert sorted(r.stream for r in got) == sorted(r.place for r in got) == list(range(500))
    assert [r.k for r in sorted(got, key=lambda r: r.stream)] == sorted(range(500), key=lambda k: (k % 3, k))
    assert all(abs(r.stream - r.place) < 20 for r in got) and sum(r.stream != r.place for r in got) > 400
    again = sampling.buffered(rows.coalesce(1), "k", 20, 5, "shard", "k").collect()
    assert sorted(got) == sorted(again)
    assert all(r.stream == r.place for r in sampling.buffered(rows, "k", 1, 5, "shard", "k").collect())
    ties = spark.createDataFrame([(None,), (None,), (1,), (1,)], "k long")
    assert sorted(r.place for r in sampling.buffered(ties, "k", 3, 5, "k").collect()) == [0, 1, 2, 3]
    assert sampling.buffered(rows.limit(0), "k", 3, 5, "k").collect() == []
    with pytest.raises(ValueError):
        sampling.buffered(rows, "k", 0, 5, "k")
