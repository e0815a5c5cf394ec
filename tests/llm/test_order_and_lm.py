import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import ngram_lm, queries, sentencepiece_codec, training_order
from scriptloom.llm.common import shared_dir
from scriptloom.llm.elias_fano import EliasFano, pack, unpack

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((1, 1), (1, 2**63), (5, 6), (1000, 1000), (1000, 10**6), (20000, 2**60), (3000, 50), (500, 2**64 - 1)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano(EliasFano.build(v))
        assert (e.access(np.arange(n)) == v).all()
        x = np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (e.successor(x) == np.searchsorted(v, x)).all()
    for width in (1, 31, 33, 64):
        a = rng.integers(0, 2 ** min(width, 63), 500, dtype=np.uint64)
        assert (unpack(pack(a, width), width, np.arange(500)) == a).all()


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = training_order.Permutation(n, "k")
        s = p.slots(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (p.indices(s) == np.arange(n)).all()
    assert (training_order.Permutation(1000, "a").slots(np.arange(1000)) != training_order.Permutation(1000, "b").slots(np.arange(1000))).any()


def _write(docs, folder, key="k", **more):
    return training_order.write(docs, lambda: sentencepiece_codec.codec(MODEL).encode_all, folder, key, length=16, per_shard=20, **more)


def _bytes(spark, folder, *slots):
    return [(r.slot, r.shard, r.position, bytes(r.ids)) for r in sorted(training_order.read(spark, folder, *slots).collect(), key=lambda r: r.slot)]


def brute_order(rows, length, key):
    """The sequences by slot, restated plainly."""
    stream = []
    for _, text in rows:
        stream += sentencepiece_codec.codec(MODEL).encode(text).tolist()
    stream += [0] * (-len(stream) % length)
    cut = [stream[i : i + length] for i in range(0, len(stream), length)]
    slots = training_order.Permutation(len(cut), key).slots(np.arange(len(cut)))
    return [cut[i] for i in np.argsort(slots)]


def test_shards_hold_every_sequence_in_order(spark, monkeypatch):
    for name, n in (("BLOCK_TOKENS", 300), ("BLOCK_DOCS", 4), ("AT_ONCE", 900), ("RECORDS", 3)):
        monkeypatch.setattr(training_order, name, n)
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).select("text", "doc_id", F.lit(1).alias("part"), F.lit("x").alias("ids"))
    odd = spark.createDataFrame([(None, 7000, 1, ""), ("", 7000, 1, ""), ("a b", 7001, 1, ""), ("a b", 7001, 1, ""), ("none", None, 1, "")], some.schema)
    docs = some.unionByName(odd)
    folder = shared_dir(spark)
    layout = _write(docs.repartition(2), folder)
    rows = _bytes(spark, folder)
    want = brute_order(sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)), 16, "k")
    assert [np.frombuffer(r[3], "<u2").tolist() for r in rows] == want and layout.sequences == len(want)
    assert [r[:3] for r in rows] == [(i, i // 20, i % 20 * 33) for i in range(len(want))] and layout.shards > 3
    # neither the partitions nor their order matter
    again = shared_dir(spark)
    _write(docs.orderBy(F.rand(3)).repartition(7), again)
    assert _bytes(spark, again) == rows
    # a task may write several shards
    two = shared_dir(spark)
    _write(docs.repartition(3), two, most_tasks=2)
    names = [f.split("/")[-2:] for f in training_order.read(spark, two).inputFiles()]
    assert _bytes(spark, two) == rows and len(names) == layout.shards == len({d for d, _ in names})
    assert len({f.split("-")[1] for _, f in names}) == 2
    # a run that was broken off goes on; a reader starts anywhere
    later = shared_dir(spark)
    _write(docs.repartition(3), later, done=[0, 2])
    assert _bytes(spark, later) == [r for r in rows if r[1] not in (0, 2)]
    _write(docs.repartition(5), later, done=[s for s in range(layout.shards) if s not in (0, 2)])
    assert _bytes(spark, later) == rows and _bytes(spark, later, 33) == rows[33:] and _bytes(spark, later, 5, 61) == rows[5:61]
    assert training_order.read(spark, later, 45, 58).select("shard").distinct().count() == 1 == len(training_order.read(spark, later, 45, 58).inputFiles())
    # writing again changes nothing, with or without a shard that is missing
    _write(docs.repartition(4), later)
    assert _bytes(spark, later) == rows and training_order.written_shards(spark, later) == list(range(layout.shards))
    with pytest.raises(ValueError, match="another key"):
        _write(docs, later, "another key")
    other = shared_dir(spark)
    _write(docs, other, "another key")
    shuffled = [r[3] for r in _bytes(spark, other)]
    assert shuffled != [r[3] for r in rows] and sorted(shuffled) == sorted(r[3] for r in rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scriptloom_")]


def test_thousands_of_shards_by_few_tasks(spark):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    one = lambda: lambda texts: (np.arange(4 * len(texts)) % 60_000, np.full(len(texts), 4))
    folder = shared_dir(spark)
    layout = training_order.write(docs, one, folder, "k", length=2, per_shard=1, most_tasks=10)
    got = _bytes(spark, folder)
    assert layout.shards == 2400 and [r[0] for r in got] == list(range(2400))


def test_training_order_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = brute_order(docs, 1024, "epoch-0")
    got = sorted(queries.op9_training_order(spark, sf).collect())
    assert [(r.slot, r.shard, r.position, r.n_bytes, r.ids_crc32) for r in got] == [
        (i, i // 4096, i % 4096 * 2049, 2048, zlib.crc32(np.array(ids, "<u2").tobytes())) for i, ids in enumerate(want)
    ]


def test_ids_beyond_16_bits_raise(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="16 bits"):
        training_order.write(docs, lambda: lambda texts: (np.array([70_000], np.int32), np.ones(len(texts), np.int64)), shared_dir(spark), "k")


def test_no_rows_give_no_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    folder = shared_dir(spark)
    assert _write(docs, folder).sequences == 0
    assert training_order.read(spark, folder).collect() == []


def brute_scores(train, texts, least=ngram_lm.LEAST):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]

    uni, bi, tri = Counter(), Counter(), Counter()
    rows = [tokens(t) for t in train]
    for r in rows:
        uni.update(r)
    kept = lambda w: uni[w] >= least
    for r in rows:
        for u, w in zip(["\n", *r], r):
            if kept(u) and kept(w):
                bi[u, w] += 1
    bi = Counter({k: n for k, n in bi.items() if n >= least})
    for r in rows:
        h = ["\n", *r]
        for a, b, c in zip(h, h[1:], h[2:]):
            if (a, b) in bi and kept(c):
                tri[a, b, c] += 1
    tri = Counter({k: n for k, n in tri.items() if n >= least})
    total, distinct = sum(uni.values()), len(uni)
    mass = {}
    for table in (bi, tri):
        for k, n in table.items():
            mass[k[:-1]] = mass.get(k[:-1], 0) + n - ngram_lm.DISCOUNT

    def p1(w):
        return (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))

    def p2(u, w):
        if (u,) not in mass:
            return p1(w)
        return max(0, bi[u, w] - ngram_lm.DISCOUNT) / uni[u] + (1 - mass[(u,)] / uni[u]) * p1(w)

    def p3(a, b, w):
        if (a, b) not in mass:
            return p2(b, w)
        return max(0, tri[a, b, w] - ngram_lm.DISCOUNT) / bi[a, b] + (1 - mass[a, b] / bi[a, b]) * p2(b, w)

    out = []
    for t in texts:
        h = ["\n", *tokens(t)]
        base = sum(math.log10(p1(w)) for w in h[1:])
        score = math.log10(p2(h[0], h[1])) + sum(math.log10(p3(a, b, c)) for a, b, c in zip(h, h[1:], h[2:]))
        out.append((len(h) - 1, sum(uni[w] > 0 for w in h[1:]), base, score))
    return out, total


def _scores(trie):
    return ngram_lm.score_column(ngram_lm.words_column(F.col("text"), trie), trie).alias("s")


def test_scores_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = queries.op10_lm_scores(spark, sf).collect()
    want, total = brute_scores(train, [docs[r.doc_id] for r in rows])
    assert len(rows) == len(docs)
    for r, (n, known, base, score) in zip(rows, want):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-3)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_scores_over_many_chunks(spark, monkeypatch, least):
    monkeypatch.setattr(ngram_lm, "FETCHED", least == 2)
    monkeypatch.setattr(ngram_lm, "WORDS_PER_CHUNK", 50)
    monkeypatch.setattr(ngram_lm, "NODES_PER_CHUNK", 4)
    texts = ["a b c a b d", "a b c", "c a b d", None, "", "a b", "d c a b c d A B c d e f g", "b b b b b b"] * 6 + ["x" + "y" * i for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    trie = ngram_lm.fit(df, least=least)
    assert len(trie.names[0]) > 2 and len(trie.names[1]) > 1
    assert {n.partition(":")[0] for level in trie.names for n in level} == {"fetched" if least == 2 else "file"}
    got = df.select("text", _scores(trie)).collect()
    want, _ = brute_scores(texts, [r.text for r in got], least)
    for r, (n, known, base, score) in zip(got, want):
        assert (r.s.n_tokens, r.s.n_known) == (n, known)
        assert math.isclose(r.s.base_score, base, rel_tol=1e-9) and math.isclose(r.s.score, score, abs_tol=2e-3), r.text


def test_rows_that_repeat_and_names_that_clash(spark):
    rows = [(1, "a b a b", "w", 1), (1, "a b a b", "w", 1), (None, None, None, None), (2, "  ", "", 2), (3, "long " * 30_000, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, training long").drop("words").withColumnRenamed("training", "row")
    trie, kept = ngram_lm.fit_rows(df, F.col("doc_id") < 3)
    assert kept.columns == ["doc_id", "row", "words"]
    got = sorted(kept.select("doc_id", "row", ngram_lm.score_column(F.col("words"), trie).alias("s")).collect(), key=repr)
    texts = {1: "a b a b", 2: "  ", None: None, 3: "long " * 30_000}
    want, total = brute_scores(["a b a b", "a b a b", "  "], [texts[r.doc_id] for r in got])
    assert trie.total == total == 11 and len(got) == 5
    for r, (n, known, base, score) in zip(got, want):
        assert (r.s.n_tokens, r.s.n_known) == (n, known) and math.isclose(r.s.score, score, rel_tol=1e-3, abs_tol=2e-3)


def test_without_training_rows(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    trie = ngram_lm.fit(df.limit(0))
    rows = [r.s for r in df.select(_scores(trie)).collect()]
    assert [(s.n_tokens, s.n_known, s.base_score, s.score) for s in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
