import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptloom.llm import common, decontamination, kd_shards, queries, sql, topk_search
from tests.llm.harness import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_matches_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(sql.ORACLES[name], SF)


def check_shards(rows, shards, largest):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    target = sum(sizes.values()) / shards
    assert max(sizes.values()) - target <= 5 * largest and target - min(sizes.get(k, 0) for k in range(shards)) <= 5 * largest


def test_shards(spark):
    rows = queries.op2_kd_shards(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: r.text for r in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
    check_shards(rows, 24, max(r.size for r in rows))


def test_shards_of_one_hot_value_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7), "s", None) for i in range(3000)] + [(None, None, None, None)] * 3, "doc_id long, text string, source string, size string")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    dims = kd_shards.dimensions(docs, {"source": F.col("source")}, {"n": F.lit(None)})
    rows = kd_shards.shard(docs, {"doc_id": F.col("doc_id")}, size, dims, 24).collect()
    assert len(rows) == 3003
    check_shards(rows, 24, 14)
    assert kd_shards.shard(docs.limit(0), {"doc_id": F.col("doc_id")}, size, dims, 24).collect() == []


def test_dimension_codes_keep_order_and_use_the_range(spark):
    texts = ["https://example.org/", "https://example.org/a", "https://example.org/b" + "x" * 50, "https://example.org/zz"]
    numbers = [-(2**63), -5, 0, 2**63 - 1]
    rows = spark.createDataFrame(list(zip(texts, numbers, [-9, -8, 0, 7])), "t string, n long, m long").withColumn("size", F.lit("clash"))
    dims = kd_shards.dimensions(rows, {"t": F.col("t")}, {"n": F.col("n"), "m": F.col("m")})
    got = rows.orderBy("n").select(*[c.alias(n) for n, c in dims.items()]).collect()
    for name in ("t", "n", "m"):
        codes = [r[name] for r in got]
        assert codes == sorted(codes) and codes[0] >= 0 and codes[-1] <= 2**52
    assert len({r.t for r in got}) == 4 and [r.m for r in got] == [0, 1, 9, 16] and len({r.n for r in got}) >= 3
    placed = kd_shards.shard(rows, {"size_of": F.col("size"), "n": F.col("n")}, F.lit(10), dims, 3)
    assert placed.columns == ["size_of", "n", "size", "shard", "slot"] and placed.count() == 4
    assert [c for c in kd_shards.dimensions(rows.limit(0), {"t": F.col("t")}, {"n": F.col("n")})] == ["t", "n"]


def test_shards_are_those_of_plain_medians(spark, monkeypatch):
    """Rows of one size, so that every cut between rows is exact."""
    import random

    monkeypatch.setattr(kd_shards, "TOLERANCE", 0.0)
    rng = random.Random(6)
    rows = [(i, rng.randrange(1000), rng.randrange(50), "abc"[min(2, rng.randrange(5))]) for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, x long, y long, t string")
    dims = kd_shards.dimensions(docs, {"t": F.col("t")}, {"x": F.col("x"), "y": F.col("y")})
    got = kd_shards.shard(docs, {"doc_id": F.col("doc_id")}, F.lit(4), dims, 24).collect()
    seen = docs.select("doc_id", *[c.alias(n) for n, c in dims.items()]).collect()
    assert sorted(r.shard for r in got) == sorted(list(range(24)) * 40)
    place = {r.doc_id: r.shard for r in got}
    values = {r.doc_id: (r.t, r.x, r.y) for r in seen}

    def check(ids, first, leaves):
        """At each node the widest dimension parts the rows, up to ties."""
        if leaves == 1:
            return
        half = leaves // 2
        left, right = [i for i in ids if place[i] < first + half], [i for i in ids if place[i] >= first + half]
        spans = [max(1, max(v[d] for v in values.values()) - min(v[d] for v in values.values())) for d in range(3)]
        widths = [(max(values[i][d] for i in ids) - min(values[i][d] for i in ids)) / spans[d] for d in range(3)]
        d = widths.index(max(widths))
        assert max(values[i][d] for i in left) <= min(values[i][d] for i in right)
        check(left, first, half)
        check(right, first + half, leaves - half)

    check(list(values), 0, 24)


def test_decontamination_of_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    long = "z " * 50_000 + passage.upper() + " y" * 50_000
    partly = " ".join(f"w{i}" for i in range(36)) + " q q q q"
    less = " ".join(f"w{i}" for i in range(30)) + " q q q q"
    docs = spark.createDataFrame(
        [(1, passage, "a"), (1, passage, "a"), (2, long, "a"), (3, partly, "a"), (4, less, "a"), (5, None, "a"), (6, "", "a"), (None, passage, "a"), (7, "Two  words", "a")],
        "doc_id long, text string, item_id string",
    )
    items = spark.createDataFrame([(10, passage), (10, passage), (11, "two words"), (12, None), (13, ""), (14, "two")], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id) for r in decontamination.contained_items(docs, items).collect())
    assert found == [(0, 10), (1, 10), (2, 10), (3, 10), (7, 11)]
    assert decontamination.contained_items(docs.limit(0), items).collect() == []
    assert decontamination.contained_items(docs, items.limit(0)).collect() == []


def test_common_phrase_makes_no_candidates(spark):
    """A phrase, or two thirds of each item, that all share: no pair but those contained."""

    def own(kind, i, n):
        return " ".join(f"{kind}{i}_{j}" for j in range(n))

    for shared, rest in ((12, 30), (60, 30)):
        phrase = " ".join(f"c{j}" for j in range(shared))
        items = [(i, f"{phrase} {own('i', i, rest)}") for i in range(100)]
        docs = [(i, f"{own('a', i, 20)} {phrase} {own('b', i, 20)}") for i in range(400)]
        docs += [(1000 + i, f"{own('a', i, 9)} {items[i][1]} {own('b', i, 9)}") for i in range(5)]
        docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        _, classes = decontamination._classes(items)
        index = decontamination._sketches(classes, 0.8)
        texts = docs.withColumn("text_hash", F.xxhash64("text"))
        assert decontamination._candidates(texts, index).count() < 10
        hashes = texts.select(F.explode(decontamination.shingle_hashes(F.col("text"))).alias("hash"))
        assert hashes.join(index, "hash").count() < 1000
        found = sorted((r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect())
        assert found == [(1000 + i, i) for i in range(5)]


def test_decontamination_equals_all_pairs(spark):
    """Items cut from documents with words changed, parts in common and copies, against all
    pairs of documents and items."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(base) for _ in range(rng.randrange(3, 60))] for _ in range(25)]
    docs = [(i, " ".join(w for _ in range(3) for w in rng.choice(passages)[: rng.randrange(1, 60)])) for i in range(150)]
    items = []
    for i in range(60):
        words = list(rng.choice(passages)) + (rng.choice(passages)[:10] if i % 3 == 0 else [])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(base)
        items.append((i % 50, " ".join(words)))

    def shingles(text):
        w = text.split()
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    want = {(d, i) for d, t in docs for i, u in items if 10 * len(shingles(t) & shingles(u)) >= 8 * len(shingles(u))}
    got = decontamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 50


def test_shuffled_decontamination_is_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows_of(decontamination.contained_items(docs, items))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert rows_of(decontamination.contained_items(docs, items)) == want


def brute_top(rows, k):
    import math

    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q, mine in vectors.items():
        if q % 2 == 0:
            scored = sorted((-max(sum(x * y for x, y in zip(a, b)) for a in mine for b in theirs), i) for i, theirs in vectors.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("choice", [(0.0, 2), (0.6, 3), (2.0, 1), None])
def test_top_k_with_each_pruning(spark, monkeypatch, choice):
    import random

    if choice:
        monkeypatch.setattr(topk_search, "tuned", lambda *_: choice)
    monkeypatch.setattr(topk_search, "BLOCK", 20)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk_search, "SEEDS", 30)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.02, 1, 1, 8]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    # an id with several vectors, and rows that repeat
    rows += [(400, [1.0] + [0.0] * 5), (400, [0.0, 1.0] + [0.0] * 4), (401, [9.0] + [0.0] * 5), (401, [0.0, -9.0] + [0.0] * 4)] + [(402, [0.5] * 6)] * 100
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (304, [float("inf")]), (306, []), (308, [0.0] * 6), (310, [2.0]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 2 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 5)
    assert topk_search.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 2 == 0, 5).collect() == []


@pytest.mark.parametrize("dim,centres,sigma,way", [(32, 40, 0.7, "skipped"), (32, 4000, 0.3, "pruned by length")])
def test_top_k_prunes_by_length_and_direction(dim, centres, sigma, way):
    """Vectors of many or few lengths and directions: the way that should spare products
    does, and no result is lost."""
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1)[:, None] / 5
    vectors = middle[rng.integers(0, centres, 8000)] + 0.02 * rng.normal(size=(8000, dim))
    vectors = np.floor(64 * vectors * rng.lognormal(0, sigma, 8000)[:, None])
    bucket = np.floor(np.log(np.sqrt((vectors**2).sum(axis=1))) / np.log(topk_search.RATIO))
    best, tally = {i: [] for i in range(0, 8000, 80)}, Counter()
    queries = vectors[list(best)]
    for b in sorted(set(bucket), reverse=True):
        at = np.flatnonzero(bucket == b)
        theta = np.array([sorted(s)[-10] if len(s) >= 10 else -np.inf for s in best.values()])
        block = topk_search.Block(at, list(vectors[at]), dim)
        for q, _, scores in topk_search.search(np.array(list(best)), queries, theta, block, 10, tally):
            best[int(q)] += scores.tolist()
    for q, scores in best.items():
        assert sorted(scores)[-10:] == sorted(np.delete(vectors @ vectors[q], q))[-10:]
    assert sum(tally.values()) == 100 * 8000
    print(dim, centres, sigma, {name: round(n / (100 * 8000), 3) for name, n in tally.items()})
    assert tally[way] > 0.005 * 100 * 8000


def test_tuning_takes_coordinates_where_they_cost_less():
    import numpy as np

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 512))
    middle /= np.linalg.norm(middle, axis=1)[:, None] / 5
    vectors = np.floor(64 * (middle[rng.integers(0, 20, 8000)] + 0.02 * rng.normal(size=(8000, 512))))
    block = topk_search.Block(np.arange(8000), list(vectors), 512)
    queries = vectors[:100]
    lengths = np.sqrt((queries**2).sum(axis=1))
    scores = queries @ block.matrix.T
    theta = np.sort(scores, axis=1)[:, -10]
    cosine = np.minimum(1, theta / (lengths * block.length[4000]))
    steep, focus = topk_search.tuned(block, 4000, 8000, queries, lengths, np.full(100, 8000), cosine)
    assert steep <= cosine.max() and focus > 1
    for i in range(100):
        at = block.near(queries[i] / lengths[i], cosine[i], focus, 4000, 8000)
        assert set(4000 + np.flatnonzero(scores[i, 4000:] >= theta[i])) <= set(at) and len(at) < 800
    # low thresholds, short vectors: the matrix product costs less
    assert topk_search.tuned(block, 0, 500, queries, lengths, np.full(100, 500), np.full(100, 0.2))[0] > 1


def test_top_k_large_components(spark):
    rows = [(0, [1e12, -3e12]), (2, [2e12, 1e12]), (3, [1e12, 1e12]), (3, [1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") == 2, 5).collect()
    assert sorted((r.vec_id, r["rank"]) for r in got) == [(0, 2), (3, 1)]


def most_sent(spark, after):
    """Bytes of results, without the figures of its tasks, that a stage after the given one sent to the driver at most;
    the last stage."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    status = spark.sparkContext._jsc.sc().statusStore()
    found = status.stageList(None, False, False, getattr(status, "stageList$default$4")(), None)
    stages = [found.apply(i) for i in range(found.size())]
    return max((s.resultSize() - 10_000 * s.numTasks() for s in stages if s.stageId() > after), default=0), max(s.stageId() for s in stages)


@pytest.mark.parametrize("n", [4000, 16000])
def test_top_k_sends_no_vectors_to_the_driver(spark, monkeypatch, n):
    monkeypatch.setattr(topk_search, "BLOCK", 200)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 50)
    integer = lambda i: (F.pmod(F.xxhash64("id", i), F.lit(128)) - 64) / 64.0
    df = spark.range(n, numPartitions=4).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), integer).alias("embedding"))
    spark.range(1).collect()
    _, last = most_sent(spark, -1)
    topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).write.format("noop").mode("overwrite").save()
    sent, _ = most_sent(spark, last)
    assert sent < 100_000


def test_top_k_blocks_are_bounded_in_bytes(spark, monkeypatch):
    import random

    stored = []
    monkeypatch.setattr(topk_search, "BLOCK_VALUES", 400)
    monkeypatch.setattr(topk_search, "QUERY_VALUES", 200)
    monkeypatch.setattr(topk_search, "store", lambda *a, **b: stored.append(common.store(*a, **b)) or stored[-1])
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 2 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 5)
    for name, most in (("block", 400), ("qpart", 200)):
        table = next(t for t in stored if name in t.columns)
        vectors = 200 if name == "block" else 100
        assert table.count() == len(table.inputFiles()) >= 0.8 * vectors * 32 / most
