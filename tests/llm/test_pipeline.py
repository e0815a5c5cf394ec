"""The pipeline against a plain restatement of each stage's decision."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from scriptloom.llm import queries, secret_scan, toxicity
from tests.llm.test_near_copies import brute_classes

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def copied(held):
    owners = len({o for o, _ in held})
    return owners >= 3 or (owners == 2 and len(held) >= 6)


def test_stages_in_order(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id: r for r in docs.collect()}

    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scorer()
    got = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert got.columns == names
    kept = {i: r for i, r in kept.items() if score(r.text) < 0.5}
    assert {r.doc_id for r in got.collect()} == set(kept)

    ids = sorted(kept)
    classes = brute_classes([kept[i].text for i in ids])
    kept = {i: kept[i] for i, c in zip(ids, classes) if ids[c] == i}
    got = corpus_pipeline.drop_near_duplicates(spark, got, SF)
    assert got.columns == names and sorted(r.doc_id for r in got.collect()) == sorted(kept)

    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, r in kept.items() if any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
    kept = {i: r for i, r in kept.items() if i not in leaks}
    got = corpus_pipeline.drop_benchmark_leaks(spark, got, SF)
    assert got.columns == names and sorted(r.doc_id for r in got.collect()) == sorted(kept)

    holders = {}
    for r in kept.values():
        for _, _, v in secret_scan.candidates(r.text, secret_scan.base_matches(r.text)):
            holders.setdefault(v, set()).add((r.source, f"{r.source}/{r.lang}"))
    texts = {}
    for i, r in kept.items():
        live = [(a, b) for a, b, v in secret_scan.candidates(r.text, secret_scan.base_matches(r.text)) if not copied(holders[v]) and secret_scan.random_looking(v)]
        texts[i] = secret_scan.redact(r.text, live)
    got = corpus_pipeline.mask_secrets(spark, got, SF)
    assert got.columns == names and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = corpus_pipeline.encode(spark, got, SF)
    want = {i: library.encode(t, add_eos=True) for i, t in texts.items()}
    assert {r.doc_id: r.ids for r in got.collect()} == want
    from scriptloom.llm import common

    left = []
    monkeypatch.setattr(common, "remove", lambda spark, path: left.append(path))
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids for r in whole.collect()} == want
    assert len(left) > 20 and len(set(left)) == len(left) and not any(f in p for f in whole.inputFiles() for p in left)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = "token = Zk81mQw0Lr5tYx7Vb3Ns"
    odd = spark.createDataFrame(
        [(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, "other text here now", None, None, 19), (None, None, None, None, None), (None, None, None, None, None), (7, "", "en", "s", 0), (8, secret, "en", "s", 28), (9, "word " * 20000, "en", "s", 100000)],
        docs.schema,
    ).withColumn("_hash", F.lit("clash")).withColumn("spans", F.lit(1))
    out = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == odd.columns
    rows = out.collect()
    # empty texts are one class with the rows without text; rows without an id stay
    assert sorted((r.doc_id or 0, (r.text or "")[:15]) for r in rows) == [(0, ""), (0, ""), (1, "a b c d e f"), (1, "other text here"), (7, ""), (8, "token = [secret"), (9, "word word word ")]
    assert corpus_pipeline.encode(spark, out, SF).count() == 7
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []
