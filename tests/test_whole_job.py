"""Queries that must cover whole tables and whole texts, against plain Python."""

import json
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptloom.functions import alignment, text
from scriptloom.operators import corpus
from scriptloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def words_by_doc(spark):
    return {r.key: r.words for r in corpus.words_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()}


def fits(hyp, ref):
    reach = {0}
    for t in hyp:
        if any(c.isdecimal() for c in t):
            reach = {i + n for i in reach for n in range(1, 6) if i + n <= len(ref)}
        else:
            reach = {i + 1 for i in reach if i < len(ref) and ref[i] == t}
    return len(ref) in reach


def masked(words):
    return ["7" if ord(t[0]) % 16 == 5 else t for t in words]


def test_alignment_of_every_document(spark):
    docs = words_by_doc(spark)
    assert any(len(w) > 60 for w in docs.values())
    spans = {r.key: r for r in QUERIES["wildcard_spans"](spark, SF).collect()}
    whole = {r.key: r.ok for r in QUERIES["align_validate"](spark, SF).collect()}
    assert set(spans) == set(whole) == set(docs)
    for key, words in docs.items():
        assert spans[key].ok == fits(masked(words), words)
        assert whole[key] == fits(masked(words[: len(words) - 1] if key % 3 == 0 else words), words)
        if spans[key].ok:
            assert [s["digits"] for s in json.loads(spans[key].spans)] == [t for t in masked(words) if any(c.isdecimal() for c in t)]


def test_long_wildcard_runs_align(spark):
    ref = [random.Random(1).choice("ab") for _ in range(20000)]
    hyp = ["7" if i % 3 == 0 else w for i, w in enumerate(ref)]
    assert alignment.spells(hyp, ref) and not alignment.spells(hyp + ["c"], ref)
    row = spark.createDataFrame([(hyp, ref)], "h array<string>, r array<string>")
    assert row.select(alignment.aligns(F.col("h"), F.col("r")).alias("ok")).first().ok


def test_wildcards_that_cannot_align_fail_at_once(spark):
    began = time.perf_counter()
    assert not alignment.spells(["7"] * 40 + ["x"], [f"w{i}" for i in range(120)])
    assert alignment.spells(["7"] * 40 + ["x"], [f"w{i}" for i in range(120)] + ["x"])
    assert time.perf_counter() - began < 1


def test_states_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").collect()
    assert any(r.n_chars >= 4000 for r in docs)
    validation = [*["failed"] * 4, "ok", None, "failed"]
    failure = ["no_response", "truncated", "unparseable", "missing", None, None, "alignment"]
    want = {(r.doc_id, validation[r.doc_id % 7], failure[r.doc_id % 7]) for r in docs}
    found = QUERIES["validate_states"](spark, SF).collect()
    assert len(found) == len(docs) and {tuple(r) for r in found} == want


def test_every_word_votes(spark):
    docs = words_by_doc(spark)
    votes, first = Counter(), {}
    for key in sorted(docs):
        for pos, token in enumerate(docs[key]):
            votes[token] += 1
            first.setdefault(token, (key, pos))
    best = sorted(votes, key=lambda t: (-votes[t], first[t]))[:5]
    found = QUERIES["topk_votes"](spark, SF).collect()
    assert sorted((r.token, r.votes) for r in found) == sorted((t, votes[t]) for t in best)
    assert {r.sep_share for r in found} == {round(votes["the"] / sum(votes.values()), 6)}


def test_sequences_hold_whole_turns(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    made = rows.select("conv_id", "turn", "role", text.tokens(text.normalize(F.col("text"))).alias("w")).collect()
    plain = {}
    for r in made:
        head = [0] * (r.turn % 3 + 1) + [-1] + [ord(c) for c in r.role] + [-1]
        said = [ord(w[0]) for w in r.w]
        plain[r.conv_id, r.turn] = (head + said + [-1], [None] * len(head) + said + [-1])
    longest = {}
    for (conv, _), (inputs, _) in plain.items():
        longest[conv] = max(longest.get(conv, 0), len(inputs))
    found = QUERIES["sequence_assemble"](spark, SF).collect()
    assert len(found) == len(made) and max(longest.values()) > 24
    for r in found:
        inputs, labels = plain[r.conv_id, r.turn]
        assert r.inputs.split(" ") == [str(x) for x in inputs + [9] * (longest[r.conv_id] - len(inputs))]
        assert r.labels.split(" ") == ["_" if x is None else str(x) for x in labels]


def test_spectrogram_of_every_vector(spark):
    found = {r.vec_id: r for r in QUERIES["log_mel_features"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert set(found) == {r.vec_id for r in rows}
    n = np.arange(400)
    window = np.sin(np.pi * n / 400) ** 2
    turn = np.exp(-2j * np.pi * np.outer(np.arange(201), n) / 400)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(8000), 82) / 2595) - 1)
    filters = np.array([[max(0, min((f - a) / (b - a), (c - f) / (c - b))) for f in np.arange(201) * 40.0] for a, b, c in zip(edges, edges[1:], edges[2:])])
    for r in rows[:20]:
        wave = np.tile(np.array(r.embedding, np.float32), 25).astype(float)
        wide = np.concatenate([wave[200:0:-1], wave, wave[-2:-202:-1]])
        frames = np.array([wide[160 * i : 160 * i + 400] for i in range(len(wave) // 160)])
        level = np.log10(np.maximum(filters @ (np.abs(turn @ (frames * window).T) ** 2), 1e-10))
        want = (np.maximum(level, level.max() - 8) + 4) / 4
        assert (found[r.vec_id].bands, found[r.vec_id].frames) == want.shape
        assert abs(found[r.vec_id].total - want.sum()) < 0.05
