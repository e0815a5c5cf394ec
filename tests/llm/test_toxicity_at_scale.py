"""Toxicity scores that must not depend on the size of the table or the form of the text."""

from collections import Counter

from pyspark.sql import functions as F

from scriptloom.llm import toxicity


def test_scores_keep_their_meaning_when_a_kind_is_sampled(spark, monkeypatch):
    rows = [(i, "idiot here today" if i % 10 == 0 else "idiot maybe fine" if i % 10 == 1 else "quiet day fine") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("toxic"))
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 60)
    capped = toxicity.fit(docs, labels)
    assert abs(whole.scorer()("unknown words") - capped.scorer()("unknown words")) < 0.05
    assert abs(capped.bias - whole.bias) < 1.0


def test_long_tokens_and_runs_are_restored():
    words = Counter("you are an idiot and nobody here will read what loser clown people say about this moron today".split())
    r = toxicity.Restorer(toxicity.CharModel.fit(Counter({w: 50 for w in words})))
    assert "idiot" in r.words("the idi" + "o" * 80 + "t of")
    assert "idiot" in r.words("the " + ("." * 12).join("idiot") + " of")
    run = " ".join("".join("you are an idiot and nobody here will read what people say".split()))
    assert {"idiot", "nobody", "people"} <= r.words(run)
    assert "idiot" in r.text(run).split()
    assert toxicity.features_of("x" * 41)
    long = "idiot" * 20000 + "0"
    assert len(r.model.decode(long)) in (len(long) - 1, len(long))


def test_character_model_leaves_no_word_out(spark):
    words = ["a" * 90, "ab", "été", "слово" * 20, "x" * 70_000]
    docs = spark.createDataFrame([(" ".join(words),), ("ab 12 a1",), (None,)], "text string").repartition(2)
    model = toxicity.char_model(docs)
    want = toxicity.CharModel.fit(Counter({"a" * 90: 1, "ab": 2, "ete": 1, "λ" * 100: 1, "x" * 70_000: 1}))
    assert model.counts == want.counts and model.letters == want.letters
    assert model.counts["aaa"] == 88 and model.counts["xxx"] == 69_998 and model.counts["λλλ"] == 98
    assert [toxicity.symbol(c) for c in "aéλж^$1"] == ["a", "e", "λ", "λ", "#", "#", "#"]


def test_spaced_letters_are_read_alike_at_any_length():
    r = toxicity.Restorer(toxicity.CharModel.fit(Counter({w: 50 for w in "you are an idiot and a total moron today".split()})))
    for times in (1, 2, 5, 40):
        run = " ".join("youareanidiot" * times)
        found = r.words(f"well {run} here")
        assert "idiot" in found and "youareanidiot" * times in found
        assert r.text(f"well {run} here").split().count("idiot") == times


def test_features_speak_either_way_and_have_no_number(spark):
    rows = [(i, f"bad{i % 2} awful here" if i % 4 == 0 else f"calm{i % 2} gentle here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic")))
    assert model.weights["awful"] > 0 > model.weights["gentle"] and "here" not in model.weights
    spelt = lambda k: "abcdefghij"[k // 100] + "klmnopqrst"[k // 10 % 10] + "uvwxyzbcde"[k % 10]
    many = [(i, " ".join("bcdfghjklmnpqrstvwxz"[i % 20] + spelt(k) for k in range(400))) for i in range(400)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 20 < 10).cast("int").alias("toxic")))
    assert sum(not w.startswith("^") for w in model.weights) == 20 * 400  # each word in 20 rows of one kind
