"""Near copies against all pairs."""

import random

import corpus_pipeline
from scriptloom.llm import near_copies
from scriptloom.llm.stages import text_hash


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    """The place of the first member of each text's class."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if parent[i] != parent[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    return parent


def changed(words, n, rng, word):
    copy = list(words)
    for at in rng.sample(range(len(words) // 10), n):
        copy[at * 10 + 4] = word()
    return copy


def documents(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_links_are_all_pairs_of_four_fifths(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(100)]
        texts.append(" ".join(base))
        texts += [" ".join(changed(base, n, rng, word)) for n in (1, 2, 3, 4)]
    want = brute_classes(texts)
    assert any(c != i for i, c in enumerate(want)) and len(set(want)) > 40
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), "").collect()}
    assert kept == set(want)


def test_large_buckets_of_several_classes(spark, monkeypatch):
    """With one hash a key, unlike texts meet in large buckets; classes must stay whole, and
    so must chains whose ends are unlike."""
    monkeypatch.setattr(near_copies, "_fingerprint_pairs", lambda texts, shingle: texts.selectExpr("h as a", "h as b").limit(0))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, texts = [word() for _ in range(60)], ["", None, " "]
    for _ in range(12):
        chain = shared + [word() for _ in range(60)]
        for _ in range(10):
            texts.append(" ".join(chain))
            chain = changed(chain, 2, rng, word)
    want = brute_classes(["" if t is None else t for t in texts])
    docs = documents(spark, texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_classes(docs, text_hash()).collect()}
    assert [got[i] for i in range(len(texts))] == want and 2 < len(set(want)) < len(texts) / 2


def test_recall_on_the_documents(spark):
    """Every class that all pairs of the table's texts give, with ids that repeat or lack."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = brute_classes([r.text for r in rows])
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_classes(docs, text_hash()).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[c].doc_id for c in want]


def test_prefix_pairs_hold_every_alike_pair(spark):
    """Random sets of shared and own elements, some of one class already."""
    rng = random.Random(6)
    common = [rng.getrandbits(62) for _ in range(60)]
    rows = []
    for h in range(150):
        base = set(rng.sample(common, rng.randint(1, 40))) if h % 3 or not rows else set(rows[rng.randrange(len(rows))][2])
        for _ in range(rng.randint(0, 5)):
            base.add(rng.getrandbits(62))
        rows.append((h, h // 2 if h % 5 == 0 else h + 1000, sorted(base)))
    df = spark.createDataFrame(rows + [(999, 5, [])], "h long, class long, s array<long>")
    got = {(r.a, r.b) for r in near_copies.prefix_pairs(df, 0.8).collect()}
    alike = {
        (g, h) for g, c, s in rows for h, d, t in rows
        if g < h and c != d and len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t))
    }
    assert alike and alike <= got
    verified = near_copies._verified_sets(spark.createDataFrame(sorted(got), "a long, b long"), df, 0.8)
    assert {(r.a, r.b) for r in verified.collect()} == alike


def test_letters_of_one_form_do_not_meet_each_other(spark, monkeypatch):
    """Texts of 80 common and 12 own words (similarity below 0.8, so none link): the number of
    compared pairs follows the number of texts."""
    monkeypatch.setattr(near_copies, "_fingerprint_pairs", lambda texts, shingle: texts.selectExpr("h as a", "h as b").limit(0))
    compared = []
    for name in ("_verified", "_verified_sets"):
        whole = getattr(near_copies, name)

        def counted(pairs, *more, whole=whole):
            compared.append(pairs.count())
            return whole(pairs, *more)

        monkeypatch.setattr(near_copies, name, counted)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    form, totals = [word() for _ in range(80)], []
    for n in (100, 300):
        compared.clear()
        docs = documents(spark, [" ".join(form + [word() for _ in range(12)]) for _ in range(n)])
        classes = near_copies.near_copy_classes(docs, text_hash()).collect()
        assert all(r.doc_id == r.component_id for r in classes)
        totals.append(sum(compared))
    assert totals[0] < 1500 and totals[1] < 4.5 * totals[0]
