import random

import numpy as np
import xxhash

from scriptloom.llm import simhash


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["The", "Ärger", "a", "b\t", "c\nd", "É", " z"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")


def test_links_lose_no_class(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(8):
            prints.append(centre)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                centre ^= 1 << b
    base = rng.getrandbits(64)
    for block_start in (0, 21, 42):
        prints += [base ^ (rng.getrandbits(9) << block_start) for _ in range(300)]
    prints = sorted(set(prints))
    rng.shuffle(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(3)
    links = simhash.fingerprint_links(df)
    from scriptloom.llm.components import components

    root = {r.node % 2**64: r.root % 2**64 for r in components(links).collect()}
    got = [root.get(p, p) for p in prints]
    want = brute_classes(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "A  b", "x"), (5, "word " * 3000, "x")],
        "doc_id long, text string, component_id string",
    )
    rows = simhash.near_duplicate_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5)]
    assert simhash.near_duplicate_classes(docs.limit(0)).collect() == []


def test_query_matches_brute_force(spark):
    from scriptloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_fingerprint(t) for _, t in docs]
    first = {}
    for (i, _), c in zip(docs, brute_classes(prints)):
        first.setdefault(c, i)
    want = [(i, f"{p:016x}", first[c]) for (i, _), p, c in zip(docs, prints, brute_classes(prints))]
    assert sorted(tuple(r) for r in queries.op3_simhash(spark, sf).collect()) == want
