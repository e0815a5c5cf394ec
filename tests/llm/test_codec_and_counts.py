import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scriptloom.llm import queries, sentencepiece_codec, wordpiece_counts

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
ALPHABET = "abthe  ▁\n\té漢😀0<>/s.́,'\x00İ"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(MODEL)


def test_encodes_and_decodes_as_the_library(library, codec):
    rng = random.Random(7)
    texts = ["", " ", "  a  b \n c\t", "a" * 3000, "tothetheheat of the", "▁▁ x"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_eos=True)
        assert codec.encode(t).tolist() == want
        assert codec.count(t) == len(want)
        assert codec.decode(want) == library.decode(want)
    assert codec.encode(None).tolist() == [codec.end]
    texts += [None, "a\n\nb", "\n", "\na b", "a \nb", "a\n b", "a\n", "x " * 20_000, "one\ntwo  three"] + ["".join(rng.choice("ab the\n .é") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for end in (True, False):
        ids, lengths = codec.encode_all(pa.array(texts, pa.string()).slice(3), end)
        found = np.split(ids, np.cumsum(lengths)[:-1])
        assert len(lengths) == len(texts) - 3 and [x.tolist() for x in found] == [library.encode(t or "", add_eos=end) for t in texts[3:]]
    for none in ([], [None], [""], [" "]):
        assert codec.encode_all(pa.array(none, pa.string()))[1].sum() == sum(len(library.encode(t or "", add_eos=True)) for t in none)


def test_decodes_any_ids_as_the_library(library, codec):
    rng = random.Random(8)
    for _ in range(1500):
        ids = [rng.choice([1, 2, 3, 50, 130, 172, 200, 228, 259, 300, 29871, 1000]) for _ in range(6)]
        assert codec.decode(ids) == library.decode(ids)


def test_columns(spark, library):
    df = spark.createDataFrame([(1, "Hello  world\n"), (2, None), (3, ""), (3, "")], "doc_id int, text string")
    coded = df.select("doc_id", "text", sentencepiece_codec.encode(F.col("text"), MODEL).alias("ids"))
    for r in coded.select("*", sentencepiece_codec.decode(F.col("ids"), MODEL).alias("back")).collect():
        assert r.ids == library.encode(r.text or "", add_eos=True)
        assert r.back == (r.text or "")
    assert df.limit(0).select(sentencepiece_codec.encode_decode(F.col("text"), MODEL)).collect() == []


def test_query_on_small_table(spark, library):
    import hashlib

    for r in queries.op4_sentencepiece(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").collect():
        ids = library.encode(r.text, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        have = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in have), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_longest_match_counts_as_greedy_pieces():
    rng = random.Random(9)
    for _ in range(200):
        made = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(14)]
        initial, continuing = set(made[:7]), set(made[7:])
        a = wordpiece_counts.LongestMatch(initial, continuing)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert a.pieces(word) == greedy(word, initial, continuing), (word, initial, continuing)


def test_counts_match_a_wordpiece_tokenizer():
    from tokenizers.models import WordPiece

    from scriptloom.llm.sentencepiece_codec import MARK

    names = [n for n in sentencepiece_codec.codec(MODEL).ids if MARK not in n[1:] and n != MARK]
    vocab = {("" if n[0] == MARK else "##") + n.lstrip(MARK): i for i, n in enumerate(names)} | {"[UNK]": len(names)}
    model = WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6)
    ours = wordpiece_counts.from_piece_model(MODEL)
    for word in ["unaffable", "Thntblere", "ß", "漢字", "x" * 500, "naïveté", "\x01\x02", "a.b-c"]:
        pieces = model.tokenize(word)
        assert (ours.pieces(word) or 1) == len(pieces)
    assert ours.count(None) == ours.count(" \n") == (0, 0, 0)
    assert ours.count("\x01 a \x01")[2] == 2


def test_counts_query_matches_greedy_pieces(spark):
    import re

    sf = "/root/testdata/sf0.001"
    names = [n for n in sentencepiece_codec.codec(MODEL).ids if sentencepiece_codec.MARK not in n[1:] and n != sentencepiece_codec.MARK]
    initial, continuing = {n[1:] for n in names if n[0] == sentencepiece_codec.MARK}, {n for n in names if n[0] != sentencepiece_codec.MARK}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    rows = queries.op6_token_counts(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text[r.doc_id])
        counts = [seen.setdefault(w, greedy(w, initial, continuing)) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(n or 1 for n in counts), counts.count(0))


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a b", 3), (3, "a b", 3), (None, "x" * 100_000, 4)], "doc_id long, text string, n_tokens int")
    got = docs.select("doc_id", wordpiece_counts.count_column(F.col("text"), MODEL).alias("c")).collect()
    assert sorted((r.doc_id or 0, r.c.n_words, r.c.n_unknown) for r in got) == [(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 2, 0), (3, 2, 0)]
    assert docs.limit(0).select(wordpiece_counts.count_column(F.col("text"), MODEL)).collect() == []
