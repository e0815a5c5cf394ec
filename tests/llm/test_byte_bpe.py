import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptloom.llm import byte_bpe_codec, queries

PATH = queries.tokenizer_path("byte_bpe_50k.json")
ALPHABET = [*"abstremvld'' \n\t\r\x0b\x00\x1c\x85  　é漢😀0٣½<|>!.,_-İ́Ᲊ", "'s", "'re", " 'll", "<|endoftext|>", "the", " of"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return byte_bpe_codec.codec(PATH)


def test_encodes_and_decodes_as_the_library(library, codec):
    rng = random.Random(5)
    texts = ["", " ", "  a  b \n c\t", "a" * 3000, "abc" * 20_000, "don't they're 's ''s  's\n's I'Ve", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "\0", "a\0b", "\0\0"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, lengths = codec.encode_all(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert codec.decode_all(ids, lengths) == library.decode_batch(want, skip_special_tokens=False) == texts
    assert [codec.encode(t) for t in texts[:300]] == want[:300]
    assert codec.encode(None) == [] and codec.decode([]) == ""
    for none in ([], [None], [""], [None, ""]):
        assert codec.encode_all(pa.array(none, pa.string()))[1].tolist() == [0] * len(none)


def test_every_character_falls_into_the_words_of_the_library(library, codec):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for around in ("a{}", "1{}", "!{}"):  # one word if the character is of that class
        texts = [around.format(c) for c in points]
        words, owner = codec._cut(texts)
        assert np.bincount(owner).tolist() == [len(library.pre_tokenizer.pre_tokenize_str(t)) for t in texts]


def test_decodes_any_ids_as_the_library(library, codec):
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.choice([50256, 0, 94, 100, 127, 131, 168, 172, 187, 188, 255, 220, 447, 1000]) for _ in range(7)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError, match="not in the vocabulary"):
        codec.decode([50257])


def test_merges_as_a_plain_loop(codec):
    rng = random.Random(9)
    for _ in range(500):
        word = bytes(rng.choice(b"abehrst in") for _ in range(rng.randint(1, 40)))
        symbols = [codec.first[b] for b in word]
        while True:
            keys = [a * codec.width + b for a, b in zip(symbols, symbols[1:], strict=False)]
            found = [(codec.merges[p], i) for i, p in enumerate(keys) if p in codec.merges]
            if not found:
                break
            entry, i = min(found)
            symbols[i : i + 2] = [codec.made[entry >> 32]]
        assert codec.merged(word) == symbols


def test_columns(spark, library):
    df = spark.createDataFrame([(1, "Hello  world\n", "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "long " * 30_000, "<|endoftext|>")], "doc_id int, text string, ids string")
    coded = df.select("doc_id", "text", byte_bpe_codec.encode(F.col("text"), PATH).alias("coded"), byte_bpe_codec.round_trip(F.col("text"), PATH).alias("both"))
    rows = coded.select("*", byte_bpe_codec.decode(F.col("coded"), PATH).alias("back")).collect()
    assert len(rows) == 5
    for r in rows:
        assert r.coded == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.back == r.both.decoded == (r.text or "")
        assert r.both.n_tokens == len(r.coded) and np.frombuffer(r.both.packed, "<u4").tolist() == r.coded
    assert df.limit(0).select(byte_bpe_codec.round_trip(F.col("text"), PATH)).collect() == []
    assert spark.range(1).select(byte_bpe_codec.decode(F.lit(None).cast("array<int>"), PATH).alias("t")).first().t == ""


def test_refuses_other_kinds():
    with pytest.raises(ValueError, match="byte-level BPE"):
        byte_bpe_codec.ByteCodec(queries.tokenizer_path("word_bpe_49k.json"))


def test_query_on_small_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
