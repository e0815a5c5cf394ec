"""Encoding a column's words on arrays, against the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from scriptloom.llm.sentencepiece_codec import PieceCodec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [*"abcdeftionsrhlABC.,'-0129 ", "\n", "é", "ß", "中", "😀", "\t", "\x00", "the", "ing", "ation", "aaaaaaaa", "▁", "İ", "ж", "\r", "x" * 60, "e" * 49, "ab" * 24]


def texts_of(n):
    draw = random.Random(2)
    return ["a" + "".join(draw.choice(ODD) for _ in range(draw.randint(0, 30))) for _ in range(n)] + [None, "", "\n", "\n\n", "a\n", "\nb", "\n" + "c" * 60]


def same_as_library(codec, texts):
    ids, lengths = codec.encode_all(pa.array(texts, pa.string()))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = np.split(ids, np.cumsum(lengths)[:-1])
    assert [x.tolist() for x in found] == [library.encode(t or "", add_eos=True) for t in texts]


def test_odd_words():
    same_as_library(PieceCodec(MODEL), texts_of(2000))


def test_few_places_for_pairs_and_few_words_at_once():
    class Small(PieceCodec):
        AT_ONCE, PLACES = 7, 16

    same_as_library(Small(MODEL), texts_of(200))


def test_no_word_is_encoded_by_itself():
    codec, draw = PieceCodec(MODEL), random.Random(3)
    codec.encode_segment = None  # before, each new word came here
    words = ["".join(draw.choice("abcdeftionsrhlmup,.") for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    same_as_library(codec, [" ".join(words[i : i + 10]) + "\n" + words[i] for i in range(0, 3000, 10)])


def test_runs_of_spaces():
    """Pieces of several marks have one score, so of these the leftmost merge comes first."""
    codec = PieceCodec(MODEL)
    same_as_library(codec, [f"{a}{' ' * n}{b}" for n in range(50) for a in ("", "a", "a\n") for b in ("", "concept", "x", "\n")])
