"""Byte-level BPE encoding and decoding without the library's encoder.

* A text is cut at its special tokens, then into words: character classes of the whole
  batch come from one table, and the cuts from comparisons of neighbours.
* The bytes of a word are a doubly linked list of symbols. A priority queue holds the
  neighbouring pairs by rank, then place; an entry whose pair has changed since is stale
  and skipped. A word of n bytes takes O(n log n) steps. Each distinct word of a batch is
  encoded once, and its ids are laid out wherever it occurs.
* Decoding concatenates the vocabulary's strings; bytes that are not UTF-8 become U+FFFD.

Texts: null counts as empty, an empty text has no ids and decodes to an empty text. Texts
of any length work: a batch is cut into slices of about 4 MB, and memory grows with the
longest text, linearly. Rows are independent: repeated rows get the same ids, an empty
table gives an empty result, and as this is a Column expression, other columns of any name
do no harm. Ids that the vocabulary lacks raise on decoding.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.llm.common import pieces, runs

ROUND_TRIP = "struct<n_tokens:bigint,packed:binary,decoded:string>"
SLICE_BYTES = 4 << 20
#: Words up to this many bytes are kept between batches, so many of them at most; longer or
#: rarer ones are encoded again, which changes no result.
KEPT_BYTES, KEPT_WORDS = 64, 1 << 19

LETTER, DIGIT, OTHER, SPACE, CUT, SPECIAL = range(6)

# White space of Unicode, and the letters and digits that Unicode 16.0 added
# (the classes of the library; Python 3.13 has those of 15.1).
WHITE_SPACE = "9-D 20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000"
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 "
    "113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
# The endings that are words of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(i))[0] for i in range(0x110000))
    first = np.frombuffer(kinds.encode(), np.uint8)
    table[first == ord("L")], table[first == ord("N")] = LETTER, DIGIT
    for spans, kind in ((WHITE_SPACE, SPACE), (NEW_LETTERS, LETTER), (NEW_DIGITS, DIGIT)):
        for span in spans.split():
            low, _, high = span.partition("-")
            table[int(low, 16) : int(high or low, 16) + 1] = kind
    return table


def _byte_of() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for: printable Latin-1
    characters for themselves, those from U+0100 on for the other bytes in their order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Words(dict):
    """Ids of words as bytes, made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteCodec:
    """The vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        known = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec["normalizer"]
        if model["type"] != "BPE" or not plain or not known or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normaliser, prefix space, affixes and dropout is supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only special tokens that are matched as they stand are supported")
        byte_of, vocab = _byte_of(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        raw = {i: bytes(map(byte_of.__getitem__, s)) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        #: Of each pair of symbols, as left * width + right, the place of its rank in a queue
        #: entry: rank 0 is entry 1 << 32, so that an entry plus a place below it stays in order.
        self.width = max(vocab.values()) + 1
        self.merges: dict[int, int] = {}
        self.made = [-1]
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[left] * self.width + vocab[right], len(self.made) << 32)
            self.made.append(vocab[left + right])
        self.byte_pairs = [self.merges.get(a * self.width + b, 0) for a in self.first for b in self.first]
        top = max(raw) + 1
        strings = [raw.get(i, b"") for i in range(top)]
        self.raw_size = np.fromiter(map(len, strings), np.int64, top)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.exists = np.fromiter((i in raw for i in range(top)), bool, top)
        self.classes = _classes()
        self.words = _Words(self._word)

    def _word(self, word: bytes) -> bytes:
        special = self.special.get(word.decode()) if word[:1] == b"<" or len(self.special) > 1 else None
        return np.array([special] if special is not None else self.merged(word), "<i4").tobytes()

    def merged(self, word: bytes) -> list[int]:
        """Symbols of a word after all merges, lowest rank first, leftmost of equal ranks."""
        symbol, n = list(map(self.first.__getitem__, word)), len(word)
        pair, merges, width, made = self.byte_pairs, self.merges.get, self.width, self.made
        queue = [entry + i for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (entry := pair[a << 8 | b])]
        if not queue:
            return symbol
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or merges(symbol[i] * width + symbol[j]) != entry - i:
                continue  # stale: one of the two has gone or been merged with another
            new = symbol[i] = made[entry >> 32]
            k = after[i] = after[j]
            symbol[j], after[j] = -1, n
            if k < n:
                before[k] = i
                if entry := merges(new * width + symbol[k]):
                    push(queue, entry + i)
            h = before[i]
            if h >= 0 and (entry := merges(symbol[h] * width + new)):
                push(queue, entry + h)
        return [s for s in symbol if s >= 0]

    def _starts(self, points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where words begin. A word is a run of letters, of digits or of others, with one
        space before it; of other white space a run, without the space or the last
        character if a word follows; or an apostrophe that begins a word, with its ending."""
        start = np.ones(len(points), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == CUT)
        follows = np.flatnonzero((kind[1:] <= OTHER) & (kind[:-1] == SPACE)) + 1
        start[follows - 1] = True
        start[follows] = points[follows - 1] != 0x20
        padded = np.concatenate((points, np.zeros(3, points.dtype)))  # no ending has a zero
        quote = np.flatnonzero((points == 0x27) & start & (kind == OTHER))
        for ending in ENDINGS:
            at = quote
            for k, c in enumerate(ending, 1):
                at = at[padded[at + k] == ord(c)]
            for k in range(1, len(ending) + 1):
                start[at + k] = False
            end = at + len(ending) + 1
            start[end[end < len(start)]] = True
        return start

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of texts, one text after the other, and the text of each."""
        owner = np.arange(len(texts))
        special = np.zeros(0, np.int64)
        if self.special_at:
            held = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
            if held:
                split = {i: self.special_at.split(texts[i]) for i in held}  # every second one is special
                owner = np.repeat(owner, [len(split.get(i, " ")) for i in range(len(texts))])
                texts = [x for i, t in enumerate(texts) for x in split.get(i, (t,))]
                special = np.flatnonzero(np.isin(owner, held))
                special = special[(special - np.searchsorted(owner, owner[special])) % 2 == 1]
        joined = "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kind[ends[:-1]] = CUT
        for i in special.tolist():
            kind[ends[i] - len(texts[i]) : ends[i]] = SPECIAL
        begin = np.flatnonzero(self._starts(points, kind))
        cuts = kind[begin] == CUT
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[np.append(begin, len(points))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
        return words.filter(pa.array(~cuts)), owner[np.cumsum(cuts)[~cuts]]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one text after the other, and how many each has."""
        given = [t or "" for t in texts.to_pylist()]
        if not any(given):
            return np.zeros(0, np.int32), np.zeros(len(given), np.int64)
        words, owner = self._cut(given)
        coded = words.dictionary_encode()
        found = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        each = np.frombuffer(b"".join(found), "<i4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy()
        ids = each[runs((np.cumsum(size) - size)[at], size[at])]
        return ids, np.bincount(owner, size[at], len(given)).astype(np.int64)

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids that lie one text after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.exists) or not self.exists[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.raw_size[ids]
        data = self.raw[runs(self.raw_start[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(lengths)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """The codec of a tokenizer file, built once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


def _slices(texts: pa.Array) -> list[pa.Array]:
    return [b.column(0) for b in pieces([pa.RecordBatch.from_arrays([texts], names=["t"])], 0, SLICE_BYTES)]


def encode(text: Column, path: str) -> Column:
    """Column of id arrays."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        made = [pa.array([], pa.list_(pa.int32()))]
        for some in _slices(texts):
            found, lengths = codec(path).encode_all(some)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.int32())))
        return pa.concat_arrays(made)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Column of texts of id arrays; a null array, like an empty one, gives an empty text."""

    @F.arrow_udf("string")
    def texts(arrays: pa.Array) -> pa.Array:
        lists = [np.array(a.as_py() or [], np.int64) for a in arrays]
        return pa.array([codec(path).decode_all(a, np.array([len(a)]))[0] for a in lists], pa.string())

    return texts(ids)


def round_trip(text: Column, path: str) -> Column:
    """Column of the number of ids, the ids as little-endian unsigned 32-bit integers, and
    the text that they decode to, in one pass to the workers."""

    @F.arrow_udf(ROUND_TRIP)
    def both(texts: pa.Array) -> pa.Array:
        c = codec(path)
        counts, packed, decoded = [pa.array([], pa.int64())], [pa.array([], pa.binary())], [pa.array([], pa.string())]
        for some in _slices(texts):
            ids, lengths = c.encode_all(some)
            ends = np.concatenate(([0], np.cumsum(lengths))) * 4
            counts.append(pa.array(lengths))
            packed.append(pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())]))
            decoded.append(pa.array(c.decode_all(ids, lengths), pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(x) for x in (counts, packed, decoded)], names=["n_tokens", "packed", "decoded"])

    return both(text)
