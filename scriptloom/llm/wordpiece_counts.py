"""Token counts by a linear longest-match automaton.

Greedy word pieces (the longest piece that fits, then on) without building pieces. The
vocabulary is a trie with two roots, for pieces that begin a word and for continuations.
Each node has a failure link, the node where matching goes on after the longest pieces
of the current match are taken off, and the number of pieces taken. A word of n
characters costs O(n) steps, however often the longest match fails.

Words are [^\\x20\\x09-\\x0D]+, of any length. A word that has no full cover counts as one
unknown piece. Null and empty texts have no words. Every row is counted by itself, so
repeated rows count alike, an empty table gives none, and other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.llm.sentencepiece_codec import MARK, PieceCodec

COUNTS = "struct<n_words:long,n_tokens:long,n_unknown:long>"
_UNKNOWN = 1 << 40
_WORD = re.compile("[^\x20\x09-\x0d]+")


class LongestMatch:
    KEEP, LONGEST = 300_000, 48

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    at = self.next[at][c]
                if at > 1:
                    token[at] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
            level = below
        self.seen: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """Number of greedy pieces of a word; 0 if it has none."""
        at, n = 0, 0
        for c in word:
            while (to := self.next[at].get(c)) is None:
                if self.fail[at] < 0:
                    return 0
                n += self.popped[at]
                at = self.fail[at]
            at = to
        while at != 1:
            if self.fail[at] < 0:
                return 0
            n += self.popped[at]
            at = self.fail[at]
        return n

    def _count(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = self.pieces(word) or _UNKNOWN + 1
        if len(word) <= self.LONGEST:
            if len(self.seen) >= self.KEEP:
                self.seen, self.older = {}, self.seen
            self.seen[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = _WORD.findall(text or "")
        get = self.seen.get
        total = 0
        for w in words:
            n = get(w)
            if n is None:
                n = self._count(w)
                get = self.seen.get
            total += n
        return len(words), total % _UNKNOWN, total // _UNKNOWN


def from_piece_model(model_path: str) -> LongestMatch:
    """Word pieces of a SentencePiece vocabulary: a marked piece begins a word, any other
    piece continues one; pieces with inner marks and byte pieces are left out."""
    names = [n for n in PieceCodec(model_path).ids if MARK not in n[1:] and n != MARK]
    return LongestMatch([n[1:] for n in names if n[0] == MARK], [n for n in names if n[0] != MARK])


_automata: dict[str, LongestMatch] = {}


def count_column(text: Column, model_path: str) -> Column:
    """Column of struct<n_words, n_tokens, n_unknown>."""

    @F.arrow_udf(COUNTS)
    def count(texts: pa.Array) -> pa.Array:
        if model_path not in _automata:
            _automata[model_path] = from_piece_model(model_path)
        a = _automata[model_path]
        rows = [a.count(t.as_py()) for t in texts]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_tokens", "n_unknown"])

    return count(text)
