"""Toxicity scores of deobfuscated text.

The channel. A writer meant a plain word and sent an obfuscated one: letters became
look-alikes (leetspeak), separators went between letters, letters were repeated. Every
suspicious token spans a lattice: each character stays, becomes a letter it stands for,
or (separators, further copies of a repeated letter) vanishes, at a cost each. A Viterbi
search over the lattice under a character trigram model gives the word most likely
meant. Runs of single letters (``i d i o t``) are read as one word, and as the most likely
words. Tokens that are not suspicious have one path only and pass as they are.

The character model needs no labels and counts every word of letters in all texts. Its
symbols are the letters that the channel can restore, a to z (accented ones count as their
base), and one class for all other letters, so at most 28 * 28 * 28 trigrams exist and none
is left out.

The score. Presence of words and word beginnings of the restored text, with weights
from a logistic regression. Labels are learned only from the rows that the caller
passes; the sample is bounded by ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` rows (by hash
of the id). Features are all that tell the kinds apart, either way: those whose counts have
a chance below ``CHANCE`` among as many random rows. Scoring covers every row and whole texts.

Null and empty texts get the score of a text without features. Without usable labels
(none at all, or of one kind) every row gets the share of toxic labels, or 0. A labelled
document is a distinct pair of id and text: rows that repeat it count once, and an id
with several texts gives each of them its label. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import store

MAX_POSITIVE, MAX_NEGATIVE, CHANCE = 4000, 8000, 1e-2
#: Distinct words, and characters of texts with long words, that a task counts before it breaks
#: them into trigrams.
WORDS_AT_ONCE, WIDE_AT_ONCE = 200_000, 2_000_000
#: Longer tokens are read like others, but not kept in the caches, to bound their memory.
CACHED_LENGTH = 40
#: Symbols of the character model for letters beyond a to z, and for all that is no letter.
OTHER, SIGN = "\u03bb", "#"

#: Letters that a character can stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~·'`^,/\\"
COST_SWAP, COST_DROP, COST_REPEAT, COST_KEEP_ODD = 1.0, 0.7, 0.5, 6.0

_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[^\w@$€£+(!|]+|[^\w@$€£+]+$")
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€£])(?:[ .\-_*][^\W_]|[ .\-_*][@$!|+(€£]){2,}(?!\S)")
_MIXED = re.compile(r"[^\W\d_]")
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES) + SEPARATORS) + "]")


@lru_cache(maxsize=1 << 16)
def symbol(c: str) -> str:
    """What the character model takes a character for."""
    base = unicodedata.normalize("NFD", c)[0]
    if "a" <= base <= "z":
        return base
    return OTHER if c.isalpha() else SIGN


@dataclass
class CharModel:
    """Trigrams of symbols with add-half smoothing between word boundaries (``^``, ``$``)."""

    counts: dict[str, int] = field(default_factory=dict)
    letters: int = 64

    @classmethod
    def fit(cls, words: Counter) -> CharModel:
        counts: Counter = Counter()
        for word, n in words.items():
            if word.isalpha():
                padded = f"^^{''.join(map(symbol, word))}$"
                for i in range(2, len(padded)):
                    counts[padded[i - 2 : i + 1]] += n
                    counts[padded[i - 2 : i]] += n
        return cls(dict(counts), len({c for k in counts for c in k}) + 1)

    def cost(self, context: str, c: str) -> float:
        return -math.log((self.counts.get(context + c, 0) + 0.5) / (self.counts.get(context, 0) + 0.5 * self.letters))

    def decode(self, token: str, split: bool = False) -> str:
        """The most likely word behind a token; with ``split`` the most likely words, between
        spaces. Time is linear at any length: the start on which all paths agree is set
        aside, so that paths stay short."""
        paths = {"^^": (0.0, "")}
        settled: list[str] = []
        for i, c in enumerate(token):
            if i % 32 == 31:
                start = commonprefix([out for _, out in paths.values()])
                settled.append(start)
                paths = {context: (cost, out[len(start) :]) for context, (cost, out) in paths.items()}
            if split:
                ends = min(((cost + self.cost(x, "$"), out + " ") for x, (cost, out) in paths.items() if x != "^^"), default=None)
                if ends and ("^^" not in paths or ends[0] < paths["^^"][0]):
                    paths["^^"] = ends
            steps = [(c, 0.0 if c.isalpha() else COST_KEEP_ODD)]
            steps += [(x, COST_SWAP) for x in LOOKALIKES.get(c, "")]
            if c in SEPARATORS or not (c.isalnum() or c in LOOKALIKES):
                steps.append(("", COST_DROP))
            if i and c == token[i - 1] and c in (token[i + 1 : i + 2], token[i - 2 : i - 1] if i > 1 else ""):  # of three or more
                steps.append(("", COST_REPEAT))
            new: dict[str, tuple[float, str]] = {}
            for context, (cost, out) in paths.items():
                for x, extra in steps:
                    total, to = cost + extra, context
                    if x:
                        sign = symbol(x)
                        total += self.cost(context, sign)
                        to = context[1] + sign
                    if to not in new or total < new[to][0]:
                        new[to] = (total, out + x)
            paths = new
        settled.append(min((cost + self.cost(context, "$"), out) for context, (cost, out) in paths.items())[1])
        return "".join(settled)


def _joined(spaced: str) -> str:
    """The characters of spaced letters; a closing sign is punctuation, not a letter."""
    return re.sub(r"[ .\-_*]", "", spaced).rstrip("!|+(")


def suspicious(token: str) -> bool:
    """Worth a lattice: letters mixed with look-alikes or separators, or a letter three times."""
    return bool(_MIXED.search(token)) and (bool(_RUN.search(token)) or bool(_ODD.search(token)))


class Restorer:
    """Restores the tokens of texts; keeps what it has seen, within a bound."""

    KEEP = 50_000

    def __init__(self, model: CharModel):
        self.model = model
        self.seen: dict[str, str] = {}

    def token(self, token: str) -> str:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) >= self.KEEP:
                self.seen.clear()
            found = _EDGES.sub("", token)
            if suspicious(found):
                found = self.model.decode(found)
            if len(token) <= CACHED_LENGTH:
                self.seen[token] = found
        return found

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words of a text. Of spaced letters the joined word comes too, and
        the most likely words that they hold."""
        low = (text or "").lower()
        found = set(map(self.token, set(low.split())))
        for m in _SPACED.finditer(low):
            joined = _joined(m[0])
            if _MIXED.search(joined):
                found.add(self.model.decode(joined))
                found.update(self.model.decode(joined, split=True).split())
        found.discard("")
        return found

    def text(self, text: str | None) -> str:
        """The text with each obfuscated token replaced by its restored word."""

        def whole(m):
            joined = _joined(m[0])
            return self.model.decode(joined, split=True) if _MIXED.search(joined) else m[0]

        def one(m):
            bare = _EDGES.sub("", m[0])
            return m[0].replace(bare, self.model.decode(bare), 1) if bare and suspicious(bare) else m[0]

        return _TOKEN.sub(one, _SPACED.sub(whole, (text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings of three to six characters."""
    return [word] + ["^" + word[:n] for n in range(3, 7) if len(word) >= n]


@dataclass
class ToxicModel:
    chars: CharModel
    weights: dict[str, float]
    bias: float

    def scorer(self):
        restorer = Restorer(self.chars)
        seen: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            active: set[str] = set()
            for word in restorer.words(text):
                hit = seen.get(word)
                if hit is None:
                    if len(seen) >= 2 * Restorer.KEEP:
                        seen.clear()
                    hit = tuple(f for f in features_of(word) if f in self.weights)
                    if len(word) <= CACHED_LENGTH:
                        seen[word] = hit
                if hit:
                    active.update(hit)
            z = self.bias + sum(map(self.weights.__getitem__, sorted(active)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _one_label(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")


def _sample(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(text, toxic) of a bounded sample of ``labelled`` (doc_id, h, toxic): of each kind the
    first by hash of the id. Texts meet only the chosen pairs of id and hash, of which
    there are MAX_POSITIVE + MAX_NEGATIVE at most; of equal rows one comes."""
    order = F.xxhash64(F.col("doc_id"), F.lit("toxic"))
    kinds = [labelled.where(F.col("toxic") == y).orderBy(order, "doc_id", "h").limit(most) for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    chosen = F.broadcast(store(kinds[0].unionAll(kinds[1])))
    return docs.select("doc_id", _text_hash(), "text").join(chosen, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("text", "toxic")


def _break(words: Counter, grams: Counter) -> None:
    """Adds the trigrams of words, as three code points of symbols, of 21 bits each."""
    padded, counts = [], []
    for word, n in words.items():
        if not word.isalpha():
            word = _EDGES.sub("", word)
            if not word.isalpha():
                continue
        padded.append(f"^^{word}$")
        counts.append(n)
    if not padded:
        return
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.int64)
    far = np.flatnonzero(codes > 127)
    kinds, kind = np.unique(codes[far], return_inverse=True)
    codes[far] = np.array([ord(symbol(chr(k))) for k in kinds.tolist()], np.int64)[kind]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    starts = np.ones(len(codes), bool)
    ends = np.cumsum(lengths)
    starts[ends - 1] = starts[ends - 2] = False
    starts = np.flatnonzero(starts)
    found, group = np.unique(codes[starts] << 42 | codes[starts + 1] << 21 | codes[starts + 2], return_inverse=True)
    sums = np.bincount(group, weights=np.repeat(counts, lengths)[starts]).astype(np.int64)
    for gram, n in zip(found.tolist(), sums.tolist(), strict=True):
        grams[gram] += n


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): trigrams, and the pairs they begin with, of a task's words, each summed."""
    grams: Counter = Counter()
    counts: Counter = Counter()
    wide = 0
    for batch in batches:
        for t in batch.column(0):
            text = (t.as_py() or "").lower()
            words = text.split()
            counts.update(words)
            if len(text) > 16 * len(words):
                wide += len(text)
            if len(counts) > WORDS_AT_ONCE or wide > WIDE_AT_ONCE:
                _break(counts, grams)
                counts.clear()
                wide = 0
    _break(counts, grams)
    texts: Counter = Counter()
    for gram, n in grams.items():
        three = "".join(chr(gram >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        texts[three] += n
        texts[three[:2]] += n
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array(texts.keys(), pa.string()), pa.array(texts.values(), pa.int64())], names=["gram", "n"])


def char_model(texts: DataFrame) -> CharModel:
    """The character model of all texts (column text); the driver receives its counts, which the
    symbols bound."""
    rows = texts.select("text").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return CharModel({r.gram: r.n for r in rows}, len({c for r in rows for c in r.gram}) + 1)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic 0 or 1); a bounded
    sample of the labelled documents is learned from. A document with several labels is
    toxic if one of them says so.

    Character counts and feature counts are aggregated by Spark; the driver receives
    trigram counts, the chosen features and, for each sampled row, its features.
    """
    labelled = store(docs.select("doc_id", _text_hash()).join(_one_label(labels), "doc_id").distinct())
    sample = store(_sample(docs, labelled))
    chars = char_model(docs)
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        share = pos / (pos + neg) if pos + neg else 0.0
        return ToxicModel(chars, {}, -30.0 if share == 0 else 30.0)

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        restorer = Restorer(chars)
        return pa.array([sorted({f for w in restorer.words(t.as_py()) for f in features_of(w)}) for t in texts], pa.list_(pa.string()))

    rows = store(sample.select(F.col("toxic").alias("y"), words("text").alias("features")))
    counted = (
        rows.select("y", F.explode("features").alias("f"))
        .groupBy("f")
        .agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))
    )
    # each sampled row stands for as many labelled rows of its kind
    every = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = {1: every[1] / pos, 0: every[0] / neg}
    rate, share = pos / (pos + neg), every[1] / (every[1] + every[0])
    p, q = F.col("p"), F.col("q")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    # Chernoff: counts as far from the sample's rate as these have a chance of exp(-odd) at most
    odd = part(p, (p + q) * rate) + part(q, (p + q) * (1 - rate))
    best = counted.where(odd > -math.log(CHANCE)).orderBy("f")
    at = {r.f: i for i, r in enumerate(best.collect())}
    if not at:
        return ToxicModel(chars, {}, math.log(share / (1 - share)))

    @F.arrow_udf("array<int>")
    def hits(lists: pa.Array) -> pa.Array:
        return pa.array([[at[f] for f in x.as_py() if f in at] for x in lists], pa.list_(pa.int32()))

    data = rows.select("y", hits("features").alias("x")).collect()
    return ToxicModel(chars, *_regress(at, [(r.y, r.x) for r in data], weight))


def _regress(at: dict[str, int], rows: list[tuple[int, list[int]]], weight: dict[int, float]) -> tuple[dict[str, float], float]:
    """Logistic regression with a ridge, by accelerated gradient steps over sparse rows.
    Each kind of row is sampled at its own rate, 1 / ``weight``. That shifts the bias alone, by
    the log ratio of the weights, which the fitted bias gets back."""
    y = np.array([r[0] for r in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.array([c for r in rows for c in r[1]], dtype=np.int64)
    n, m, ridge = len(rows), len(at), 1.0
    w, bias = np.zeros(m), math.log(y.mean() / (1 - y.mean()))
    squares = np.bincount(owner, minlength=n).max() + 1
    step = 4.0 / (n * squares) * max(1.0, n / max(1, np.bincount(column, minlength=m).max()))
    look, look_bias, t = w.copy(), bias, 1.0
    for _ in range(400):
        z = look_bias + np.bincount(owner, weights=look[column], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = look - step * (np.bincount(column, weights=error[owner], minlength=m) + ridge * look)
        new_bias = look_bias - step * error.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return {f: float(w[i]) for f, i in at.items()}, float(bias) + math.log(weight[1] / weight[0])


def score_column(text: Column, model: ToxicModel) -> Column:
    """Scores from 0 to 1; the model (trigram counts, and features of the bounded sample) goes along."""

    state: dict = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "score" not in state:
            state["score"] = model.scorer()
        return pa.array([state["score"](t.as_py()) for t in texts], pa.float64())

    return score(text)
