"""Word alignment with digit wildcards, and word edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.text import is_wildcard, normalize, tokens

#: Spoken words that a token with a digit may stand for.
MOST_WORDS = 5
SPANS = "struct<ok:boolean,spans:array<struct<digits:string,words:array<string>>>>"


class Windows:
    """Where each word occurs, as bits, in blocks no wider than the windows that are asked for,
    so that a window costs its own width and not the text's."""

    def __init__(self, words: list[str], width: int):
        self.size = size = max(width, 64)
        self.inside = (1 << width) - 1
        self.masks: dict[tuple[str, int], int] = {}
        for i, w in enumerate(words):
            key = (w, i // size)
            self.masks[key] = self.masks.get(key, 0) | 1 << i % size

    def at(self, word: str, start: int) -> int:
        """Bit d: the word stands at place start + d."""
        block, shift = divmod(start, self.size)
        both = self.masks.get((word, block), 0) >> shift
        if shift:
            both |= self.masks.get((word, block + 1), 0) << self.size - shift
        return both & self.inside


def _reaches(hyp: list[str], ref: list[str], wild: list[bool]) -> Iterator[int]:
    """After each token the places that can be reached: after i tokens bit d stands for the
    word i + d. Ends early where none can be."""
    slack = len(ref) - len(hyp)
    windows, reach = Windows(ref, slack + 1), 1
    for i, t in enumerate(hyp):
        if wild[i]:
            # one to five words: the bits move up by none to four
            more = reach | reach << 1
            reach = (more | more << 2 | reach << 4) & windows.inside
        else:
            reach &= windows.at(t, i)
        yield reach
        if not reach:
            return


def spells(hyp: list[str], ref: list[str]) -> bool:
    """Whether the tokens spell the words."""
    if not len(hyp) <= len(ref) <= MOST_WORDS * len(hyp):
        return False
    reach = 1
    for reach in _reaches(hyp, ref, [_has_digit(t) for t in hyp]):
        pass
    return bool(reach >> len(ref) - len(hyp) & 1)


def _has_digit(token: str) -> bool:
    return not token.isalpha() and any(c.isdecimal() for c in token)


def _fits_each(hyp: Column, ref: Column) -> Column:
    """Whether as many tokens as words fit one by one."""
    return F.forall(F.zip_with(hyp, ref, lambda h, r: (h == r) | is_wildcard(h)), lambda fits: fits)


def _may_fit(hyp: Column, ref: Column) -> Column:
    """Whether fewer tokens than words can fit, by their numbers and both ends: a plain
    token at an end equals the word there."""
    more = F.size(ref) - F.size(hyp)
    ends = [(F.try_element_at(hyp, F.lit(i)) == F.try_element_at(ref, F.lit(i))) | is_wildcard(F.try_element_at(hyp, F.lit(i))) for i in (-1, 1)]
    enough = more <= (MOST_WORDS - 1) * F.size(F.filter(hyp, is_wildcard))
    return F.coalesce((more > 0) & (more <= (MOST_WORDS - 1) * F.size(hyp)) & ends[0] & ends[1] & enough, F.lit(False))


def aligns(hyp: Column, ref: Column) -> Column:
    """Whether the tokens ``hyp`` spell ``ref``: plain tokens equal the next word, tokens
    with a digit take one to five words. Texts of any length; only rows with fewer tokens
    than words that may fit reach the matcher."""

    asked = F.when(_may_fit(hyp, ref), F.struct(hyp.alias("h"), ref.alias("r")))
    here = F.when(F.size(hyp) == F.size(ref), _fits_each(hyp, ref))

    @F.arrow_udf("boolean")
    def run(rows: pa.Array) -> pa.Array:
        ok, pairs = rows.flatten()
        return pa.array([spells(p["h"].as_py(), p["r"].as_py()) if p.is_valid else bool(o.as_py()) for o, p in zip(ok, pairs, strict=True)], pa.bool_())

    return run(F.struct(here.alias("ok"), asked.alias("pair")))


def spans_of(hyp: list[str], ref: list[str]) -> tuple[bool, list[tuple[str, list[str]]]]:
    """(aligned?, words of each wildcard). If several splits fit, later wildcards take
    the longer runs."""
    slack = len(ref) - len(hyp)
    if slack < 0:
        return False, []
    wild = [_has_digit(t) for t in hyp]
    reach = [1, *_reaches(hyp, ref, wild)]
    if not reach[-1] >> slack & 1:
        return False, []
    found, d = [], slack
    for i in range(len(hyp), 0, -1):
        if wild[i - 1]:
            more = max(n for n in range(MOST_WORDS) if n <= d and reach[i - 1] >> d - n & 1)
            found.append((hyp[i - 1], ref[i - 1 + d - more : i + d]))
            d -= more
    return True, found[::-1]


def align(hyp: Column, ref: Column) -> Column:
    """struct<ok, spans> of two token arrays. With as many tokens as words each wildcard takes
    one; only rows with fewer tokens that may fit reach the matcher."""
    none = F.array().cast("array<string>")
    hyp, ref = F.coalesce(hyp, none), F.coalesce(ref, none)
    asked = F.when(_may_fit(hyp, ref), F.struct(hyp.alias("h"), ref.alias("r")))
    each = F.zip_with(hyp, ref, lambda t, w: F.struct(t.alias("digits"), F.array(w).alias("words")))
    here = F.when((F.size(hyp) == F.size(ref)) & _fits_each(hyp, ref), F.filter(each, lambda s: is_wildcard(s["digits"])))

    @F.arrow_udf(SPANS)
    def run(rows: pa.Array) -> pa.Array:
        kind = pa.struct([("ok", pa.bool_()), ("spans", pa.list_(pa.struct([("digits", pa.string()), ("words", pa.list_(pa.string()))])))])
        spans, pairs = rows.flatten()
        ok, spans = spans.is_valid(), pc.fill_null(spans, pa.scalar([], spans.type)).cast(kind[1].type)
        asked = np.flatnonzero(pairs.is_valid().to_numpy(zero_copy_only=False))
        parts, at = [pa.StructArray.from_arrays([ok, spans], fields=list(kind))], np.arange(len(rows))
        at[asked] = len(rows) + np.arange(len(asked))
        # a few rows at a time as Python objects
        for n in range(0, len(asked), 64):
            out = []
            for p in pairs.take(pa.array(asked[n : n + 64])).to_pylist():
                ok_, found = spans_of(p["h"], p["r"])
                out.append({"ok": ok_, "spans": [{"digits": d, "words": w} for d, w in found]})
            parts.append(pa.array(out, kind))
        return pa.concat_arrays(parts).take(pa.array(at)) if len(asked) else parts[0]

    return run(F.struct(here.alias("spans"), asked.alias("pair")))


def validates(formatted: Column, unformatted: Column) -> Column:
    """Whether formatting kept every word."""
    return aligns(tokens(normalize(formatted)), tokens(normalize(unformatted)))


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Unit-cost word edits, as a fold over the reference words with one row of the
    table as state. For short texts; see ``edit_distance_udf`` for long ones."""
    first = F.transform(F.sequence(F.lit(0), F.size(hyp)), lambda i: i)

    def row(previous: Column, word: Column) -> Column:
        def cell(done: Column, i: Column) -> Column:
            swap = F.element_at(previous, i) + F.when(F.element_at(hyp, i) == word, 0).otherwise(1)
            return F.concat(done, F.array(F.least(F.element_at(done, -1) + 1, F.element_at(previous, i + 1) + 1, swap)))

        start = F.array(F.element_at(previous, 1) + 1)
        return F.when(F.size(hyp) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(hyp), F.lit(1))), start, cell))

    return F.element_at(F.aggregate(ref, first, row), -1)


def _apart_within(ref: list[str], hyp: list[str], band: int) -> int:
    """Edits between two texts if there are no more than ``band``, else more than that.

    A column of the table is its differences, as bits; only places within ``band`` of the
    diagonal are kept (Hyyrö's diagonal form of Myers' algorithm). Bit ``band + d`` stands for
    the reference word d places behind the current one; the bits of the diagonal on which
    the table ends add up to the distance."""
    windows = Windows(ref, 2 * band + 1)
    inside, end = windows.inside, len(ref) - len(hyp) + band
    up, down = inside >> band << band, 0  # differences along the column: +1, -1
    free = 0
    for j, word in enumerate(hyp):
        same = windows.at(word, j - band)
        level = ((same & up) + up ^ up | same | down) & inside
        right, left = down | inside & ~(level | up), level & up
        free += level >> end & 1
        below = level >> 1
        up, down = left | inside & ~(below | right), below & right
    return max(len(ref) - len(hyp), 0) + len(hyp) - free


def words_apart(ref: list[str], hyp: list[str]) -> int:
    """Word edit distance of texts of any length: equal ends go, then the band around the
    diagonal doubles until it holds the distance."""
    most = min(len(ref), len(hyp))
    start = next((i for i in range(most) if ref[i] != hyp[i]), most)
    tail = next((i for i in range(most - start) if ref[-1 - i] != hyp[-1 - i]), most - start)
    ref, hyp = ref[start : len(ref) - tail], hyp[start : len(hyp) - tail]
    if not ref or not hyp:
        return max(len(ref), len(hyp))
    band = max(32, abs(len(ref) - len(hyp)))
    while (found := _apart_within(ref, hyp, band)) > band:
        band *= 2
    return found


def edit_distance_udf(ref: Column, hyp: Column) -> Column:
    @F.arrow_udf("int")
    def run(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        # a few rows at a time as Python objects
        out = [
            words_apart(r or [], h or [])
            for n in range(0, len(refs), 64)
            for r, h in zip(refs[n : n + 64].to_pylist(), hyps[n : n + 64].to_pylist(), strict=True)
        ]
        return pa.array(out, pa.int32())

    return run(ref, hyp)
