"""Where models plug in: taggers, punctuators, normalisers and audio decoders.

``load`` runs once in each Python worker and returns a function from a list of inputs to
a list of as many outputs; a failing input is the model's to answer with None. The model
itself is not part of this package.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from scriptloom.functions.tensors import SAMPLE_RATE
from scriptloom.functions.text import let, uppercase_at

Load = Callable[[], Callable[[list], list]]


def model_column(values: Column, load: Load, kind: str, at_once: int = 128) -> Column:
    """The model's outputs, of the SQL type ``kind``; it sees ``at_once`` values at a time."""
    state: dict = {}
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        if "model" not in state:
            state["model"] = load()
        out = []
        for a in range(0, len(column), at_once):
            some = column[a : a + at_once].to_pylist()
            out += state["model"](some)
            if len(out) != a + len(some):
                raise ValueError("the model must answer every input")
        return pa.array(out, arrow)

    return run(values)


def proper_nouns(text: Column, load: Load) -> Column:
    """The text with the characters upper case at the offsets that a tagger gives."""
    return F.when(text == "", text).otherwise(let(model_column(text, load, "array<int>"), lambda at: uppercase_at(text, at)))


def entity_labels(words: list[str], entities: list[tuple[int, str]]) -> list[str]:
    """A label for each word, ``0`` without one. Entities (end, label) come in order; a word
    uses up those that end before its own end, the space after it included, and takes
    the last of them."""
    labels, used, end = [], 0, 0
    ends = [e for e, _ in entities]
    for word in words:
        end += len(word) + 1
        stop = max(used, bisect_left(ends, end))
        labels.append(entities[stop - 1][1] if stop > used else "0")
        used = stop
    return labels


def merge_entities(words: Column, entities: Column) -> Column:
    """``entity_labels`` of array<string> and array<struct<end, entity>>."""

    @F.arrow_udf("array<string>")
    def run(w: pa.Array, e: pa.Array) -> pa.Array:
        rows = zip(w.to_pylist(), e.to_pylist(), strict=True)
        return pa.array([entity_labels(x or [], [(y["end"], y["entity"]) for y in z or []]) for x, z in rows], pa.list_(pa.string()))

    return run(words, entities)


def punctuated(words: Column, load: Load) -> Column:
    """The words with the marks that a model finds in the text they make. The model gives
    array<struct<end:int,entity:string>> for each text."""
    found = model_column(F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(" "), load, "array<struct<end:int,entity:string>>")
    marked = F.zip_with(words, merge_entities(words, found), lambda w, mark: F.concat(w, F.when(mark == "0", "").otherwise(mark)))
    return F.array_join(marked, " ")


def resample(wave: np.ndarray, rate: int, to: int = SAMPLE_RATE, zeros: int = 6, cut: float = 0.99) -> np.ndarray:
    """A wave at another rate, by sinc interpolation under a Hann window."""
    if rate == to or not len(wave):
        return wave
    common = math.gcd(rate, to)
    old, new = rate // common, to // common
    band = min(old, new) * cut
    reach = math.ceil(zeros * old / band)
    # one filter for each of the ``new`` phases
    t = np.clip((np.arange(-reach, reach + old) / old - np.arange(new)[:, None] / new) * band, -zeros, zeros)
    filters = np.sinc(t) * np.cos(t * np.pi / zeros / 2) ** 2 * band / old
    views = np.lib.stride_tricks.sliding_window_view(np.pad(wave, (reach, reach + old)), 2 * reach + old)[::old]
    return (views @ filters.T).reshape(-1)[: math.ceil(len(wave) * new / old)]


def audio_column(content: Column, load: Load) -> Column:
    """struct<wave array<float>, seconds double> of encoded audio. The decoder gives a
    pair (samples, rate) for each content, samples as frames or frames x channels; channels are
    averaged and other rates brought to 16 kHz. Null where it gives None."""

    def waves() -> Callable[[list], list]:
        decode = load()

        def one(found):
            if found is None:
                return None
            samples, rate = np.asarray(found[0], np.float64), found[1]
            wave = resample(samples.mean(axis=1) if samples.ndim > 1 else samples, rate)
            return {"wave": wave.astype(np.float32).tolist(), "seconds": len(wave) / SAMPLE_RATE}

        return lambda contents: [one(x) for x in decode(contents)]

    return model_column(content, waves, "struct<wave:array<float>,seconds:double>", 16)
