"""Numeric kernels over arrays: spectrograms, pooling, losses, sequence layout."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feature extractor.
SAMPLE_RATE, N_FFT, HOP, N_MELS = 16_000, 400, 160, 80


def mel_filters(rate: int = SAMPLE_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS) -> np.ndarray:
    """Triangular filters on the 2595 log10(1 + f / 700) scale, not normalised: (n_mels, bins)."""
    mel = np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), n_mels + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(wave: np.ndarray) -> np.ndarray:
    """(80, T // 160) features of a mono wave at 16 kHz."""
    padded = np.pad(np.asarray(wave, np.float64), N_FFT // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::HOP][:-1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    level = np.log10(np.maximum(mel_filters() @ power.T, 1e-10))
    return ((np.maximum(level, level.max() - 8) + 4) / 4).astype(np.float32)


def log_mel_column(wave: Column) -> Column:
    """array<array<float>> of an array<float> wave; null for waves of 200 samples or fewer."""

    @F.arrow_udf("array<array<float>>")
    def run(waves: pa.Array) -> pa.Array:
        rows = [w.values.to_numpy(zero_copy_only=False) if w.is_valid else [] for w in waves]
        return pa.array([log_mel(w).tolist() if len(w) > N_FFT // 2 else None for w in rows], pa.list_(pa.list_(pa.float32())))

    return run(wave)


def mean_pool(frames: Column, by: int = 4) -> Column:
    """Means of runs of ``by`` values; zeros fill the last run and count."""
    n = F.ceil(F.size(frames) / by).cast("int")
    run = lambda i: F.aggregate(F.slice(frames, i * by + 1, by), F.lit(0.0), lambda s, x: s + x) / by
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), run)).otherwise(F.array().cast("array<double>"))


def token_losses(logits: Column, label: Column) -> Column:
    """struct<loss, pred, entropy> of a position's logits (small vocabularies stay in
    the JVM); null label: null loss."""
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top) * (x - top))
    return F.struct(
        (F.log(total) + top - F.element_at(logits, label + 1)).alias("loss"),
        (F.array_position(logits, top) - 1).cast("int").alias("pred"),
        (F.log(total) - weighted / total).alias("entropy"),
    )


def prefix(audio: Column, instruction: Column, sep: int) -> Column:
    """What generation starts from: audio SEP instruction SEP."""
    mark = F.array(F.lit(sep))
    return F.concat(audio, mark, instruction, mark)


def extended(prefixes: Column, generated: Column, longest: Column, steps: Column, fill: Column) -> Column:
    """A row of a generation batch after some steps: the tokens so far right behind its own
    prefix, padded to the longest prefix of the batch and as many places as steps."""
    return pad(F.concat(prefixes, F.slice(generated, F.lit(1), steps)), longest + steps, fill)


def assemble(audio: Column, instruction: Column, transcript: Column, sep: int) -> Column:
    """struct<inputs, labels>: the prefix, then transcript SEP, with labels for the
    transcript and its end only (null elsewhere)."""
    mark = F.array(F.lit(sep))
    masked = F.array_repeat(F.lit(None).cast("int"), F.size(audio) + F.size(instruction) + 2)
    return F.struct(F.concat(prefix(audio, instruction, sep), transcript, mark).alias("inputs"), F.concat(masked, transcript, mark).alias("labels"))


def pad(values: Column, length: Column, fill: Column) -> Column:
    """Right-padded to a length; longer arrays are cut."""
    return F.slice(F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0)).cast("int"))), F.lit(1), length.cast("int"))


def warmup_factor(step: Column, warmup: Column) -> Column:
    return F.least(step / F.greatest(warmup, F.lit(1)), F.lit(1.0))


def rows_in_subspace(components: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Random unit combinations of principal components: (rows, dim)."""
    mix = np.random.default_rng(seed).standard_normal((rows, len(components)))
    return mix / np.linalg.norm(mix, axis=1, keepdims=True) @ components
