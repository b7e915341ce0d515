"""Spectra and similarity of clips.

Transforms of whole arrays are vectorised NumPy over a batch of equal lengths; what is linear and small (cosines of
known length, autocorrelation, similarity of two magnitude arrays) is built-in expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

REALS = ArrayType(DoubleType())
PLANES = StructType().add("re", REALS).add("im", REALS)


def next_pow2(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def next_pow2_column(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))).cast("long")


def pad_pow2(data: Column) -> Column:
    """Zeros up to the next power of two."""
    missing = next_pow2_column(F.size(data)) - F.size(data)
    return F.concat(data, F.array_repeat(F.lit(0.0), missing.cast("int")))


def _by_length(data: pd.Series, f) -> pd.Series:  # noqa: ANN001
    """f on the stacked clips of each length; null and empty clips give empty results."""
    out: list = [np.empty(0)] * len(data)
    lengths: dict[int, list[int]] = {}
    for i, clip in enumerate(data):
        if clip is not None and len(clip):
            lengths.setdefault(len(clip), []).append(i)
    for rows in lengths.values():
        for i, y in zip(rows, f(np.stack([np.asarray(data.iloc[i], float) for i in rows])), strict=True):
            out[i] = y
    return pd.Series(out)


def magnitudes(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x, next_pow2(x.shape[-1])))


@F.pandas_udf(REALS)
def real_fft(data: pd.Series) -> pd.Series:
    """Magnitudes of n / 2 + 1 bins, n the next power of two."""
    return _by_length(data, magnitudes)


def _fft(inverse: bool, any_length: bool):  # noqa: ANN202
    """A Column function: Python sees two arrays of numbers for each clip, never a record for each bin."""

    @F.pandas_udf(PLANES)
    def transform(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        size = re.map(lambda c: -1 if c is None else len(c))
        out = pd.DataFrame({"re": [None] * len(re), "im": [None] * len(re)}, dtype=object)
        for n in size.unique():
            if n < 0:
                continue
            if not any_length and n & (n - 1):
                raise ValueError("the length is not a power of two")
            at = np.flatnonzero(size == n)
            x = np.stack([np.asarray(re.iloc[i], float) + 1j * np.asarray(im.iloc[i], float) for i in at])
            y = (np.fft.ifft if inverse else np.fft.fft)(x) if n else x
            for i, row in zip(at, y, strict=True):
                out.iat[i, 0], out.iat[i, 1] = row.real, row.imag
        return out

    def of(data: Column | str) -> Column:
        clip = F.col(data) if isinstance(data, str) else data
        both = transform(clip.getField("re"), clip.getField("im"))
        return F.when(clip.isNotNull(), F.arrays_zip(both["re"].alias("re"), both["im"].alias("im")))

    return of


#: Radix-2 and any-length transforms of arrays of complex numbers, and their inverses.
fft, ifft = _fft(False, False), _fft(True, False)
mixed_radix_fft, mixed_radix_ifft = _fft(False, True), _fft(True, True)


def complex_of(data: Column) -> Column:
    return F.transform(data, lambda x: F.struct(x.alias("re"), F.lit(0.0).alias("im")))


def _kernel(n: int) -> np.ndarray:
    """(n / 2, n): the cosines of the transform of n samples."""
    i, k = np.arange(n), np.arange(n // 2)
    return np.cos(math.pi / n * np.outer(k + 0.5, i + 0.5 + n / 4))


@F.pandas_udf(REALS)
def mdct(data: pd.Series) -> pd.Series:
    """n samples (n even) to n / 2 coefficients."""

    def of(x: np.ndarray) -> np.ndarray:
        if x.shape[1] % 2:
            raise ValueError("the length must be even")
        return x @ _kernel(x.shape[1]).T

    return _by_length(data, of)


@F.pandas_udf(REALS)
def imdct(data: pd.Series) -> pd.Series:
    """n / 2 coefficients to n samples."""
    return _by_length(data, lambda x: x @ _kernel(2 * x.shape[1]) / x.shape[1])


def mdct_round_trip_error(signal: np.ndarray, frame: int) -> float:
    """Largest difference after overlapping and adding the transforms of half-overlapping frames; 0 for fewer than two."""
    count = (len(signal) - frame) // frame
    if count < 2:
        return 0.0
    kernel, out = _kernel(2 * frame), np.zeros(len(signal))
    for a in range(0, count * frame, frame):
        out[a : a + 2 * frame] += (signal[a : a + 2 * frame] @ kernel.T) @ kernel / frame
    inner = slice(frame, (count - 1) * frame)
    return float(np.max(np.abs(out[inner] - signal[inner]), initial=0.0))


def autocorrelation(data: Column, lags: int) -> Column:
    """Sums of products at lags 0 to lags - 1 (no more than the length), not normalised."""
    n = F.size(data)
    at = lambda k: F.aggregate(F.zip_with(F.slice(data, k + 1, n), data, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    count = F.least(F.lit(lags), n)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Held within [0, 1]; 0 if either is all zeros or empty."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def _interpolated(mag: np.ndarray, bins: np.ndarray) -> np.ndarray:
    i = np.minimum(bins.astype(np.int64), len(mag) - 1)
    j = np.minimum(i + 1, len(mag) - 1)
    return np.where(i >= len(mag) - 1, mag[-1], mag[i] + (bins - i) * (mag[j] - mag[i]))


def similarity(a: np.ndarray, rate_a: int, b: np.ndarray, rate_b: int, silence: float = 0.0) -> float:
    """Cosine of magnitude spectra, in [0, 1]. Different rates are compared on a common grid of frequencies up to the lower limit."""

    def trimmed(x: np.ndarray) -> np.ndarray:
        loud = np.flatnonzero(np.abs(x) > silence)
        return x[loud[0] : loud[-1] + 1] if len(loud) else x[:0]

    a, b = (trimmed(x) if silence > 0 else x for x in (np.asarray(a, float), np.asarray(b, float)))
    if not len(a) or not len(b):
        return 0.0
    if rate_a > 0 and rate_b > 0 and rate_a != rate_b:
        na, nb = next_pow2(len(a)), next_pow2(len(b))
        step = min(rate_a / na, rate_b / nb)
        freq = np.arange(int(min(rate_a, rate_b) / 2 / step) + 1) * step
        u, v = _interpolated(np.abs(np.fft.rfft(a, na)), freq * na / rate_a), _interpolated(np.abs(np.fft.rfft(b, nb)), freq * nb / rate_b)
    else:
        n = next_pow2(max(len(a), len(b)))
        u, v = np.abs(np.fft.rfft(a, n)), np.abs(np.fft.rfft(b, n))
    scale = float(np.sqrt(u @ u) * np.sqrt(v @ v))
    return min(max(float(u @ v) / scale, 0.0), 1.0) if scale else 0.0


@F.pandas_udf(DoubleType())
def spectral_similarity(a: pd.Series, rate_a: pd.Series, b: pd.Series, rate_b: pd.Series, silence: pd.Series) -> pd.Series:
    return pd.Series([similarity(*x) for x in zip(a, rate_a, b, rate_b, silence, strict=True)], dtype=float)


def similar_to(clips: DataFrame, references: DataFrame) -> DataFrame:
    """clips and references: (clip_id, data), references one per label. Cosine of every clip's spectrum with its label's reference."""
    spectra = clips.select("clip_id", "label", real_fft("data").alias("m"))
    known = references.select("label", F.col("clip_id").alias("reference"), real_fft("data").alias("r"))
    return spectra.join(known, "label").select("label", "clip_id", "reference", cosine(F.col("m"), F.col("r")).alias("similarity"))
