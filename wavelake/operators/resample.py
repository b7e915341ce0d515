"""Sample-rate conversion: streaming converters with state and a gliding ratio, and band-limited conversion of whole clips."""

from __future__ import annotations

import copy
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Ratios (output rate over input rate) outside are refused.
LOWEST, HIGHEST = 1 / 256, 256.0
#: Quality -> zero crossings on each side of the kernel, and the Kaiser window's beta. Our own choice, no published table.
QUALITIES = {"fastest": (8, 6.0), "medium": (24, 8.5), "best": (64, 12.0)}


def valid_ratio(ratio: float) -> bool:
    return LOWEST <= ratio <= HIGHEST


class Converter:
    """Hold or linear conversion of a stream, block by block. x: (rows, frames).

    Output k of a constant ratio lies at input position k / ratio, of which the fraction is carried between blocks; the
    frame before a block is kept, so output lags one frame. A ratio that was set anew is glided to over the next block.
    """

    def __init__(self, kind: str, rows: int, ratio: float) -> None:
        if kind not in ("hold", "linear"):
            raise ValueError(f"no streaming converter is named {kind}")
        self.kind, self.rows = kind, rows
        self.set_ratio(ratio)
        self.reset()

    def set_ratio(self, ratio: float) -> None:
        if not valid_ratio(ratio):
            raise ValueError(f"the ratio {ratio} is out of range")
        self.ratio = ratio

    def reset(self) -> None:
        self.last, self.position, self.current = None, 0.0, None

    def clone(self) -> Converter:
        return copy.deepcopy(self)

    def _positions(self, n: int) -> np.ndarray:
        """Input positions of this block's outputs, in frames from its first."""
        if self.current is None or abs(self.current - self.ratio) < 1e-20:
            count = max(0, math.ceil((n - self.position) * self.ratio - 1e-12))
            at = self.position + np.arange(count) / self.ratio
            self.position = self.position + count / self.ratio - n
        else:
            count = max(1, round(n * (self.current + self.ratio) / 2))
            steps = 1 / (self.current + (self.ratio - self.current) * np.arange(count) / count)
            at = self.position + np.concatenate([[0], np.cumsum(steps)[:-1]])
            inside = at < n
            self.position = float(at[inside][-1] + steps[inside][-1] - n) if inside.any() else self.position - n
            at = at[inside]
        self.current = self.ratio
        return at

    def process(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if not n:
            return x
        before = x[:, :1] if self.last is None else self.last
        padded = np.concatenate([before, x], 1)  # padded[:, i] is the frame before x[:, i]
        at = self._positions(n)
        i = np.minimum(np.floor(at + 1e-12).astype(np.int64), n - 1)
        part = np.clip(at - i, 0.0, 1.0)
        self.last = x[:, -1:].copy()
        return padded[:, i] if self.kind == "hold" else padded[:, i] + part * (padded[:, i + 1] - padded[:, i])


def sinc_matrix(n: int, rate_in: int, rate_out: int, quality: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights), each (outputs, taps): what every output frame sums. Weights add up to one, so a constant stays what it is."""
    crossings, beta = QUALITIES[quality]
    ratio = Fraction(rate_out, rate_in)
    count = int(n * ratio)
    cut = min(1.0, float(ratio))  # below the lower of the two limits
    at = np.arange(count) * (rate_in / rate_out)
    half = math.ceil(crossings / cut)
    index = np.floor(at).astype(np.int64)[:, None] + np.arange(-half + 1, half + 1)
    x = (index - at[:, None]) * cut
    inside = np.clip(1 - (x / crossings) ** 2, 0.0, None)
    weights = np.sinc(x) * np.i0(beta * np.sqrt(inside)) * (inside > 0)
    weights *= (index >= 0) & (index < n)
    total = weights.sum(1, keepdims=True)
    return np.clip(index, 0, max(n - 1, 0)), np.divide(weights, total, out=np.zeros_like(weights), where=np.abs(total) > 1e-12)


def resample_sinc(df: DataFrame, rate_in: int, rate_out: int, quality: str = "medium", column: str = "data", channels: int = 1) -> DataFrame:
    """df with the clips of ``column`` converted band-limited. Clips of one length share their weights; null stays null."""
    if quality not in QUALITIES or not valid_ratio(rate_out / rate_in):
        raise ValueError("unknown quality, or a ratio out of range")

    @F.pandas_udf(ArrayType(DoubleType()))
    def converted(data: pd.Series) -> pd.Series:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for clip in data:
            if clip is None:
                out.append(None)
                continue
            x = np.asarray(clip, float)
            frames = len(x) // channels
            if frames not in known:
                known[frames] = sinc_matrix(frames, rate_in, rate_out, quality)
            index, weights = known[frames]
            planes = x[: frames * channels].reshape(frames, channels)
            out.append(np.einsum("ot,otc->oc", weights, planes[index]).reshape(-1) if frames else np.empty(0))
        return pd.Series(out)

    return df.withColumn(column, converted(F.col(column)))


def resample_streaming(df: DataFrame, kind: str, ratio: float, column: str = "data") -> DataFrame:
    """df with the mono clips of ``column`` run through a fresh Converter."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def converted(data: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else Converter(kind, 1, ratio).process(np.asarray(c, float)[None, :])[0] for c in data])

    return df.withColumn(column, converted(F.col(column)))
