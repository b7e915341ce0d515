"""Lossless-audio prediction: fixed and linear predictors, stereo decorrelation, over arrays of integers."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import bind


def fixed_residual(samples: DataFrame, keys: list[str], at: str, x: str, order: int) -> Column:
    """The order-th difference along ``at``: lags with binomial weights. Null for the first ``order`` samples (the warm-up)."""
    w = Window.partitionBy(*keys).orderBy(at)
    out = F.col(x)
    for k in range(1, order + 1):
        out = out + F.lag(x, k).over(w) * ((-1) ** k * comb(order, k))
    return out


def fixed_residual_array(data: Column, order: int) -> Column:
    """The same over an array: warm-up samples as they are, then residuals; differences of differences, each taken once."""

    def differences(a: Column, k: int) -> Column:
        n = F.greatest(F.size(a) - 1, F.lit(0))
        step = F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda x, y: x - y)
        return bind(step, lambda d: differences(d, k - 1)) if k else a

    return F.concat(F.slice(data, 1, order), differences(data, order)) if order else data


def fixed_restore(data: np.ndarray, order: int) -> np.ndarray:
    """The inverse: the warm-up gives the leading differences, then one running sum for each order."""
    y = np.array(data, np.int64)
    head = min(order, len(y))
    for j in range(1, head):
        y[j:head] = y[j:head] - y[j - 1 : head - 1]
    for j in range(head, 0, -1):
        y[j - 1 :] = np.cumsum(y[j - 1 :])
    return y


def fixed_restore_array(data: Column, order: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def restored(clips: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else fixed_restore(c, order) for c in clips])

    return restored(data)


def lpc_restore(df: DataFrame, column: str, coefficients: list[int], shift: int) -> DataFrame:
    """Residuals to samples by a quantised linear predictor; the first samples are the warm-up. Clips of a batch go together."""
    order, weights = len(coefficients), np.array(coefficients[::-1], np.int64)

    @F.pandas_udf("array<bigint>")
    def restored(data: pd.Series) -> pd.Series:
        out = []
        for clip in data:
            y = np.array(clip, np.int64)
            for t in range(order, len(y)):
                y[t] += int(weights @ y[t - order : t]) >> shift
            out.append(y)
        return pd.Series(out)

    return df.withColumn(column, restored(F.col(column)))


def lpc_residual_array(data: Column, coefficients: list[int], shift: int) -> Column:
    order = len(coefficients)
    guess = lambda i: sum((F.get(data, i - 1 - k) * c for k, c in enumerate(coefficients)), F.lit(0).cast("bigint"))
    return F.transform(data, lambda x, i: F.when(i < order, x).otherwise(x - F.shiftright(guess(i), shift)))


def undo_stereo(kind: str, first: Column, second: Column) -> tuple[Column, Column]:
    """(left, right) of a decorrelated pair: 'left_side', 'right_side', 'mid_side' or 'independent'."""
    if kind == "left_side":
        return first, first - second
    if kind == "right_side":
        return first + second, second
    if kind == "mid_side":
        whole = F.shiftleft(first, 1) + F.abs(second) % 2
        return F.shiftright(whole + second, 1), F.shiftright(whole - second, 1)
    return first, second


def levinson_durbin(autocorrelation: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(predictor coefficients of the order, prediction error of every order up to it)."""
    a, error, errors = np.zeros(order), float(autocorrelation[0]), []
    for i in range(order):
        k = (autocorrelation[i + 1] - a[:i] @ autocorrelation[i:0:-1][:i]) / error if error > 0 else 0.0
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error *= 1 - k * k
        errors.append(error)
    return a, np.array(errors)


def quantise_coefficients(a: np.ndarray, precision: int) -> tuple[list[int], int]:
    """(integers of ``precision`` bits, shift); the rounding error of each is carried to the next."""
    top = float(np.max(np.abs(a), initial=0.0))
    if top <= 0:
        return [0] * len(a), 0
    limit = (1 << (precision - 1)) - 1
    shift = min(max(precision - 1 - (int(np.floor(np.log2(top))) + 1), 0), 15)
    out, carried = [], 0.0
    for x in a:
        carried += float(x) * (1 << shift)
        q = int(min(max(round(carried), -limit - 1), limit))
        carried -= q
        out.append(q)
    return out, shift
