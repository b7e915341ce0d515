"""Window functions in closed form of n and the length: apodizations for analysis frames."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the cosine sums a0 - a1 cos(2 pi x) + a2 cos(4 pi x) - ...
COSINE_SUMS = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
    "kaiser_bessel": (0.402, 0.498, 0.098, 0.001),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
}


def _rise(i: Column, n: int) -> Column:
    """A raised-cosine ramp: 0 at i = 0, 1 at i = n."""
    return 0.5 - 0.5 * F.cos(F.lit(math.pi) * i / n)


def window(kind: str, n: Column, length: int, p: float = 0.5, start: float = 0.0, end: float = 1.0, stddev: float = 0.25) -> Column:
    """Weight of sample n of ``length``. p, start and end are for the Tukey kinds, stddev for gauss; values out of range take the kind's usual ones."""
    last = length - 1
    x, centred = n / float(last), (n - last / 2.0) / (last / 2.0)
    if kind in COSINE_SUMS:
        terms = [a * (-1) ** k * F.cos(F.lit(2.0 * k * math.pi) * x) for k, a in enumerate(COSINE_SUMS[kind])]
        return sum(terms[1:], terms[0])
    if kind == "rectangle":
        return F.lit(1.0)
    if kind == "bartlett":
        return F.when(n <= (last // 2 if length % 2 else length // 2 - 1), 2.0 * n / last).otherwise(2.0 - 2.0 * n / last)
    if kind == "bartlett_hann":
        return 0.62 - 0.48 * F.abs(x - 0.5) - 0.38 * F.cos(F.lit(2 * math.pi) * x)
    if kind == "connes":
        return (1 - centred * centred) * (1 - centred * centred)
    if kind == "welch":
        return 1 - centred * centred
    if kind == "gauss":
        k = centred / (stddev if 0 < stddev <= 0.5 else 0.25)
        return F.exp(-0.5 * k * k)
    if kind == "triangle":
        half = (length + 1) // 2 if length % 2 else length // 2
        return F.when(n + 1 <= half, 2.0 * (n + 1) / (length + 1.0)).otherwise(2.0 * (length - n) / (length + 1.0))
    if kind == "tukey":
        if p <= 0:
            return F.lit(1.0)
        if p >= 1:
            return window("hann", n, length)
        ramp = int(p / 2 * length) - 1
        if ramp <= 0:
            return F.lit(1.0)
        return F.when(n >= length - ramp - 1, _rise(n - (length - ramp - 1) + ramp, ramp)).when(n <= ramp, _rise(n, ramp)).otherwise(1.0)
    p = 0.05 if p <= 0 else 0.95 if p >= 1 else p
    a, b = int(start * length), int(end * length)
    if kind == "partial_tukey":
        ramp = int(p / 2 * (b - a))
        out = F.when(n < a, F.lit(0.0))
        if ramp > 0:
            out = out.when(n < a + ramp, _rise(n - a + 1, ramp)).when(n < b - ramp, 1.0).when(n < b, _rise(ramp - (n - (b - ramp)), ramp))
        return out.when(n < b, 1.0).otherwise(0.0)
    if kind == "punchout_tukey":
        up, down = int(p / 2 * a), int(p / 2 * (length - b))
        out = F.when(F.lit(False), F.lit(0.0))
        if up > 0:
            out = out.when(n < up, _rise(n + 1, up)).when(n < a - up, 1.0).when(n < a, _rise(up - (n - (a - up)), up))
        out = out.when(n < a, 1.0).when(n < b, 0.0)
        if down > 0:
            out = out.when(n < b + down, _rise(n - b + 1, down)).when(n < length - down, 1.0).otherwise(_rise(down - (n - (length - down)), down))
        else:
            out = out.otherwise(1.0)
        return out
    raise ValueError(f"no window is named {kind}")


KINDS = (*COSINE_SUMS, "rectangle", "bartlett", "bartlett_hann", "connes", "welch", "gauss", "triangle", "tukey", "partial_tukey", "punchout_tukey")
