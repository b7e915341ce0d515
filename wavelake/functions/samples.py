"""Column functions over samples: scalars, and arrays of interleaved samples. All are built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000
SATURATION_THRESHOLD = 0.8
#: Fixed values: -60 dB, where exponential fades begin or end.
SILENCE_FLOOR = 1e-3
#: Sample format -> (bytes, decode divisor, encode factor, bias); floats have no scale.
FORMATS = {"u8": (1, 128.0, 128.0, 128), "s16": (2, 32768.0, 32767.0, 0), "s24": (3, 8388608.0, 8388607.0, 0), "s32": (4, 2147483648.0, 2147483647.0, 0), "f32": (4, None, None, 0), "f64": (8, None, None, 0)}


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero: for results that are compared."""
    return F.round(x, 6) + F.lit(0.0)


# Levels and saturation -------------------------------------------------------------------------------------------


def decibels(db: Column) -> Column:
    """Decibels to a linear factor."""
    return F.pow(F.lit(10.0), db / 20)


def amplitude_to_decibels(amplitude: Column) -> Column:
    """20 log10; minus infinity for 0 and below."""
    return F.when(amplitude <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(amplitude))


def soft_saturate(x: Column) -> Column:
    """The identity up to the threshold, from there a hyperbolic tangent into the rest of the range."""
    t = SATURATION_THRESHOLD
    over = (F.abs(x) - t) / (1 - t)
    return F.when(F.abs(x) > t, F.signum(x) * (t + (1 - t) * F.tanh(over))).otherwise(x)


def hard_clip(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def tanh_saturate(x: Column) -> Column:
    return F.tanh(x)


def apply(data: Column, f: Callable[[Column], Column]) -> Column:
    """Any Column function on every sample: saturators, gains, casts."""
    return F.transform(data, f)


# Timing ----------------------------------------------------------------------------------------------------------


def div(a: Column, b: Column) -> Column:
    """Integer division, truncating toward zero."""
    return F.call_function("div", a, b)


def frames_to_nanos(frames: Column, rate: Column) -> Column:
    """Truncating."""
    return div(frames.cast("bigint") * NANOS, rate.cast("bigint"))


def nanos_to_frames(nanos: Column, rate: Column) -> Column:
    """Rounding half away from zero."""
    scaled, half = nanos.cast("bigint") * rate, NANOS // 2
    return div(F.when(nanos >= 0, scaled + half).otherwise(scaled - half), F.lit(NANOS).cast("bigint"))


def nanos_per_frame(rate: int) -> int:
    """Whole nanoseconds; envelopes count time in these, so they drift as their definition says."""
    return NANOS // rate


# Channels --------------------------------------------------------------------------------------------------------


def frames(data: Column, channels: int) -> Column:
    """Whole frames; a ragged tail is not counted."""
    return F.floor(F.size(data) / channels).cast("int")


def indices(n: Column) -> Column:
    """0 to n - 1; empty for 0 and below (sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def downmix(data: Column) -> Column:
    """Stereo to mono by the mean of each frame."""
    return F.transform(indices(frames(data, 2)), lambda i: (F.get(data, 2 * i) + F.get(data, 2 * i + 1)) * 0.5)


def upmix(data: Column) -> Column:
    """Mono to stereo by repetition."""
    return F.flatten(F.transform(data, lambda x: F.array(x, x)))


def deinterleave(data: Column, channels: int) -> Column:
    """An array per channel; a ragged tail is dropped."""
    return F.transform(indices(F.lit(channels)), lambda c: F.transform(indices(frames(data, channels)), lambda f: F.get(data, f * channels + c)))


def interleave(planes: Column) -> Column:
    """Frames of all channels; shorter channels are continued with zeros."""
    longest = F.array_max(F.transform(planes, F.size))
    return F.flatten(F.transform(indices(longest), lambda f: F.transform(planes, lambda p: F.coalesce(F.get(p, f), F.lit(0.0)))))


def chunks(data: Column, size: int) -> Column:
    """Arrays of ``size`` samples; the last may be shorter."""
    return F.transform(indices(F.ceil(F.size(data) / size)), lambda i: F.slice(data, i * size + 1, F.lit(size)))


def read_exact(data: Column, at: Column, n: int) -> Column:
    """n samples from position ``at`` (from 0); an error if there are fewer."""
    return F.when(at + n <= F.size(data), F.slice(data, at + 1, F.lit(n))).otherwise(F.raise_error(F.lit("unexpected end of samples")).cast("array<double>"))


# Trimming --------------------------------------------------------------------------------------------------------


def trim_all(data: Column, drop: Callable[[Column], Column]) -> Column:
    """Without the samples that ``drop`` holds for, wherever they are (this can shift channels)."""
    return F.filter(data, lambda x: ~drop(x))


def trim(data: Column, drop: Callable[[Column], Column], mode: str = "both") -> Column:
    """Without the leading ('start'), trailing ('end') or both runs of samples that ``drop`` holds for."""
    n = F.size(data)
    kept = F.filter(F.transform(data, lambda x, i: F.when(~drop(x), i)), lambda i: i.isNotNull())
    first = F.lit(0) if mode == "end" else F.coalesce(F.try_element_at(kept, F.lit(1)), n)
    last = n - 1 if mode == "start" else F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(-1))
    return F.slice(data, first + 1, F.greatest(last - first + 1, F.lit(0)))


def silent(threshold: float) -> Callable[[Column], Column]:
    return lambda x: F.abs(x) <= threshold


# Envelopes -------------------------------------------------------------------------------------------------------


def envelope_value(points: list[tuple[int, float]], at: Column, exponential: bool = False) -> Column:
    """Gain at a time in nanoseconds: held outside the points, linear or exponential between them.

    A span of zero gives its later value, and an exponential span with an end of 0 or below is linear. points are
    sorted by time; the expression is a chain of CASE branches, fit for hand-made envelopes.
    """
    if any(b[0] < a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("the envelope's points are not sorted by time")
    out = F.when(at <= points[0][0], F.lit(float(points[0][1])))
    for (t0, v0), (t1, v1) in zip(points, points[1:], strict=False):
        if t1 == t0:
            continue
        part = (at - t0) / float(t1 - t0)
        value = v0 * F.pow(F.lit(v1 / v0), part) if exponential and v0 > 0 and v1 > 0 else v0 + part * float(v1 - v0)
        out = out.when(at < t1, value)
    return out.otherwise(F.lit(float(points[-1][1])))


def apply_gain(data: Column, gain: Callable[[Column], Column], rate: int, channels: int = 1, elapsed: int = 0) -> Column:
    """Every frame times gain(nanoseconds since the cue began)."""
    step = nanos_per_frame(rate)
    return F.transform(data, lambda x, i: x * gain(F.lit(elapsed) + F.floor(i / channels) * F.lit(step)))


def apply_envelope(data: Column, points: list[tuple[int, float]], rate: int, channels: int = 1, elapsed: int = 0, exponential: bool = False) -> Column:
    return apply_gain(data, lambda at: envelope_value(points, at, exponential), rate, channels, elapsed) if points else data


def fade_in(duration: int, exponential: bool = False) -> list[tuple[int, float]]:
    return [(0, SILENCE_FLOOR if exponential else 0.0), (duration, 1.0)] if duration > 0 else []


def fade_out(at: int, duration: int, exponential: bool = False) -> list[tuple[int, float]]:
    low = SILENCE_FLOOR if exponential else 0.0
    if duration <= 0:
        return []
    return [(0, 1.0), (duration, low)] if at <= 0 else [(0, 1.0), (at, 1.0), (at + duration, low)]


def crossfade_loop(data: Column, fade_frames: int, channels: int = 1) -> Column:
    """The tail folded into the head by equal-power weights, so that the rest loops without a click; too short data as they are."""
    n = fade_frames * channels
    cut = F.size(data) - n
    phase = lambda i: F.lit(0.5 * math.pi) * F.floor(i / channels) / fade_frames
    mixed = lambda x, i: F.when(i < n, F.sin(phase(i)) * x + F.cos(phase(i)) * F.get(data, cut + i)).otherwise(x)
    return F.when(F.size(data) < 2 * n, data).otherwise(F.transform(F.slice(data, F.lit(1), F.greatest(cut, F.lit(0))), mixed)) if n > 0 else data


# Resampling at fixed positions -----------------------------------------------------------------------------------


def resample_hold(data: Column, rate_in: int, rate_out: int) -> Column:
    """Zero-order hold, mono: output k repeats the input frame before position k * in / out (the converters lag one frame)."""
    n = F.floor(F.size(data) * rate_out / rate_in) + 1
    at = lambda k: F.floor(k.cast("bigint") * rate_in / rate_out).cast("int")
    return F.when(F.size(data) > 0, F.transform(indices(n), lambda k: F.get(data, F.greatest(at(k) - 1, F.lit(0))))).otherwise(data)


def resample_linear(data: Column, rate_in: int, rate_out: int) -> Column:
    """Linear interpolation, mono, with the converters' lag of one frame."""
    n = F.ceil(F.size(data) * rate_out / rate_in)
    at = lambda k: F.floor(k.cast("bigint") * rate_in / rate_out).cast("int")
    part = lambda k: ((k.cast("bigint") * rate_in) % rate_out) / float(rate_out)
    before = lambda k: F.get(data, F.greatest(at(k) - 1, F.lit(0)))
    return F.transform(indices(n), lambda k: before(k) + part(k) * (F.get(data, at(k)) - before(k)))


def resampled(data: Column, rate_in: int, rate_out: int, channels: int = 1, kind: str = "linear") -> Column:
    """Interleaved frames of any number of channels, each by resample_linear or resample_hold; a ragged tail is dropped."""
    one = {"linear": resample_linear, "hold": resample_hold}[kind]
    return one(data, rate_in, rate_out) if channels == 1 else interleave(F.transform(deinterleave(data, channels), lambda c: one(c, rate_in, rate_out)))


# PCM bytes -------------------------------------------------------------------------------------------------------


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression is evaluated as often as it is written."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pcm_decode(raw: Column, form: str, big: bool = False) -> Column:
    """Samples in [-1, 1] of integer PCM bytes, by expressions only; an incomplete last sample is dropped.

    For many bytes sources.pcm.decoded, which reads them in NumPy, is some fifty times as fast.
    """
    width, scale, _, bias = FORMATS[form]
    if scale is None:
        raise ValueError("floats are decoded by sources.pcm")
    top = 1 << (8 * width)
    order = range(width) if big else range(width - 1, -1, -1)
    number = lambda h: F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in order]), 16, 10).cast("bigint")
    signed = lambda u: u - bias if bias else F.when(u >= top // 2, u - top).otherwise(u)
    value = lambda i: bind(bind(F.hex(F.substring(raw, i * width + 1, F.lit(width))), number), signed)
    return F.transform(indices(F.floor(F.octet_length(raw) / width)), lambda i: value(i).cast("double") / scale)


def pcm_integer(x: Column, form: str) -> Column:
    """What a sample is stored as: clamped, scaled (by one step less than decoding divides by) and truncated toward zero."""
    _, _, scale, bias = FORMATS[form]
    scaled = hard_clip(x) * scale
    return F.least(scaled + bias, F.lit(255.0)).cast("bigint") if bias else scaled.cast("bigint")


def pcm_encode(data: Column, form: str, big: bool = False) -> Column:
    """Integer PCM bytes of samples."""
    width = FORMATS[form][0]

    def digits(x: Column) -> Column:
        whole = F.lpad(F.substring(F.hex(pcm_integer(x, form)), -2 * width, 2 * width), 2 * width, "0")
        pairs = [F.substring(whole, 2 * k + 1, 2) for k in range(width)]
        return F.concat(*(pairs if big else pairs[::-1]))

    return F.unhex(F.array_join(F.transform(data, digits), ""))
