"""Edge cases and properties of sample functions, processors, predictors and spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelake import registry
from wavelake.functions import samples as s
from wavelake.operators import predictors, spectral
from wavelake.operators.recurrences import KINDS, run_batch
from wavelake.sources import pcm

PROCESSORS = {
    "lowpass": {"cutoff": 1000.0, "q": 0.707, "rate": 8000}, "highpass": {"cutoff": 900.0, "q": 1.0, "rate": 8000}, "bandpass": {"cutoff": 9000.0, "q": 0.0, "rate": 8000},
    "echo": {"delay": 1_000_000, "feedback": 0.5, "wet": 0.4, "rate": 8000}, "reverb": {"room": 0.5, "damping": 0.3, "wet": 0.5, "rate": 8000}, "pink": {},
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("kind", sorted(PROCESSORS))
@settings(max_examples=15, deadline=None)
@given(cuts=st.lists(st.integers(1, 60), max_size=6))
def test_blocks_give_what_the_whole_gives(kind, cuts):
    x = np.random.default_rng(1).uniform(-1, 1, (2, 400))
    whole = KINDS[kind](2, **PROCESSORS[kind]).process(x.copy())
    p, parts, at = KINDS[kind](2, **PROCESSORS[kind]), [], 0
    for n in [*cuts, 400]:
        if at < 400:
            parts.append(p.process(x[:, at : at + n].copy()))
            at += n
    assert np.allclose(np.concatenate(parts, 1), whole, atol=1e-12)
    p.reset()
    assert np.allclose(p.process(x.copy()), whole)


def test_reverb_matches_a_plain_loop():
    rate, x = 8000, np.random.default_rng(2).uniform(-1, 1, 1500)
    combs = [[0.0] * int(ms * rate / 1000) for ms in (35.31, 36.67, 33.81, 32.25)]
    allpasses, low, out = [[0.0] * int(ms * rate / 1000) for ms in (5.10, 12.61)], [0.0] * 4, []
    for t, v in enumerate(x):
        total = 0.0
        for k, c in enumerate(combs):
            y = c[t % len(c)]
            low[k] = y * 0.7 + low[k] * 0.3
            c[t % len(c)] = v + 0.84 * low[k]
            total += y
        y = total / 4
        for a in allpasses:
            held = a[t % len(a)]
            a[t % len(a)] = y + 0.5 * held
            y = held - 0.5 * y
        out.append(0.6 * v + 0.4 * y)
    got = KINDS["reverb"](1, room=0.5, damping=0.3, wet=0.4, rate=rate).process(x[None, :])[0]
    assert np.allclose(got, out, atol=1e-12)


def test_filters_pass_what_they_should():
    t = np.arange(8000)
    low, high = np.sin(2 * np.pi * 50 * t / 8000), np.sin(2 * np.pi * 3500 * t / 8000)
    level = lambda kind, x: np.abs(KINDS[kind](1, cutoff=800.0, q=0.707, rate=8000).process(x[None, :])[0][2000:]).max()
    assert level("lowpass", low) > 0.95 and level("lowpass", high) < 0.05
    assert level("highpass", high) > 0.95 and level("highpass", low) < 0.05


def test_run_batch_keeps_nulls_tails_and_ragged_ends():
    out = run_batch(pd.Series([[1.0, 2.0, 3.0], None, [], [1.0, 1.0]]), [("lowpass", PROCESSORS["lowpass"])], channels=2, tail_frames=2)
    assert out[1] is None and len(out[0]) == 3 + 4 and out[0][-1] == 3.0 and len(out[2]) == 4 and len(out[3]) == 6


def test_soft_clip_stays_in_range_and_leaves_quiet_samples():
    x = np.random.default_rng(3).uniform(-3, 3, (3, 500))
    assert np.abs(KINDS["soft_clip"](3).process(x)).max() <= 1.0 + 1e-9
    quiet = x / 4
    assert np.array_equal(KINDS["soft_clip"](3).process(quiet), quiet)


def soft_clipped(blocks: list[list[float]]) -> list[list[float]]:
    """Sample by sample, as the definition goes: one channel, block after block."""
    bend, out = 0.0, []
    for block in blocks:
        x = [max(-2.0, min(2.0, v)) for v in block]
        for i, v in enumerate(x):
            if v * bend >= 0:
                break
            x[i] = v + bend * v * v
        whole, at, bend = list(x), 0, 0.0
        while at < len(x):
            end = at + 1
            side = x[at]
            while end < len(x) and (side == 0 or x[end] * side >= 0):
                side = side or x[end]
                end += 1
            bend, top = 0.0, max(range(at, end), key=lambda i: (abs(x[i]), -i))
            if abs(x[top]) > 1:
                bend = (abs(x[top]) - 1) / x[top] ** 2 * (1 + 2.4e-7) * (-1 if x[top] > 0 else 1)
                whole[at:end] = [v + bend * v * v for v in x[at:end]]
                if at == 0 and top >= 2:
                    step = x[0] - whole[0]
                    whole[:top] = [max(-1.0, min(1.0, v + step * (1 - i / top))) for i, v in enumerate(whole[:top])]
            at = end
        out.append(whole)
    return out


@settings(max_examples=150, deadline=None)
@given(blocks=st.lists(st.lists(st.one_of(st.floats(-3, 3), st.sampled_from([0.0, 1.0, -1.0, 1.5])), min_size=1, max_size=12), min_size=1, max_size=4))
def test_soft_clip_equals_its_definition(blocks):
    clip = KINDS["soft_clip"](2)
    for block, want in zip(blocks, soft_clipped(blocks), strict=True):
        x = np.array([block, [-v for v in block]])
        got = clip.process(x)
        assert np.allclose(got[0], want, atol=1e-12) and np.allclose(got[1], [-v for v in want], atol=1e-12) and np.abs(got).max() <= 1.0 + 1e-9


def test_levels(spark):
    row = one(spark, s.amplitude_to_decibels(F.lit(0.0)).alias("a"), s.decibels(F.lit(20.0)).alias("b"), s.soft_saturate(F.lit(-5.0)).alias("c"), s.hard_clip(F.lit(3.0)).alias("d"))
    assert row.a == -math.inf and row.b == pytest.approx(10.0) and -1 <= row.c < -0.99 and row.d == 1.0


def test_timing_rounds_as_told(spark):
    row = one(spark, s.frames_to_nanos(F.lit(1), F.lit(44100)).alias("a"), s.nanos_to_frames(F.lit(-22676), F.lit(44100)).alias("b"), s.nanos_to_frames(F.lit(11337), F.lit(44100)).alias("c"))
    assert (row.a, row.b, row.c) == (22675, -1, 0)


def test_arrays_that_are_empty_or_short(spark):
    empty = F.array().cast("array<double>")
    row = one(
        spark, s.downmix(empty).alias("a"), s.chunks(empty, 4).alias("b"), s.trim(empty, s.silent(0.1)).alias("c"), s.trim(F.array(F.lit(0.0), F.lit(0.05)), s.silent(0.1)).alias("d"),
        s.deinterleave(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 2).alias("e"), s.crossfade_loop(F.array(F.lit(1.0), F.lit(2.0)), 2).alias("f"), s.resample_hold(empty, 8000, 16000).alias("g"), s.resample_linear(empty, 8000, 16000).alias("h"),
    )
    assert row.a == [] and row.b == [] and row.c == [] and row.d == [] and row.e == [[1.0], [2.0]] and row.f == [1.0, 2.0] and row.g == [] and row.h == []


@pytest.mark.parametrize("form", ["u8", "s16", "s24", "s32"])
@pytest.mark.parametrize("big", [False, True])
def test_decoding_by_expressions_equals_numpy(spark, form, big):
    raw = bytes(range(0, 256, 7)) + b"\x80\0\0\x80\xff"
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(s.pcm_decode(F.col("raw"), form, big).alias("a"), pcm.decoded(F.col("raw"), form, big).alias("b"))
    row = df.first()
    assert row.a == pytest.approx(row.b, abs=1e-12) and len(row.a) == len(raw) // s.FORMATS[form][0]


@pytest.mark.parametrize("form", ["u8", "s16", "s24", "s32", "f32"])
def test_rows_of_samples_equal_arrays_across_pieces(spark, form):
    lengths = (0, 1, 3, pcm.PIECE - 1, pcm.PIECE, pcm.PIECE + 1, 3 * pcm.PIECE + 7)
    rows = [(7, None), *[(n, bytearray((i * 31 + i // 251) % 120 for i in range(n))) for n in lengths], (pcm.PIECE, bytearray(pcm.PIECE))]
    df = spark.createDataFrame(rows, "k long, raw binary")
    got = sorted(tuple(r) for r in pcm.long_decoded(df, "k", "raw", form).collect())
    assert got == sorted((k, i, x) for k, raw in rows if raw for i, x in enumerate(pcm.decode(bytes(raw), form).tolist()))


def test_samples_are_handed_back_in_small_batches():
    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([bytes(pcm.PIECE)] * n)], ["k", "piece", "raw"])
    sizes = [b.num_rows for b in pcm.sample_batches(iter([batch]), "u8")]
    assert sum(sizes) == n * pcm.PIECE and max(sizes) <= pcm.BATCH + pcm.PIECE


def test_decoding_queries_make_no_arrays(spark, sf_dir):
    for name in ("pcm_decode_u8", "pcm_decode_s16", "pcm_decode_s24be", "pcm_decode_s32"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan


def test_read_exact(spark):
    data = F.array(*[F.lit(float(i)) for i in range(4)])
    assert one(spark, s.read_exact(data, F.lit(1), 3).alias("a")).a == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="unexpected end"):
        one(spark, s.read_exact(data, F.lit(2), 3).alias("a"))


def test_envelope_edges(spark):
    with pytest.raises(ValueError, match="sorted"):
        s.envelope_value([(5, 1.0), (1, 0.0)], F.lit(1))
    jump = [(0, 0.0), (10, 0.5), (10, 1.0), (20, 0.0)]
    row = one(spark, *[s.envelope_value(jump, F.lit(t)).alias(f"t{t}") for t in (0, 5, 10, 15, 30)])
    assert list(row) == [0.0, 0.25, 1.0, 0.5, 0.0]
    assert s.fade_in(0) == [] and s.fade_out(0, 5)[0] == (0, 1.0)


@pytest.mark.parametrize("order", range(5))
def test_fixed_predictors_are_inverse(order):
    x = np.random.default_rng(order).integers(-1000, 1000, 50)
    r = np.concatenate([x[:order], np.diff(x, order)])
    assert np.array_equal(predictors.fixed_restore(r, order), x)
    assert np.array_equal(predictors.fixed_restore(x[:2], order), predictors.fixed_restore(x[:2], min(order, 2)))


def test_levinson_durbin_solves_the_normal_equations():
    x = np.random.default_rng(4).normal(size=400)
    r = np.array([x[k:] @ x[: len(x) - k] for k in range(5)])
    a, errors = predictors.levinson_durbin(r, 4)
    matrix = np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)])
    assert np.allclose(a, np.linalg.solve(matrix, r[1:])) and np.all(np.diff(errors) <= 1e-9)


def test_similarity_properties():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=100), rng.normal(size=80)
    assert spectral.similarity(x, 8000, x, 8000) == pytest.approx(1.0)
    assert spectral.similarity(x, 8000, -3 * x, 8000) == pytest.approx(1.0)
    assert 0 <= spectral.similarity(x, 8000, y, 16000) <= 1
    assert spectral.similarity([], 8000, x, 8000) == 0 and spectral.similarity(np.zeros(8), 8000, x, 8000) == 0
    assert spectral.next_pow2(1) == 1 and spectral.next_pow2(64) == 64 and spectral.next_pow2(65) == 128
