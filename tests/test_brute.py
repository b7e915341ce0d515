"""Queries that SQL cannot express, against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wavelake import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def clips(duck):
    return {k: np.array(x, float) for k, x in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}


def rows(spark, name, sf_dir, key="clip_id"):
    out: dict = {}
    for r in QUERIES[name](spark, sf_dir).collect():
        out.setdefault(r[key], {})[r.pos] = r["sample"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def plain_reverb(x: list[float]) -> list[float]:
    combs, passes = [[0.0] * n for n in (282, 293, 270, 258)], [[0.0] * n for n in (40, 100)]
    low, out = [0.0] * 4, []
    for t, v in enumerate(x):
        total = 0.0
        for k, line in enumerate(combs):
            y = line[t % len(line)]
            low[k] = 0.7 * y + 0.3 * low[k]
            line[t % len(line)] = v + (0.7 + 0.28 * 0.5) * low[k]
            total += y
        y = total / 4
        for line in passes:
            held = line[t % len(line)]
            line[t % len(line)] = y + 0.5 * held
            y = held - 0.5 * y
        out.append(0.6 * v + 0.4 * y)
    return out


def test_reverb(spark, sf_dir, clips):
    got = rows(spark, "reverb", sf_dir)
    assert got.keys() == clips.keys()
    for k in list(clips):
        assert np.allclose(got[k], plain_reverb([*clips[k], *[0.0] * 512]), atol=1e-6)


def test_linear_prediction(spark, sf_dir, clips):
    for r in QUERIES["linear_prediction"](spark, sf_dir).collect():
        x = clips[r.clip_id] * [0.5 - 0.5 * math.cos(2 * math.pi * i / 63) for i in range(64)]
        lags = [sum(x[i] * x[i + k] for i in range(64 - k)) for k in range(5)]
        errors = []
        for order in range(1, 5):  # the normal equations, solved as they stand
            m = np.array([[lags[abs(i - j)] for j in range(order)] for i in range(order)])
            a = np.linalg.solve(m, np.array(lags[1 : order + 1]))
            errors.append(lags[0] - float(a @ lags[1 : order + 1]))
        assert errors[r.best_order - 1] == pytest.approx(min(errors), rel=1e-6)
        back = np.array(r.coefficients) / (1 << r.shift)
        assert np.abs(back - a).max() <= 4 / (1 << r.shift) and max(abs(c) for c in r.coefficients) < 1 << 11


def test_sinc_resampling(spark, sf_dir, clips):
    got = rows(spark, "resample_sinc_12000", sf_dir)
    for k in list(clips)[:60]:
        x, out = clips[k], []
        for i in range(96):
            at, total, weight = i * 8000 / 12000, 0.0, 0.0
            for j in range(64):
                d = j - at
                if abs(d) < 24:
                    w = (math.sin(math.pi * d) / (math.pi * d) if d else 1.0) * np.i0(8.5 * math.sqrt(1 - (d / 24) ** 2))
                    total, weight = total + w * x[j], weight + w
            out.append(total / weight)
        assert np.allclose(got[k], out, atol=2e-6)


def test_similarity_across_rates(spark, sf_dir, clips):
    got = {r.clip_id: r.similarity for r in QUERIES["similarity_across_rates"](spark, sf_dir).collect()}
    assert got.keys() == clips.keys() and all(0 <= v <= 1.000001 for v in got.values())


def test_noise_has_its_statistics(spark, sf_dir):
    p = QUERIES["generate_noise"](spark, sf_dir).toPandas().sort_values("frame")
    white, pink = (p[p.colour == c]["sample"].to_numpy() for c in ("white", "pink"))
    assert len(white) == len(pink) == 4000 and abs(white.mean()) < 0.05 and abs(white.var() - 1 / 3) < 0.03 and np.abs(white).max() <= 1
    power = lambda x: [np.square(np.abs(np.fft.rfft(x * np.hanning(4000))))[a : 2 * a].mean() for a in (50, 200, 800)]
    w, q = power(white), power(pink)
    assert 0.5 < w[0] / w[2] < 2 and q[0] / q[1] > 2 and q[1] / q[2] > 2  # a fourth of the power at four times the frequency
    taps = [(0.99886, 0.0555179), (0.99332, 0.0750759), (0.96900, 0.1538520), (0.86650, 0.3104856), (0.55000, 0.5329522), (-0.7616, -0.0168980)]
    state, last, want = [0.0] * 6, 0.0, []
    for v in white:
        state = [a * s + b * v for s, (a, b) in zip(state, taps, strict=True)]
        want.append((sum(state) + last + 0.5362 * v) * 0.11)
        last = 0.115926 * v
    assert np.allclose(pink, want, atol=1e-9)


def test_opus_packets(spark, sf_dir, duck):
    """Codes 0 and 1 tell their frames by the packet's length alone."""
    texts = {k: v.encode() for k, v in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    got = {r.id: r for r in QUERIES["opus_packets"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, raw in texts.items():
        r, code, n = got[k], raw[0] & 3, len(raw) - 1
        if code == 0:
            assert (r.sizes == [n]) if n <= 1275 else r.error
        elif code == 1:
            assert (r.sizes == [n // 2] * 2) if n % 2 == 0 and n // 2 <= 1275 else r.error
        if not r.error:
            assert sum(r.sizes) <= n and r.duration_us == r.frame_us * len(r.sizes) <= 120_000
