"""Converters and bitstream headers."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from wavelake.functions import samples
from wavelake.operators import resample as r
from wavelake.operators import timelines
from wavelake.sources import video as v


@settings(max_examples=40, deadline=None)
@given(kind=st.sampled_from(["hold", "linear"]), ratio=st.sampled_from([0.5, 0.75, 1.0, 1.5, 2.0, 3.0]), cuts=st.lists(st.integers(1, 50), max_size=5))
def test_blocks_give_what_the_whole_gives(kind, ratio, cuts):
    x = np.random.default_rng(1).uniform(-1, 1, (2, 200))
    whole = r.Converter(kind, 2, ratio).process(x)
    c, parts, at = r.Converter(kind, 2, ratio), [], 0
    for n in [*cuts, 200]:
        parts.append(c.process(x[:, at : at + n]))
        at = min(200, at + n)
    assert np.allclose(np.concatenate(parts, 1), whole, atol=1e-9) and whole.shape[1] == np.ceil(200 * ratio)


def test_ratio_glides_and_states_copy():
    c = r.Converter("linear", 1, 1.0)
    x = np.sin(np.arange(400) / 20)[None, :]
    c.process(x)
    c.set_ratio(2.0)
    d = c.clone()
    y = c.process(x)
    assert 550 < y.shape[1] < 650 and np.array_equal(d.process(x), y) and np.abs(np.diff(y[0][2:])).max() < 0.11
    assert c.process(x).shape[1] in (800, 801)
    with pytest.raises(ValueError, match="range"):
        c.set_ratio(1000.0)
    with pytest.raises(ValueError, match="named"):
        r.Converter("cubic", 1, 1.0)


@pytest.mark.parametrize("quality", sorted(r.QUALITIES))
@pytest.mark.parametrize("rates", [(8000, 12000), (48000, 44100), (16000, 8000), (8000, 8000)])
def test_sinc_keeps_constants_and_slow_waves(quality, rates):
    n = 600
    index, weights = r.sinc_matrix(n, *rates, quality)
    assert len(index) == n * rates[1] // rates[0]
    assert np.allclose((weights * np.ones(n)[index]).sum(1), 1.0, atol=1e-9)
    t_in, t_out = np.arange(n) / rates[0], np.arange(len(index)) / rates[1]
    wave = lambda t: np.sin(2 * np.pi * 0.05 * min(rates) * t)
    got = (weights * wave(t_in)[index]).sum(1)
    inner = slice(len(got) // 4, 3 * len(got) // 4)
    assert np.abs(got - wave(t_out))[inner].max() < 0.01


def test_sinc_of_odd_clips(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 1.0, 1.0]), (2, []), (3, None)], "k long, data array<double>")
    got = {x.k: x.data for x in r.resample_sinc(df, 1, 2, "fastest", channels=2).collect()}
    assert got[1] == pytest.approx([1.0] * 8) and got[2] == [] and got[3] is None


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, n, x):
        self.bits += format(x, f"0{n}b") if n else ""
        return self

    def ue(self, x):
        self.bits += "0" * ((x + 1).bit_length() - 1) + format(x + 1, "b")
        return self

    def bytes(self):
        s = self.bits + "1"
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def escaped(raw: bytes) -> bytes:
    out, zeros = bytearray(), 0
    for b in raw:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def test_h264():
    w = Writer().u(8, 100).u(8, 0).u(8, 40).ue(0).ue(1).ue(0).ue(0).u(1, 0).u(1, 0).ue(0).ue(2).ue(4).u(1, 0).ue(119).ue(67).u(1, 1).u(1, 1).u(1, 1).ue(0).ue(0).ue(0).ue(4).u(1, 0)
    sps = b"\x67" + escaped(w.bytes())
    got = v.units(b"\0\0\0\1" + sps + b"\0\0\1\x65" + b"abc" + b"\0\0\1\x41z", "h264")
    assert [g["type"] for g in got] == [7, 5, 1] and (got[0]["width"], got[0]["height"], got[0]["profile"]) == (1920, 1080, 100) and got[1]["keyframe"]
    assert v.unescaped(escaped(b"\0\0\1\0\0\0\3x")) == b"\0\0\1\0\0\0\3x"


def test_h265():
    w = Writer().u(4, 0).u(3, 0).u(1, 1).u(3, 0).u(5, 1).u(32, 0x60000000).u(48, 0).u(8, 93).ue(0).ue(1).ue(1280).ue(728).u(1, 1).ue(0).ue(0).ue(0).ue(4).ue(0).ue(0)
    got = v.units(b"\0\0\1" + bytes([33 << 1, 1]) + escaped(w.bytes()) + b"\0\0\1" + bytes([19 << 1, 1, 5]), "h265")
    assert (got[0]["width"], got[0]["height"], got[0]["level"]) == (1280, 720, 93) and got[1]["keyframe"]


def test_vp9_and_av1():
    frame = Writer().u(2, 2).u(2, 0).u(1, 0).u(1, 0).u(1, 1).u(1, 0).u(24, 0x498342).u(3, 1).u(1, 0).u(16, 639).u(16, 479).bytes()
    assert v.vp9_header(frame) == {"profile": 0, "keyframe": True, "shown": True, "depth": 8, "width": 640, "height": 480}
    mark = 0xC0 | 1
    packet = frame + b"xyz" + bytes([mark, len(frame), 3, mark])
    assert v.vp9_frames(packet) == [frame, b"xyz"] and v.vp9_frames(frame) == [frame]
    seq = Writer().u(3, 0).u(1, 0).u(1, 0).u(1, 0).u(1, 0).u(5, 0).u(12, 0).u(5, 8).u(1, 0).u(4, 9).u(4, 8).u(10, 639).u(9, 359).bytes()
    got = v.av1_units(b"\x12\0" + bytes([0x0A, len(seq)]) + seq)
    assert [g["type"] for g in got] == [2, 1]
    assert v.av1_sequence(got[1]["body"]) == {"profile": 0, "still": False, "level": 8, "width": 640, "height": 360}
    with pytest.raises(ValueError):
        v.vp9_header(b"\0")


@pytest.mark.parametrize("width, rows, height, first", [(300, 7, 20, 0), (128, 4, 4, 0), (640, 6, 30, 12), (5, 3, 9, 2)])
def test_detiling_equals_a_plain_loop(width, rows, height, first):
    plane = np.random.default_rng(width).integers(0, 256, 128 * height * (-(-width // 128)) - 70).astype(np.uint8).tobytes()
    at = lambda x, y: x // 128 * 128 * height + (first + y) * 128 + x % 128
    want = bytes(plane[at(x, y)] if at(x, y) < len(plane) else 0 for y in range(rows) for x in range(width))
    assert v.detiled(plane, width, rows, height, first) == want


def test_video_headers_tell_errors(spark):
    rows = [("h264", b"\0\0\0\1\x67"), ("h265", b"none"), ("vp9", b""), ("av1", b"\x0a\x01\x00"), ("other", b"x"), ("h264", None)]
    got = v.video_headers(spark.createDataFrame(rows, "codec string, data binary")).collect()
    assert len(got) == 6 and all(r.video["error"] for r in got if r.codec != "av1")


def test_a_mixer_adapts_places_and_sums(spark):
    rows = [("m", 0, 8000, 2, 0.5, [1.0, 2.0, 3.0, 4.0]), ("m", 1, 8000, 1, 2.0, [10.0]), ("m", 0, 4000, 1, 1.0, [5.0, 6.0])]
    tracks = spark.createDataFrame(rows, "mix string, start_frame long, rate int, channels int, gain double, data array<double>")
    got = {r.pos: r.mixed for r in timelines.mixer(tracks, ["mix"], 8000, 2, (8000, 4000), 0.5).collect()}
    assert got[0] == 0.5 * (0.5 + 5) and got[1] == 0.5 * (1.0 + 5) and got[2] == 0.5 * (1.5 + 20 + 5) and got[3] == 0.5 * (2 + 20 + 5)
    mono = {r.pos: r.mixed for r in timelines.mixer(tracks.limit(1), ["mix"], 8000, 1, (8000,)).collect()}
    assert mono == {0: 0.75, 1: 1.75}


def test_channels_are_resampled_apart(spark):
    data = [float(v) for i in range(10) for v in (i, 100 - i)]
    df = spark.createDataFrame([(data, data[::2], data[1::2])], "d array<double>, l array<double>, r array<double>")
    for kind in ("linear", "hold"):
        both, left, right = df.select(samples.resampled(F.col("d"), 8000, 12000, 2, kind), samples.resampled(F.col("l"), 8000, 12000, 1, kind), samples.resampled(F.col("r"), 8000, 12000, 1, kind)).first()
        assert both[::2] == left and both[1::2] == right
