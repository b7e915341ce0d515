"""Frame headers in a few bytes, by built-in expressions: bit fields and small literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.mpeg import ADTS_RATES, BIT_RATES, SAMPLE_RATES


def byte(raw: Column, i: int) -> Column:
    """The i-th byte, from 0, as a number; null beyond the end."""
    digits = F.hex(F.substring(raw, i + 1, 1))
    return F.when(digits != "", F.conv(digits, 16, 10).cast("int"))


def bits(b: Column, shift: int, width: int) -> Column:
    return F.shiftright(b, shift).bitwiseAND(F.lit((1 << width) - 1))


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def opus_toc(raw: Column) -> Column:
    """mode, bandwidth, frame_us, channels, code, frames of an Opus packet; null for an empty one."""
    first = byte(raw, 0)
    config, code = bits(first, 3, 5), bits(first, 0, 2)
    modes = ("silk",) * 12 + ("hybrid",) * 4 + ("celt",) * 16
    bands = ("narrow",) * 4 + ("medium",) * 4 + ("wide",) * 4 + ("superwide",) * 2 + ("full",) * 2 + ("narrow",) * 4 + ("wide",) * 4 + ("superwide",) * 4 + ("full",) * 4
    durations = (10000, 20000, 40000, 60000) * 3 + (10000, 20000) * 2 + (2500, 5000, 10000, 20000) * 4
    frames = F.when(code == 0, 1).when(code < 3, 2).otherwise(bits(byte(raw, 1), 0, 6))
    fields = F.struct(
        _pick(modes, config).alias("mode"), _pick(bands, config).alias("bandwidth"), _pick(durations, config).alias("frame_us"), (bits(first, 2, 1) + 1).alias("channels"), code.alias("code"), frames.alias("frames")
    )
    return F.when(first.isNotNull(), fields)


def mpeg_frame(raw: Column) -> Column:
    """version, layer, bit_rate, sample_rate, channels, samples of an MPEG audio frame header; null if it is none."""
    b0, b1, b2, b3 = (byte(raw, i) for i in range(4))
    version, layer, rate, freq = bits(b1, 3, 2), bits(b1, 1, 2), bits(b2, 4, 4), bits(b2, 2, 2)
    valid = (b0 == 255) & (bits(b1, 5, 3) == 7) & (version != 1) & (layer != 0) & (rate != 0) & (rate != 15) & (freq != 3) & b3.isNotNull()
    table = lambda k: _pick(BIT_RATES[k], rate - 1)
    first = F.when(layer == 3, table("1-1")).when(layer == 2, table("1-2")).otherwise(table("1-3"))
    kbit = F.when(version == 3, first).when(layer == 3, table("2-1")).otherwise(table("2-2"))
    hz = F.when(version == 3, _pick(SAMPLE_RATES["1"], freq)).when(version == 2, _pick(SAMPLE_RATES["2"], freq)).otherwise(_pick(SAMPLE_RATES["2.5"], freq))
    samples = F.when(layer == 3, 384).when((layer == 2) | (version == 3), 1152).otherwise(576)
    name = F.when(version == 3, "1").when(version == 2, "2").otherwise("2.5")
    fields = F.struct(
        name.alias("version"), (4 - layer).alias("layer"), (kbit * 1000).alias("bit_rate"), hz.alias("sample_rate"), F.when(bits(b3, 6, 2) == 3, 1).otherwise(2).alias("channels"), samples.alias("samples")
    )
    return F.when(valid, fields)


def adts_frame(raw: Column) -> Column:
    """mpeg, profile, sample_rate, channels, header, size of an ADTS header; null if it is none."""
    b = [byte(raw, i) for i in range(7)]
    code = bits(b[2], 2, 4)
    size = bits(b[3], 0, 2) * 2048 + b[4] * 8 + bits(b[5], 5, 3)
    head = F.when(bits(b[1], 0, 1) == 1, 7).otherwise(9)
    valid = (b[0] == 255) & (b[1].bitwiseAND(F.lit(0xF6)) == 0xF0) & (code < len(ADTS_RATES)) & (size >= head) & b[6].isNotNull()
    fields = F.struct(
        F.when(bits(b[1], 3, 1) == 1, 2).otherwise(4).alias("mpeg"), bits(b[2], 6, 2).alias("profile"), _pick(ADTS_RATES, code).alias("sample_rate"),
        (bits(b[2], 0, 1) * 4 + bits(b[3], 6, 2)).alias("channels"), head.alias("header"), size.alias("size"),
    )
    return F.when(valid, fields)
