"""Queries over sample values: levels, saturation, envelopes, channels, trimming, PCM, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as s
from ..operators.resample import resample_sinc, resample_streaming
from ..registry import query
from ..sources import pcm
from .views import BLOCK, BLOCKS_SQL, RATE, clips, clips_sql, long, long_sql, pcm_bytes, table

STEP = s.nanos_per_frame(RATE)
MS = 1_000_000


def _mapped(body: str, gain: float = 1.0) -> str:
    return f"WITH {clips_sql(gain)}, out AS (SELECT clip_id, list_transform(data, lambda x: {body}) AS data FROM clips) {long_sql('clip_id')}"


def _each(name: str, f, sql: str, gain: float = 1.0) -> None:  # noqa: ANN001
    query(_mapped(sql, gain), name)(lambda spark, d: long(clips(spark, d, gain).select("clip_id", s.apply(F.col("data"), f).alias("data")), "clip_id"))


_each("gain_const", lambda x: x * 0.5, "x * 0.5::DOUBLE")
_each("gain_db", lambda x: x * s.decibels(F.lit(-6.0)), "x * pow(10.0::DOUBLE, -6.0::DOUBLE / 20)")
_each("saturate_soft", s.soft_saturate, "CASE WHEN x > 0.8 THEN 0.8::DOUBLE + 0.2::DOUBLE * tanh((x - 0.8::DOUBLE) / 0.2::DOUBLE) WHEN x < -0.8 THEN -0.8::DOUBLE + 0.2::DOUBLE * tanh((x + 0.8::DOUBLE) / 0.2::DOUBLE) ELSE x END", 2.5)
_each("saturate_hard", s.hard_clip, "greatest(least(x, 1.0::DOUBLE), -1.0::DOUBLE)", 2.5)
_each("saturate_tanh", s.tanh_saturate, "tanh(x)", 2.5)
_each("saturate_user", lambda x: x / (1 + F.abs(x)), "x / (1 + abs(x))", 2.5)
_each("trim_mask", lambda x: F.when(s.silent(0.05)(x), 0.0).otherwise(x), "CASE WHEN abs(x) <= 0.05 THEN 0.0::DOUBLE ELSE x END")


@query(f"WITH {clips_sql()} SELECT clip_id, round(20 * log10(greatest(list_max(list_transform(data, lambda x: abs(x))), 1e-300)), 6) + 0.0::DOUBLE AS peak_db, len(data) * 1000000000 // {RATE} AS nanos, '-inf' AS silence_db FROM clips")
def peak_decibels(spark: SparkSession, d: str) -> DataFrame:
    peak = F.array_max(F.transform("data", lambda x: F.abs(x)))
    return clips(spark, d).select(
        "clip_id", s.r6(s.amplitude_to_decibels(peak)).alias("peak_db"), s.frames_to_nanos(F.size("data"), F.lit(RATE)).alias("nanos"),
        F.when(s.amplitude_to_decibels(F.lit(0.0)) == float("-inf"), "-inf").alias("silence_db"),
    )


@query("SELECT o_orderkey, o_orderkey * 1000000000 // 44100 AS nanos, (o_orderkey * 12345 * 48000 + 500000000) // 1000000000 AS frames, -((o_orderkey * 12345 * 48000 + 500000000) // 1000000000) AS frames_back FROM orders")
def frame_timing(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    back = s.nanos_to_frames(-key * 12345, F.lit(48000))
    return table(spark, d, "orders").select("o_orderkey", s.frames_to_nanos(key, F.lit(44100)).alias("nanos"), s.nanos_to_frames(key * 12345, F.lit(48000)).alias("frames"), back.alias("frames_back"))


# Envelopes -------------------------------------------------------------------------------------------------------

ENVELOPE = [(1 * MS, 0.2), (3 * MS, 1.0), (5 * MS, 1.0), (7 * MS, 0.001)]


def _envelope_sql(points: list[tuple[int, float]], exponential: bool, at: str) -> str:
    out = f"CASE WHEN {at} <= {points[0][0]} THEN {points[0][1]}::DOUBLE"
    for (t0, v0), (t1, v1) in zip(points, points[1:], strict=False):
        part = f"(({at} - {t0}) / {float(t1 - t0)}::DOUBLE)"
        value = f"{v0}::DOUBLE * pow({v1 / v0!r}::DOUBLE, {part})" if exponential and v0 > 0 and v1 > 0 else f"{v0}::DOUBLE + {part} * {float(v1 - v0)!r}::DOUBLE"
        out += f" WHEN {at} < {t1} THEN {value}"
    return f"{out} ELSE {points[-1][1]}::DOUBLE END"


def _enveloped(name: str, points: list[tuple[int, float]], exponential: bool) -> None:
    gain = _envelope_sql(points, exponential, f"((i - 1) * {STEP})")
    sql = f"WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(data, lambda x, i: x * {gain}) AS data FROM clips) {long_sql('clip_id')}"
    query(sql, name)(lambda spark, d: long(clips(spark, d).select("clip_id", s.apply_envelope(F.col("data"), points, RATE, exponential=exponential).alias("data")), "clip_id"))


_enveloped("envelope_linear", ENVELOPE, False)
_enveloped("envelope_exponential", ENVELOPE, True)
_enveloped("fade_in", s.fade_in(4 * MS), False)
_enveloped("fade_out", s.fade_out(3 * MS, 4 * MS), False)
_enveloped("fade_in_log", s.fade_in(4 * MS, True), True)
_enveloped("fade_out_log", s.fade_out(3 * MS, 4 * MS, True), True)


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(data, lambda x, i: x * (0.5::DOUBLE + 0.5::DOUBLE * cos(2e-6::DOUBLE * (i - 1) * {STEP}))) AS data FROM clips) {long_sql('clip_id')}")
def custom_gain(spark: SparkSession, d: str) -> DataFrame:
    wobble = lambda at: 0.5 + 0.5 * F.cos(F.lit(2e-6) * at)
    return long(clips(spark, d).select("clip_id", s.apply_gain(F.col("data"), wobble, RATE).alias("data")), "clip_id")


@query(
    f"""WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(data[1:len(data) - 16], lambda x, i: CASE WHEN i <= 16
  THEN sin(0.5::DOUBLE * pi() * (i - 1) / 16) * x + cos(0.5::DOUBLE * pi() * (i - 1) / 16) * data[len(data) - 16 + i] ELSE x END) AS data FROM clips) {long_sql("clip_id")}"""
)
def crossfade_loop(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", s.crossfade_loop(F.col("data"), 16).alias("data")), "clip_id")


# Channels and chunks ---------------------------------------------------------------------------------------------


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(range(1, len(data) // 2 + 1), lambda i: (data[2 * i - 1] + data[2 * i]) * 0.5::DOUBLE) AS data FROM clips) {long_sql('clip_id')}")
def downmix(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", s.downmix(F.col("data")).alias("data")), "clip_id")


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(range(0, 2 * len(data)), lambda i: data[i // 2 + 1]) AS data FROM clips) {long_sql('clip_id')}")
def upmix(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", s.upmix(F.col("data")).alias("data")), "clip_id")


@query(f"WITH {clips_sql()} SELECT clip_id, ((i - 1) % 3)::INT AS ch, ((i - 1) // 3)::INT AS frame, round(data[i], 6) + 0.0::DOUBLE AS sample FROM (SELECT clip_id, data, unnest(range(1, len(data) // 3 * 3 + 1)) AS i FROM clips)")
def deinterleave(spark: SparkSession, d: str) -> DataFrame:
    planes = clips(spark, d).select("clip_id", F.posexplode(s.deinterleave(F.col("data"), 3)).alias("ch", "plane"))
    return planes.select("clip_id", "ch", F.posexplode("plane").alias("frame", "x")).select("clip_id", "ch", "frame", s.r6(F.col("x")).alias("sample"))


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(range(0, 2 * len(data)), lambda i: CASE WHEN i % 2 = 0 THEN data[i // 2 + 1] WHEN i // 2 < 20 THEN -data[i // 2 + 1] ELSE 0.0::DOUBLE END) AS data FROM clips) {long_sql('clip_id')}")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    """The second channel has 20 samples and is continued with zeros."""
    second = F.transform(F.slice("data", 1, 20), lambda x: -x)
    return long(clips(spark, d).select("clip_id", s.interleave(F.array("data", second)).alias("data")), "clip_id")


@query(f"WITH {clips_sql()} SELECT clip_id, c::INT AS chunk, len(data[c * 24 + 1:c * 24 + 24])::INT AS n, (c = 2) AS last, round(list_sum(data[c * 24 + 1:c * 24 + 24]), 6) + 0.0::DOUBLE AS total FROM clips, range(3) r(c)")
def chunk_24(spark: SparkSession, d: str) -> DataFrame:
    cut = clips(spark, d).select("clip_id", F.posexplode(s.chunks(F.col("data"), 24)).alias("chunk", "part"), F.size("data").alias("size"))
    total = F.aggregate("part", F.lit(0.0), lambda a, x: a + x)
    return cut.select("clip_id", "chunk", F.size("part").alias("n"), ((F.col("chunk") + 1) * 24 >= F.col("size")).alias("last"), s.r6(total).alias("total"))


def _trimmed(mode: str) -> None:
    first = "1" if mode == "end" else "coalesce(list_min(keep), len(data) + 1)"
    last = "len(data)" if mode == "start" else "coalesce(list_max(keep), 0)"
    sql = f"""WITH {clips_sql()}, kept AS (SELECT clip_id, data, list_filter(range(1, len(data) + 1), lambda i: abs(data[i]) > 0.1) AS keep FROM clips),
out AS (SELECT clip_id, data[{first}:{last}] AS data FROM kept) {long_sql("clip_id")}"""
    query(sql, f"trim_silence_{mode}")(lambda spark, d: long(clips(spark, d).select("clip_id", s.trim(F.col("data"), s.silent(0.1), mode).alias("data")), "clip_id"))


for _mode in ("start", "end", "both"):
    _trimmed(_mode)


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, list_filter(data, lambda x: abs(x) > 0.1) AS data FROM clips) {long_sql('clip_id')}")
def trim_all(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", s.trim_all(F.col("data"), s.silent(0.1)).alias("data")), "clip_id")


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, data[11:30] AS data FROM clips) {long_sql('clip_id')}")
def seek_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Seek to frame 10 (clamped to the clip) and read 20 frames."""
    at = F.least(F.greatest(F.lit(10), F.lit(0)), F.size("data"))
    return long(clips(spark, d).select("clip_id", F.slice("data", at + 1, F.lit(20)).alias("data")), "clip_id")


# PCM -------------------------------------------------------------------------------------------------------------


def _six_places(x: Column) -> Column:
    """round(x, 6) without decimals: a million times a whole number over a power of two is exact, and so are its halves."""
    return F.floor(F.abs(x) * 1e6 + 0.5) * F.signum(x) / 1e6 + F.lit(0.0)


def _decoded(form: str, big: bool) -> None:
    width, scale, _, bias = s.FORMATS[form]
    order = range(width) if big else range(width - 1, -1, -1)
    digits = " || ".join(f"h[(i * {width} + {k}) * 2 + 1:(i * {width} + {k}) * 2 + 2]" for k in order)
    u = f"('0x' || {digits})::BIGINT"
    top = 1 << (8 * width)
    value = f"({u} - {bias})" if bias else f"(CASE WHEN {u} >= {top // 2} THEN {u} - {top} ELSE {u} END)"
    sql = f"""WITH {BLOCKS_SQL}, spots AS (SELECT id, block, h, unnest(range(0, len(h) // {2 * width})) AS i FROM blocks)
SELECT id, (block * {BLOCK // width} + i)::INT AS pos, round({value} / {scale}::DOUBLE, 6) + 0.0::DOUBLE AS sample FROM spots"""
    name = f"pcm_decode_{form}" + ("be" if big else "")
    query(sql, name)(lambda spark, d: pcm.long_decoded(pcm_bytes(spark, d), "id", "raw", form, big).withColumn("sample", _six_places(F.col("sample"))))


def _encoded(form: str, big: bool) -> None:
    width, _, scale, bias = s.FORMATS[form]
    clamped = f"greatest(least(x, 1.0::DOUBLE), -1.0::DOUBLE) * {scale}::DOUBLE"
    whole = f"trunc(least({clamped} + {bias}, 255))" if bias else f"trunc({clamped})"
    top = 1 << (8 * width)
    hexed = f"lpad(upper(to_hex(((({whole})::BIGINT + {top}) % {top}))), {2 * width}, '0')"
    pairs = range(width) if big else range(width - 1, -1, -1)
    swapped = " || ".join(f"h[{2 * k + 1}:{2 * k + 2}]" for k in pairs)
    sql = f"""WITH {clips_sql(2.5)}, one AS (SELECT clip_id, i, {hexed} AS h FROM (SELECT clip_id, unnest(range(1, len(data) + 1)) AS i, unnest(data) AS x FROM clips))
SELECT clip_id, string_agg({swapped}, '' ORDER BY i) AS bytes FROM one GROUP BY clip_id"""
    name = f"pcm_encode_{form}" + ("be" if big else "")
    query(sql, name)(lambda spark, d: clips(spark, d, 2.5).select("clip_id", F.hex(s.pcm_encode(F.col("data"), form, big)).alias("bytes")))


for _form in ("u8", "s16", "s24", "s32"):
    for _big in (False, True) if _form != "u8" else (False,):
        _decoded(_form, _big)
        _encoded(_form, _big)


@query(f"WITH {clips_sql(2.5)}, out AS (SELECT clip_id, list_transform(data, lambda x: trunc(greatest(least(x, 1.0::DOUBLE), -1.0::DOUBLE) * 32767::DOUBLE) / 32768::DOUBLE) AS data FROM clips) {long_sql('clip_id')}")
def pcm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Encoding and decoding are not inverse: they scale by different steps."""
    raw = s.pcm_encode(F.col("data"), "s16")
    return long(clips(spark, d, 2.5).select("clip_id", raw.alias("raw")).select("clip_id", s.pcm_decode(F.col("raw"), "s16").alias("data")), "clip_id")


# Resampling ------------------------------------------------------------------------------------------------------


def _held(rate_out: int) -> None:
    sql = f"""WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(range(0, len(data) * {rate_out} // {RATE} + 1), lambda k: data[greatest(k * {RATE} // {rate_out}, 1)]) AS data FROM clips) {long_sql("clip_id")}"""
    query(sql, f"resample_hold_{rate_out}")(lambda spark, d: long(clips(spark, d).select("clip_id", s.resample_hold(F.col("data"), RATE, rate_out).alias("data")), "clip_id"))


def _interpolated(rate_out: int) -> None:
    at, part = f"(k * {RATE} // {rate_out})", f"((k * {RATE}) % {rate_out} / {rate_out}::DOUBLE)"
    sql = f"""WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(range(0, ceil(len(data) * {rate_out} / {RATE}::DOUBLE)::BIGINT), lambda k: data[greatest({at}, 1)] + {part} * (data[{at} + 1] - data[greatest({at}, 1)])) AS data FROM clips) {long_sql("clip_id")}"""
    query(sql, f"resample_linear_{rate_out}")(lambda spark, d: long(clips(spark, d).select("clip_id", s.resample_linear(F.col("data"), RATE, rate_out).alias("data")), "clip_id"))


for _rate in (16000, 12000, 5000):
    _held(_rate)
    _interpolated(_rate)


# Converters with state ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {clips_sql()}, out AS (SELECT clip_id, list_transform(range(0, 96), lambda k: data[greatest(k * 2 // 3, 1)] + (k * 2 % 3 / 3::DOUBLE) * (data[k * 2 // 3 + 1] - data[greatest(k * 2 // 3, 1)])) AS data FROM clips) {long_sql("clip_id")}"""
)
def resample_converter(spark: SparkSession, d: str) -> DataFrame:
    """The streaming converter gives what the closed form does."""
    return long(resample_streaming(clips(spark, d).select("clip_id", "data"), "linear", 1.5), "clip_id")


@query()
def resample_sinc_12000(spark: SparkSession, d: str) -> DataFrame:
    return long(resample_sinc(clips(spark, d).select("clip_id", "data"), RATE, 12000), "clip_id")
