"""Signal generators as DataFrames of (frame, sample): closed forms over a range of frames, so any length is parallel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.samples import NANOS, envelope_value, fade_out, nanos_per_frame
from .recurrences import recur

NOTE_PEAK, SUSTAIN = 0.4, 0.65

#: Equal temperament, A4 = 440 Hz, as tables give it (two places).
NOTES = {name: round(440.0 * 2 ** ((octave * 12 + step - 57) / 12), 2) for octave in range(2, 7) for step, name in ((s, f"{n}{octave}") for s, n in enumerate(("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")))}
RATES = (8000, 11025, 16000, 22050, 32000, 44100, 48000, 88200, 96000, 176400, 192000)

#: The nursery tune as (note, beats), and the seconds of a beat at 120 a minute.
BEAT = 0.5
TUNE = [
    ("E4", 1), ("D4", 1), ("C4", 1), ("D4", 1), ("E4", 1), ("E4", 1), ("E4", 2), ("D4", 1), ("D4", 1), ("D4", 2), ("E4", 1), ("G4", 1), ("G4", 2),
    ("E4", 1), ("D4", 1), ("C4", 1), ("D4", 1), ("E4", 1), ("E4", 1), ("E4", 1), ("E4", 1), ("D4", 1), ("D4", 1), ("E4", 1), ("D4", 1), ("C4", 4),
]
MARY = [(NOTES[note], beats * BEAT) for note, beats in TUNE]


def frames(spark: SparkSession, seconds: float, rate: int) -> DataFrame:
    """frame 0 to the truncated number of frames."""
    return spark.range(int(seconds * rate)).withColumnRenamed("id", "frame")


def _sine(freq: float, rate: int) -> Column:
    return F.sin(F.lit(2 * math.pi * freq / rate) * F.col("frame"))


def sine(spark: SparkSession, freq: float, seconds: float, rate: int) -> DataFrame:
    return frames(spark, seconds, rate).withColumn("sample", _sine(freq, rate))


def chord(spark: SparkSession, freqs: list[float], seconds: float, rate: int) -> DataFrame:
    """The mean of sines."""
    return frames(spark, seconds, rate).withColumn("sample", sum((_sine(f, rate) for f in freqs[1:]), _sine(freqs[0], rate)) / len(freqs))


def sweep(spark: SparkSession, first: float, last: float, seconds: float, rate: int) -> DataFrame:
    """Logarithmic sweep. The phase is a running sum, taken in two steps: within blocks of frames, and over blocks."""
    n = int(seconds * rate)
    step = F.lit(2 * math.pi * first / rate) * F.exp(F.lit(math.log(last / first)) * F.col("frame") / n)
    blocks = frames(spark, seconds, rate).withColumn("step", step).withColumn("block", F.floor(F.col("frame") / 65536))
    sums = blocks.groupBy("block").agg(F.sum("step").alias("total"))
    before = sums.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    phase = F.col("before") + F.sum("step").over(Window.partitionBy("block").orderBy("frame"))
    return blocks.join(before, "block").select("frame", F.sin(phase).alias("sample"))


def beep(spark: SparkSession, freq: float, seconds: float, rate: int) -> DataFrame:
    """A sine at 0.4 that fades out over its last 30 ms."""
    nanos = round(seconds * NANOS)
    fade = min(30_000_000, nanos)
    gain = envelope_value(fade_out(nanos - fade, fade), F.col("frame") * nanos_per_frame(rate))
    return frames(spark, seconds, rate).withColumn("sample", 0.4 * _sine(freq, rate) * gain)


def pluck(spark: SparkSession, freq: float, seconds: float, rate: int) -> DataFrame:
    n = int(seconds * rate)
    return frames(spark, seconds, rate).withColumn("sample", 0.4 * F.exp(-3.0 * F.col("frame") / n) * _sine(freq, rate))


def melody(spark: SparkSession, notes: list[tuple[float, float]], rate: int) -> DataFrame:
    """Notes (frequency, seconds) end to end, each with attack, decay, sustain and release; frequency 0 rests."""
    rows, at = [], 0
    for freq, seconds in notes:
        n = int(seconds * rate)
        attack, release = max(min(int(0.015 * rate), n // 4), 1), max(min(int(0.080 * rate), n // 3), 1)
        decay = max(min(int(0.060 * rate), (n - attack - release) // 2), 0)
        rows.append((at, float(freq), n, attack, decay, release))
        at += n
    spread = spark.createDataFrame(rows, "at long, freq double, n int, attack int, decay int, release int").filter("n > 0")
    one = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, attack, decay, release, n = (F.col(c) for c in ("i", "attack", "decay", "release", "n"))
    envelope = (
        F.when(i < attack, i / attack)
        .when(i < attack + decay, 1 + (i - attack) / decay * (SUSTAIN - 1))
        .when(i < n - release, SUSTAIN)
        .when(release > 1, SUSTAIN * (n - 1 - i) / (release - 1))
        .otherwise(0.0)
    )
    sound = F.when(F.col("freq") > 0, NOTE_PEAK * envelope * F.sin(F.lit(2 * math.pi) * F.col("freq") / rate * i)).otherwise(0.0)
    return one.select((F.col("at") + i).alias("frame"), sound.alias("sample"))


def white_noise(spark: SparkSession, seconds: float, rate: int, seed: int) -> DataFrame:
    """Uniform in [-1, 1): a hash of seed and frame, so every frame is reproducible by itself."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("frame")), 11) * F.lit(2.0**-53)
    return frames(spark, seconds, rate).withColumn("sample", 2 * u - 1)


def pink_noise(spark: SparkSession, seconds: float, rate: int, seed: int) -> DataFrame:
    """White noise through a seven-pole filter; the recurrence is one stream, hence one row."""
    noise = white_noise(spark, seconds, rate, seed).groupBy().agg(F.array_sort(F.collect_list(F.struct("frame", "sample"))).getField("sample").alias("data"))
    return recur(noise, "pink", "data").select(F.posexplode("data").alias("frame", "sample")).withColumn("frame", F.col("frame").cast("long"))
