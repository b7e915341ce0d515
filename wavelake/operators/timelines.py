"""Clips placed on a timeline, and tracks mixed: joins on frames, sums, envelopes, spines of silence.

Cues and clips meet in an equi-join on the clip; sample values meet in a sum per frame, which combines partially
before it is exchanged. Cues that place one clip at one frame are summed first, since mixing is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import div, downmix, indices, resample_hold, upmix


def placed_samples(cues: DataFrame, clips: DataFrame, cursor: int = 0) -> DataFrame:
    """cues: (clip_id, start_frame, gain); clips: (clip_id, data, mono). Rows (frame, sample, gain) from the cursor on.

    A cue in the past begins mid-clip; one that is wholly past gives no rows.
    """
    merged = cues.groupBy("clip_id", "start_frame").agg(F.sum("gain").alias("gain"))
    joined = merged.join(clips.select("clip_id", "data"), "clip_id")
    late = F.greatest(F.lit(cursor) - F.col("start_frame"), F.lit(0)).cast("int")
    live = joined.filter(F.col("start_frame") + F.size("data") > cursor) if cursor else joined
    at = live.select("start_frame", "gain", late.alias("late"), F.posexplode(F.slice("data", late + 1, F.size("data"))).alias("pos", "sample"))
    return at.select((F.col("start_frame") + F.col("late") + F.col("pos")).alias("frame"), "sample", "gain")


def mix(samples: DataFrame) -> DataFrame:
    """(frame, sample, gain) -> (frame, mixed): the sum over all that sounds at a frame."""
    return samples.groupBy("frame").agg(F.sum(F.col("sample") * F.col("gain")).alias("mixed"))


def mixer(tracks: DataFrame, keys: list[str], rate: int, channels: int, rates: tuple[int, ...], master: float = 1.0) -> DataFrame:
    """tracks: (keys, start_frame, rate, channels, gain, data) -> (keys, pos, mixed): every track brought to the mixer's
    rate and channels, placed, scaled and summed. pos counts interleaved samples; start_frame is in frames of the mixer.
    ``rates`` lists the tracks' rates; a track of another one is taken to have the mixer's."""
    if channels not in (1, 2):
        raise ValueError("a mixer has one or two channels")
    stereo = tracks.select(*keys, "start_frame", "gain", adapt(F.col("data"), F.col("rate"), F.col("channels"), rates, rate).alias("data"))
    own = stereo.select(*keys, "start_frame", "gain", (F.col("data") if channels == 2 else downmix(F.col("data"))).alias("data"))
    at = own.select(*keys, "start_frame", "gain", F.posexplode("data").alias("pos", "sample"))
    return at.groupBy(*keys, (F.col("start_frame") * channels + F.col("pos")).alias("pos")).agg((F.sum(F.col("sample") * F.col("gain")) * master).alias("mixed"))


def on_spine(mixed: DataFrame, begin: int, end: int) -> DataFrame:
    """Every frame in [begin, end), silence where nothing sounds, and whether that is so (an underrun)."""
    spine = mixed.sparkSession.range(begin, end).withColumnRenamed("id", "frame")
    return spine.join(mixed, "frame", "left").select("frame", F.coalesce("mixed", F.lit(0.0)).alias("mixed"), F.col("mixed").isNull().alias("underrun"))


def append(parts: DataFrame, keys: list[str], order: list[str], frames: str) -> DataFrame:
    """Adds start_frame: each part begins where the one before it, in its timeline, ends."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start_frame", F.coalesce(F.sum(frames).over(w), F.lit(0)))


def crossfade_cues(parts: DataFrame, keys: list[str], order: list[str], frames: str, fade: int) -> DataFrame:
    """Appended parts that overlap the one before by a fade of ``fade`` frames (no longer than either's predecessor).

    Adds fade_in and fade_out (frames, 0 at the ends) and start_frame.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = F.when(F.lead(frames).over(w).isNull(), 0).otherwise(F.least(F.lit(fade), F.col(frames)))
    return (
        parts.withColumn("fade_out", out)
        .withColumn("fade_in", F.coalesce(F.lag("fade_out").over(w), F.lit(0)))
        .withColumn("start_frame", F.coalesce(F.sum(F.col(frames) - F.col("fade_out")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )


def repeat(clips: DataFrame, loop_frames: int, horizon: int) -> DataFrame:
    """clip_id, frame, sample of each clip looped up to a horizon: cut or padded with silence to loop_frames (0: its own length)."""
    n = F.lit(loop_frames) if loop_frames else F.size("data")
    frames = clips.filter(F.size("data") > 0).select("clip_id", "data", n.alias("n"), F.explode(indices(F.lit(horizon))).alias("frame"))
    return frames.select("clip_id", "frame", F.coalesce(F.get("data", F.col("frame") % F.col("n")), F.lit(0.0)).alias("sample"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the last values of right at or before each row's ``at``: one sort per key, of both sides together."""
    tagged = right.select(*keys, at, F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values]).unionByName(left.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = tagged.select("*", *[F.last(f"__{v}", ignorenulls=True).over(w).alias(v) for v in values])
    return filled.filter("__side = 1").select(*left.columns, *values)


def envelope_lookup(rows: DataFrame, points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows with ``gain`` interpolated in points (keys, at, value): the last point at or before, and the first after."""
    p = points.select(*keys, F.col("at").alias(at), "value")
    w = Window.partitionBy(*keys).orderBy(at)
    point = F.struct(F.col(at).alias("at"), "value", F.lead(at).over(w).alias("next_at"), F.lead("value").over(w).alias("next_value"))
    first = p.groupBy(*keys).agg(F.min_by("value", at).alias("first_value"))
    found = as_of(rows, p.select(*keys, at, point.alias("__point")), keys, at, ["__point"]).join(first, keys, "left")
    get = lambda k: F.col(f"__point.{k}")
    part = (F.col(at) - get("at")) / (get("next_at") - get("at"))
    between = F.when(get("next_at").isNull(), get("value")).otherwise(get("value") + part * (get("next_value") - get("value")))
    return found.select(*rows.columns, F.when(F.col("__point").isNull(), F.col("first_value")).otherwise(between).alias("gain"))


def adapt(data: Column, rate: Column, channels: Column, rates: tuple[int, ...], target: int) -> Column:
    """A clip in the target rate, stereo: resampled and up-mixed only where its own format differs."""
    held = data
    for r in rates:
        if r != target:
            held = F.when(rate == r, resample_hold(data, r, target)).otherwise(held)
    return F.when(channels == 1, upmix(held)).otherwise(held)


def scheduled_frames(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """The frame after the last that anything sounds in."""
    sizes = clips.select("clip_id", F.size("data").alias("n"))
    return cues.join(sizes, "clip_id").agg(F.max(F.col("start_frame") + F.col("n")).alias("frames"))


def expand_runs(runs: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (first_chunk, per_chunk) to chunks (chunk_no): the run in force at each chunk, by an as-of join."""
    named = runs.withColumnRenamed("first_chunk", "chunk_no")
    return as_of(chunks, named, keys, "chunk_no", ["per_chunk"])


def sample_offsets(samples: DataFrame, keys: list[str], chunk: str, sample: str, size: str, base: Column) -> DataFrame:
    """Adds offset: a chunk's base and the sizes of its earlier samples."""
    w = Window.partitionBy(*keys, chunk).orderBy(sample).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("offset", base + F.coalesce(F.sum(size).over(w), F.lit(0)))


def frame_of_day(ts: Column, origin: str, frames_per_day: int) -> Column:
    """Whole days since an origin, as frames."""
    return div(F.timestamp_diff("DAY", F.lit(origin).cast("timestamp_ntz"), ts).cast("bigint"), F.lit(1).cast("bigint")) * frames_per_day
