"""Queries over timelines and mixers. Cues: one per order, placing clip o_orderkey modulo the number of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.samples import r6, soft_saturate
from ..operators import timelines as t
from ..registry import query
from .views import clips, clips_sql, table

CUES_SQL = "cues AS (SELECT o_orderkey AS cue_id, o_orderkey % (SELECT count(*) FROM embeddings) AS clip_id, 16 * date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS start_frame, 0.25::DOUBLE + 0.25::DOUBLE * (o_orderkey % 4) AS gain FROM orders)"
_PLACED = f"{CUES_SQL}, {clips_sql()}, placed AS (SELECT start_frame + i - 1 AS frame, data[i] * gain AS v FROM (SELECT start_frame, gain, data, unnest(range(1, len(data) + 1)) AS i FROM cues JOIN clips USING (clip_id)))"
_SOFT = "CASE WHEN x > 0.8 THEN 0.8::DOUBLE + 0.2::DOUBLE * tanh((x - 0.8::DOUBLE) / 0.2::DOUBLE) WHEN x < -0.8 THEN -0.8::DOUBLE + 0.2::DOUBLE * tanh((x + 0.8::DOUBLE) / 0.2::DOUBLE) ELSE x END"


def cues(spark: SparkSession, d: str) -> DataFrame:
    key, n_clips = F.col("o_orderkey"), table(spark, d, "embeddings").count()
    return table(spark, d, "orders").select(
        key.alias("cue_id"), (key % n_clips).alias("clip_id"), t.frame_of_day(F.col("o_orderdate"), "1995-01-01", 16).alias("start_frame"), (0.25 + 0.25 * (key % 4)).alias("gain")
    )


@query(f"WITH {_PLACED}, m AS (SELECT frame, sum(v) AS x FROM placed GROUP BY frame) SELECT frame, round({_SOFT}, 6) + 0.0::DOUBLE AS mixed FROM m")
def timeline_mix(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every cue's clip placed, summed and soft-saturated."""
    return t.mix(t.placed_samples(cues(spark, d), clips(spark, d))).select("frame", r6(soft_saturate(F.col("mixed"))).alias("mixed"))


@query(f"WITH {_PLACED}, m AS (SELECT frame, sum(v) AS x FROM placed WHERE frame >= 20000 GROUP BY frame) SELECT frame, round(x, 6) + 0.0::DOUBLE AS mixed FROM m")
def timeline_seek(spark: SparkSession, d: str) -> DataFrame:
    """From a cursor on: cues in the past begin mid-clip, and nothing is saturated."""
    return t.mix(t.placed_samples(cues(spark, d), clips(spark, d), cursor=20000)).select("frame", r6(F.col("mixed")).alias("mixed"))


@query(f"WITH {_PLACED}, m AS (SELECT frame, sum(v) AS x FROM placed GROUP BY frame), s AS (SELECT unnest(range(min(start_frame) - 100, max(start_frame) + 164)) AS f FROM cues) SELECT f AS frame, round(coalesce(x, 0), 6) + 0.0::DOUBLE AS mixed, x IS NULL AS underrun FROM s LEFT JOIN m ON m.frame = f")
def timeline_silence(spark: SparkSession, d: str) -> DataFrame:
    """From 100 frames before the first cue to 100 behind the last one's clip."""
    placed = cues(spark, d)
    first, last = placed.agg(F.min("start_frame"), F.max("start_frame")).first()
    return t.on_spine(t.mix(t.placed_samples(placed, clips(spark, d))), first - 100, last + 164).withColumn("mixed", r6(F.col("mixed")))


@query(f"WITH {CUES_SQL} SELECT max(start_frame) + 64 AS frames FROM cues")
def scheduled_duration(spark: SparkSession, d: str) -> DataFrame:
    return t.scheduled_frames(cues(spark, d), clips(spark, d))


_PARTS = "parts AS (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS frames FROM lineitem GROUP BY 1, 2)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("frames"))


@query(f"WITH {_PARTS} SELECT *, (sum(frames) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - frames)::BIGINT AS start_frame FROM parts")
def append_offsets(spark: SparkSession, d: str) -> DataFrame:
    return t.append(_parts(spark, d), ["l_orderkey"], ["l_linenumber"], "frames")


@query(
    f"""WITH {_PARTS}, f AS (SELECT *, CASE WHEN lead(frames) OVER w IS NULL THEN 0 ELSE least(10, frames) END AS fade_out FROM parts WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT *, coalesce(lag(fade_out) OVER w, 0) AS fade_in, (sum(frames - fade_out) OVER w - (frames - fade_out))::BIGINT AS start_frame FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)"""
)
def crossfade_cues(spark: SparkSession, d: str) -> DataFrame:
    return t.crossfade_cues(_parts(spark, d), ["l_orderkey"], ["l_linenumber"], "frames", 10)


def _repeat(loop: int) -> None:
    n = loop or 64
    sql = f"WITH {clips_sql()} SELECT clip_id, f::INT AS frame, round(coalesce(data[f % {n} + 1], 0), 6) + 0.0::DOUBLE AS sample FROM clips, range(200) r(f)"
    query(sql, f"repeat_loop_{loop}" if loop else "repeat_loop")(lambda spark, d: t.repeat(clips(spark, d), loop, 200).withColumn("sample", r6(F.col("sample"))))


for _loop in (0, 48, 80):
    _repeat(_loop)

_TRACKS = "tracks AS (SELECT user_id, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) * 1000 AS at_ns, value / 500 AS sample, event_type FROM events)"


def tracks(spark: SparkSession, d: str) -> DataFrame:
    nanos = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) * 1000
    return table(spark, d, "events").select("user_id", "event_id", nanos.alias("at_ns"), (F.col("value") / 500).alias("sample"), "event_type")


@query(
    f"""WITH {_TRACKS}, g AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN sample END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY at_ns, event_type = 'view' ROWS UNBOUNDED PRECEDING) AS gain FROM tracks WHERE event_type IN ('purchase', 'view'))
SELECT user_id, event_id, round(sample * coalesce(gain, 1), 6) + 0.0::DOUBLE AS sample FROM g WHERE event_type = 'view'"""
)
def track_gain_changes(spark: SparkSession, d: str) -> DataFrame:
    """Views are samples; a user's last purchase at or before one sets its gain."""
    all_tracks = tracks(spark, d)
    gains = all_tracks.filter("event_type = 'purchase'").select("user_id", "at_ns", F.col("sample").alias("gain"))
    sounds = all_tracks.filter("event_type = 'view'").select("user_id", "event_id", "at_ns", "sample")
    return t.as_of(sounds, gains, ["user_id"], "at_ns", ["gain"]).select("user_id", "event_id", r6(F.col("sample") * F.coalesce("gain", F.lit(1.0))).alias("sample"))


@query(
    f"""WITH {_TRACKS}, p AS (SELECT user_id, at_ns, sample FROM tracks WHERE event_type = 'purchase'),
v AS (SELECT t.user_id, t.event_id, t.at_ns, (SELECT arg_max(struct_pack(a := at_ns, s := sample), at_ns) FROM p WHERE p.user_id = t.user_id AND p.at_ns <= t.at_ns) AS lo,
  (SELECT arg_min(struct_pack(a := at_ns, s := sample), at_ns) FROM p WHERE p.user_id = t.user_id AND p.at_ns > t.at_ns) AS hi FROM tracks t WHERE event_type = 'view')
SELECT user_id, event_id, round(CASE WHEN lo IS NULL THEN hi.s WHEN hi IS NULL THEN lo.s ELSE lo.s + (at_ns - lo.a) / (hi.a - lo.a)::DOUBLE * (hi.s - lo.s) END, 6) + 0.0::DOUBLE AS gain FROM v"""
)
def envelope_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are a user's envelope; views look it up."""
    all_tracks = tracks(spark, d)
    points = all_tracks.filter("event_type = 'purchase'").select("user_id", F.col("at_ns").alias("at"), F.col("sample").alias("value"))
    rows = all_tracks.filter("event_type = 'view'").select("user_id", "event_id", "at_ns")
    return t.envelope_lookup(rows, points, ["user_id"], "at_ns").select("user_id", "event_id", r6(F.col("gain")).alias("gain"))


_ADAPTED = f"""{clips_sql()}, form AS (SELECT *, CASE label % 3 WHEN 0 THEN 8000 WHEN 1 THEN 4000 ELSE 16000 END AS rate, label % 2 + 1 AS channels FROM clips WHERE label % 2 = 0 OR label % 3 = 0),
held AS (SELECT clip_id, label, channels, CASE WHEN rate = 8000 THEN data ELSE list_transform(range(0, len(data) * 8000 // rate + 1), lambda k: data[greatest(k * rate // 8000, 1)]) END AS data FROM form),
stereo AS (SELECT clip_id, label, CASE WHEN channels = 1 THEN list_transform(range(0, 2 * len(data)), lambda i: data[i // 2 + 1]) ELSE data END AS data FROM held),
m AS (SELECT label, i - 1 AS pos, sum(data[i] * 0.5::DOUBLE) AS x FROM (SELECT label, data, unnest(range(1, len(data) + 1)) AS i FROM stereo) GROUP BY label, i)"""


@query(f"WITH {_ADAPTED} SELECT label, (pos // 2)::INT AS frame, (pos % 2)::INT AS ch, round({_SOFT}, 6) + 0.0::DOUBLE AS mixed FROM m")
def mixer_adapt(spark: SparkSession, d: str) -> DataFrame:
    """A mixer per label: tracks of other rates are resampled, mono ones up-mixed, all scaled, summed, then saturated."""
    label = F.col("label")
    form = clips(spark, d).filter((label % 2 == 0) | (label % 3 == 0)).withColumn("rate", F.when(label % 3 == 0, 8000).when(label % 3 == 1, 4000).otherwise(16000)).withColumn("channels", label % 2 + 1)
    tracks = form.select("label", F.lit(0).cast("long").alias("start_frame"), "rate", "channels", F.lit(0.5).alias("gain"), "data")
    summed = t.mixer(tracks, ["label"], 8000, 2, (8000, 4000, 16000)).select("label", "pos", F.col("mixed").alias("x"))
    return summed.select("label", F.floor(F.col("pos") / 2).cast("int").alias("frame"), (F.col("pos") % 2).alias("ch"), r6(soft_saturate(F.col("x"))).alias("mixed"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1, 2), f AS (SELECT *, (l_linenumber - 1) // 2 AS chunk_no FROM c)
SELECT l_orderkey, chunk_no::INT AS chunk_no, l_linenumber, size, (1000 * chunk_no + sum(size) OVER (PARTITION BY l_orderkey, chunk_no ORDER BY l_linenumber) - size)::BIGINT AS "offset" FROM f"""
)
def sample_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Two samples a chunk, chunks 1000 bytes apart."""
    sized = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("size"))
    cut = sized.withColumn("chunk_no", F.floor((F.col("l_linenumber") - 1) / 2).cast("int"))
    return t.sample_offsets(cut, ["l_orderkey"], "chunk_no", "l_linenumber", "size", F.col("chunk_no") * 1000).select("l_orderkey", "chunk_no", "l_linenumber", "size", F.col("offset").cast("bigint").alias("offset"))


@query(
    """WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS chunk_no FROM orders), r AS (SELECT DISTINCT o_custkey, x AS first_chunk, (o_custkey + x) % 5 + 1 AS per_chunk FROM c, (VALUES (1), (4), (9)) v(x))
SELECT c.o_custkey, c.chunk_no, (SELECT arg_max(per_chunk, first_chunk) FROM r WHERE r.o_custkey = c.o_custkey AND first_chunk <= c.chunk_no)::BIGINT AS per_chunk FROM c"""
)
def chunk_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run-length table (first chunk, samples per chunk) expanded to every chunk."""
    from pyspark.sql import Window

    chunks = table(spark, d, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("chunk_no"))
    runs = chunks.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("first_chunk"))
    runs = runs.withColumn("per_chunk", (F.col("o_custkey") + F.col("first_chunk")) % 5 + 1)
    return t.expand_runs(runs, chunks, ["o_custkey"])
