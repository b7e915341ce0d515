"""Queries over events: snapshots and what changed, backends, chunks of a fixed count, overflow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import devices
from ..registry import query
from ..streaming import live, stateful
from .views import table

_SNAP = """snap AS (SELECT * FROM (SELECT user_id, date_trunc('day', ts) AS day, event_type AS name, (value > 250) AS rate, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS n, value FROM events) WHERE n = 1),
s AS (SELECT user_id, day, name, rate, value = max(value) OVER (PARTITION BY day) AS is_default FROM snap)"""


def snapshot(spark: SparkSession, d: str, day: str) -> DataFrame:
    """Each user's last event of a day, as a device: name, rate; the largest value is the default."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts")).filter(F.col("day") == day)
    last = devices.latest(rows, "user_id", ["ts", "event_id"])
    top = last.groupBy("day").agg(F.max("value").alias("top"))
    return last.join(top, "day").select("user_id", F.col("event_type").alias("name"), (F.col("value") > 250).alias("rate"), (F.col("value") == F.col("top")).alias("is_default"))


@query(
    f"""WITH {_SNAP}, a AS (SELECT * FROM s WHERE day = DATE '2024-01-10'), b AS (SELECT * FROM s WHERE day = DATE '2024-01-11')
SELECT * FROM (SELECT CASE WHEN b.user_id IS NULL THEN 'removed' WHEN a.user_id IS NULL THEN 'added' WHEN NOT a.is_default AND b.is_default THEN 'default_changed' WHEN a.name <> b.name OR a.rate <> b.rate THEN 'property_changed' END AS kind,
  coalesce(a.user_id, b.user_id) AS user_id FROM a FULL JOIN b ON a.user_id = b.user_id) WHERE kind IS NOT NULL"""
)
def device_changes(spark: SparkSession, d: str) -> DataFrame:
    return devices.snapshot_changes(snapshot(spark, d, "2024-01-10"), snapshot(spark, d, "2024-01-11"), "user_id", ["name", "rate"], "is_default")


_CODECS = "c AS (SELECT * FROM (VALUES ('h264', 0), ('h265', 1), ('vp9', 2), ('av1', 3)) t(codec, k))"


@query(
    f"""WITH {_CODECS}, b AS (SELECT s_name AS backend, s_suppkey AS rank, codec, CASE WHEN (s_suppkey + k) % 2 = 0 THEN 'decode' ELSE 'encode' END AS direction FROM supplier, c WHERE (s_suppkey + k) % 3 = 0 AND s_acctbal > 0 AND k < 3),
r AS (SELECT p_partkey AS request_id, c.codec, CASE WHEN p_size % 2 = 0 THEN 'decode' ELSE 'encode' END AS direction FROM part JOIN c ON c.k = p_partkey % 4),
f AS (SELECT codec, direction, arg_min(backend, rank) AS backend FROM b GROUP BY 1, 2)
SELECT request_id, r.codec, r.direction, coalesce(backend, 'software') AS backend, backend IS NULL AS fell_back FROM r LEFT JOIN f ON f.codec = r.codec AND f.direction = r.direction"""
)
def backend_select(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as backends with some codecs, parts as requests; nothing supports av1."""
    codecs = spark.createDataFrame([("h264", 0), ("h265", 1), ("vp9", 2), ("av1", 3)], "codec string, k int")
    way = lambda n: F.when(n % 2 == 0, "decode").otherwise("encode")
    key = F.col("s_suppkey") + F.col("k")
    known = F.array(*[F.struct(F.lit(c).alias("codec"), F.lit(k).alias("k")) for k, c in enumerate(("h264", "h265", "vp9"))])
    backends = table(spark, d, "supplier").select("*", F.inline(known)).filter(key % 3 == 0)
    backends = backends.select(F.col("s_name").alias("backend"), F.col("s_suppkey").alias("rank"), "codec", way(key).alias("direction"), (F.col("s_acctbal") > 0).alias("available"))
    requests = table(spark, d, "part").join(F.broadcast(codecs), F.col("p_partkey") % 4 == F.col("k")).select(F.col("p_partkey").alias("request_id"), "codec", way(F.col("p_size")).alias("direction"))
    return devices.select_backend(backends, requests)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of samples of their users, by time and number, that ends."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = table(spark, d, "events")
    ends = f"{live.shared_folder(spark)}/{uuid.uuid4().hex}"
    rows.select(F.col("user_id").cast("long").alias("stream_id")).distinct().write.parquet(ends)
    stateful.use_rocksdb(spark)
    sounds = live.paced(spark, f"{d}/events.parquet*", rows.schema, 1000)
    sounds = sounds.select(F.col("user_id").cast("long").alias("stream_id"), (micros * 1_000_000 + F.col("event_id") % 1_000_000).alias("pos"), (F.col("value") / 500).alias("sample"), F.lit(False).alias("eos"))
    return sounds.union(live.paced(spark, ends, "stream_id long", 1000).select("stream_id", F.lit((1 << 62) - 1).alias("pos"), F.lit(None).cast("double").alias("sample"), F.lit(True).alias("eos")))


_POS = "n AS (SELECT user_id, value / 500 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


@query(f"WITH {_POS}, g AS (SELECT user_id, pos // 8 AS chunk_no, sum(x) AS total, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, chunk_no, n, round(total, 6) + 0.0::DOUBLE AS total FROM g WHERE n = 8")
def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Full chunks of 8 samples per stream, by the streaming chunker."""
    return _chunk_totals(live.to_the_end(stateful.chunked(_samples(spark, d).drop("eos").filter("sample is not null"), 8)))


@query(f"WITH {_POS}, g AS (SELECT user_id, pos // 8 AS chunk_no, sum(x) AS total, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, chunk_no, n, round(total, 6) + 0.0::DOUBLE AS total FROM g WHERE n < 8")
def stream_flush(spark: SparkSession, d: str) -> DataFrame:
    """What the end of a stream flushes: the rest, padded to a chunk."""
    last = live.to_the_end(stateful.chunked(_samples(spark, d), 8)).filter((F.col("n") < 8) & (F.size("data") == 8))
    return _chunk_totals(last)


def _chunk_totals(chunks: DataFrame) -> DataFrame:
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return chunks.select(F.col("stream_id").alias("user_id"), "chunk_no", F.col("n").cast("long").alias("n"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query(
    f"""WITH {_POS}, ends AS (SELECT user_id, max(pos) AS last FROM n GROUP BY 1), t AS (SELECT user_id, last, unnest(range(1, 13)) AS k FROM ends)
SELECT t.user_id, t.k::INT AS k, round(0.5::DOUBLE * coalesce(sum(pow(0.5::DOUBLE, (last + k - pos) // 4) * x) FILTER ((last + k - pos) % 4 = 0), 0), 6) + 0.0::DOUBLE AS sample
FROM t JOIN n USING (user_id) GROUP BY t.user_id, t.k"""
)
def stream_tail(spark: SparkSession, d: str) -> DataFrame:
    """An echo of 4 samples that rings out for 12 behind the end of each stream."""
    rows = live.to_the_end(stateful.processed(_samples(spark, d), "echo", tail=12, delay=500_000, feedback=0.5, wet=0.5, rate=8000))
    last = Window.partitionBy("stream_id").orderBy(F.desc("pos"))
    tail = rows.withColumn("k", 13 - F.row_number().over(last)).filter("k > 0")
    return tail.select(F.col("stream_id").alias("user_id"), "k", (F.round("sample", 6) + F.lit(0.0)).alias("sample"))


@query("WITH n AS (SELECT user_id, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (n <= 2) AS taken, count(*) FILTER (n > 2) AS dropped FROM n GROUP BY user_id, n.day")
def buffer_overflow(spark: SparkSession, d: str) -> DataFrame:
    """A buffer of two events a day."""
    days = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return live.overflow(days, "user_id", ["ts", "event_id"], "day", 2)


@query("SELECT strftime(day, '%Y-%m-%d') AS day FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS day) WHERE day NOT IN (SELECT date_trunc('day', ts) FROM events)")
def underrun_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of a spine on which nothing sounds."""
    spine = spark.sql("SELECT date_format(day, 'yyyy-MM-dd') AS day FROM (SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-14')) AS day)")
    return live.underruns(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct(), spine, "day")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS mixed FROM events GROUP BY 1")
def live_mix(spark: SparkSession, d: str) -> DataFrame:
    """A live signal in windows of a day: the events, read as a stream that has ended."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    mixed = live.to_the_end(live.live_mix(source, "at", "1 day", "40 days", "value"), "complete")
    return mixed.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("mixed", 4).alias("mixed"))
