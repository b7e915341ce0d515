"""Streams give what batches give."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import devices
from wavelake.operators.recurrences import KINDS
from wavelake.streaming import live, stateful


@pytest.fixture()
def source(spark, tmp_path):
    """Two streams of 50 and 21 samples, cut into three files that come one by one."""
    rng = np.random.default_rng(1)
    rows = [(s, i, float(v)) for s, n in ((1, 50), (2, 21)) for i, v in enumerate(rng.uniform(-1, 1, n))]
    df = spark.createDataFrame(rows, stateful.SAMPLES)
    for k, (a, b) in enumerate(((0, 13), (13, 20), (20, 99))):
        df.filter((F.col("pos") >= a) & (F.col("pos") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return rows, stream, tmp_path


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_chunks_do_not_depend_on_batches(source):
    rows, stream, tmp = source
    got = {(r.stream_id, r.chunk_no): r.data for r in run(stateful.chunked(stream, 8), "chunks", tmp).collect()}
    by = {s: [v for k, _, v in rows if k == s] for s in (1, 2)}
    assert got == {(s, i): v[8 * i : 8 * i + 8] for s, v in by.items() for i in range(len(v) // 8)}


def test_processors_carry_their_state(source):
    rows, stream, tmp = source
    params = {"cutoff": 700.0, "q": 0.8, "rate": 8000}
    got = run(stateful.processed(stream, "lowpass", **params), "processed", tmp).toPandas().sort_values(["stream_id", "pos"])
    for s in (1, 2):
        x = np.array([v for k, _, v in rows if k == s])
        assert np.allclose(got[got.stream_id == s]["sample"], KINDS["lowpass"](1, **params).process(x[None, :])[0], atol=1e-12)


def test_the_end_flushes_chunks_and_tails(spark, source):
    rows, stream, tmp = source
    files = spark.read.parquet(str(tmp / "in")).withColumn("eos", F.lit(False))
    last = spark.createDataFrame([(1, 1000, None, True), (2, 1000, None, True)], "stream_id long, pos long, sample double, eos boolean")
    for k, part in enumerate((files.filter("pos < 30"), files.filter("pos >= 30").union(last))):
        part.coalesce(1).write.parquet(str(tmp / f"ended/{k}"))
    ended = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp / "ended"))
    got = {(r.stream_id, r.chunk_no): (r.n, r.data) for r in run(stateful.chunked(ended, 8), "flushed", tmp).collect()}
    by = {s: [v for k, _, v in rows if k == s] for s in (1, 2)}
    assert got == {(s, i): (len(v[8 * i : 8 * i + 8]), v[8 * i : 8 * i + 8] + [0.0] * max(0, 8 * i + 8 - len(v))) for s, v in by.items() for i in range(-(-len(v) // 8))}
    params = {"delay": 500_000, "feedback": 0.5, "wet": 0.5, "rate": 8000}
    out = run(stateful.processed(ended, "echo", tail=6, **params), "tails", tmp).toPandas().sort_values(["stream_id", "pos"])
    for s, v in by.items():
        want = KINDS["echo"](1, **params).process(np.array([v + [0.0] * 6]))[0]
        assert np.allclose(out[out.stream_id == s]["sample"], want, atol=1e-12) and out[out.stream_id == s].pos.tolist() == list(range(len(v) + 6))


def test_silence_flushes_chunks(spark, source):
    rows, stream, tmp = source
    q = stateful.chunked(stream, 8, idle=300).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp / "idle")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and spark.table("idle").filter("n < 8").count() < 2:
            time.sleep(0.5)
        told = spark.table("idle").toPandas()
    finally:
        q.stop()
    assert told.n.sum() == len(rows)


def test_change_feed(spark, tmp_path):
    told = []
    new = lambda: live.change_feed("id", ["t"], ["rate"], "is_default", lambda df, n: told.append(sorted((r.kind, r.id) for r in df.collect())), str(tmp_path / "feed"))
    snap = lambda *rows: spark.createDataFrame(list(rows), "id string, t int, rate int, is_default boolean")
    feed = new()
    feed(snap(("a", 1, 1, True), ("b", 1, 1, False)), 0)
    feed(snap(("a", 2, 1, False), ("b", 2, 2, True), ("c", 2, 1, False)), 1)
    again = new()  # after a restart, and a batch that is run again
    again(snap(("a", 2, 1, False), ("b", 2, 2, True), ("c", 2, 1, False)), 1)
    again(snap(("c", 3, 5, False), ("b", 3, 2, True)), 2)
    second = [("added", "c"), ("default_changed", "b")]
    assert told == [[("added", "a"), ("added", "b")], second, second, [("property_changed", "c"), ("removed", "a")]]


def test_backends_and_their_events(spark):
    known = devices.Backends()
    known.register("gpu", [("h264", "decode")])
    known.register("dsp", [("h264", "decode"), ("vp9", "decode")])
    known.register("gpu", [("h264", "decode"), ("av1", "decode")])
    known.remove("none")
    asked = spark.createDataFrame([(1, "h264", "decode"), (2, "av1", "decode"), (3, "av1", "encode")], "request_id int, codec string, direction string")
    chosen = devices.select_backend(known.frame(spark), asked)
    assert {r.request_id: r.backend for r in chosen.collect()} == {1: "dsp", 2: "gpu", 3: "software"}
    assert [(r.request_id, r.kind) for r in devices.fallback_events(chosen).collect()] == [(3, "fallback")]
    strict = devices.select_backend(known.frame(spark), asked, "require_hardware")
    assert [(r.request_id, r.kind) for r in devices.fallback_events(strict).collect()] == [(3, "refused")]


def test_observed_counts(spark, source):
    rows, stream, tmp = source
    assert run(live.observed(stream, "levels", "sample"), "observed", tmp).count() == len(rows)
