"""Live tracks: silence where nothing has come, what overflowed, late rows, change feeds. Most need no Python state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.devices import latest, snapshot_changes


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master may do without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/wavelake")
    return sc._jsc.sc().getCheckpointDir().get()


def to_the_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives from what is there now, as a table in the shared folder; under 'complete' the last state."""
    base = f"{shared_folder(stream.sparkSession)}/{uuid.uuid4().hex}"

    def kept(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows" if mode == "complete" else f"{base}/rows/batch={number}")

    stream.writeStream.foreachBatch(kept).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def live_mix(stream: DataFrame, at: str, width: str, late: str, value: str) -> DataFrame:
    """Sums of a live signal in event-time windows: rows later than the watermark are dropped, as a live cue in the past gives no sound."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.sum(value).alias("mixed"), F.count(value).alias("n")).select("w.start", "w.end", "mixed", "n")


def underruns(mixed: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """Spine rows without sound: silence was played there."""
    return spine.join(mixed, key, "left_anti")


def overflow(rows: DataFrame, key: str, order: list[str], period: str, capacity: int) -> DataFrame:
    """Per key and period: how many rows a buffer of this capacity takes and how many it drops (the newest, as a full ring discards them)."""
    w = Window.partitionBy(key, period).orderBy(*order)
    at = rows.withColumn("__n", F.row_number().over(w))
    return at.groupBy(key, period).agg(F.sum(F.when(F.col("__n") <= capacity, 1).otherwise(0)).alias("taken"), F.sum(F.when(F.col("__n") > capacity, 1).otherwise(0)).alias("dropped"))


def observed(stream: DataFrame, name: str, value: str) -> DataFrame:
    """Attach counters to a stream, which its progress reports: rows and the sum of absolute values."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(F.abs(value)).alias("level"))


def change_feed(key: str, order: list[str], properties: list[str], default: str, emit: Callable[[DataFrame, int], None], folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a snapshot; emits its changes against the one before.

    Snapshots are kept in ``folder`` by the number of their batch, the last two of them: so a batch that is run again,
    or comes after a restart, is compared with what came before it.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
        store = at(0).getFileSystem(spark._jsc.hadoopConfiguration())
        latest(batch, key, order).write.mode("overwrite").parquet(f"{folder}/{number}")  # the batch itself is gone when the next one comes
        now = spark.read.schema(batch.schema).parquet(f"{folder}/{number}")
        before = spark.read.schema(batch.schema).parquet(f"{folder}/{number - 1}") if store.exists(at(number - 1)) else now.limit(0)
        emit(snapshot_changes(before, now, key, properties, default), number)
        store.delete(at(number - 2), True)

    return on_batch


def paced(spark: SparkSession, path: str, schema: StructType | str, files: int) -> DataFrame:
    """A stream of Parquet files that takes so many at a time: what a slow reader does not take waits at the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
