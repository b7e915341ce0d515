"""Snapshots of a dimension and what changed between them; choice of a backend; backend capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, properties: list[str], default: str) -> DataFrame:
    """(kind, key) of what a listener would be told: removed, added, default_changed (newly the default), property_changed.

    One full outer join. A row that became the default is told as that only, even if its properties changed too.
    """
    o = old.select(F.col(key), F.lit(True).alias("__in_old"), *[F.col(c).alias(f"__old_{c}") for c in [*properties, default]])
    n = new.select(F.col(key), F.lit(True).alias("__in_new"), *[F.col(c) for c in [*properties, default]])
    both = o.join(n, key, "full")
    differs = F.lit(False)
    for p in properties:
        differs = differs | ~F.col(p).eqNullSafe(F.col(f"__old_{p}"))
    kind = (
        F.when(F.col("__in_new").isNull(), "removed")
        .when(F.col("__in_old").isNull(), "added")
        .when(~F.col(f"__old_{default}") & F.col(default), "default_changed")
        .when(differs, "property_changed")
    )
    return both.select(kind.alias("kind"), key).filter("kind is not null")


def select_backend(backends: DataFrame, requests: DataFrame, mode: str = "prefer_hardware") -> DataFrame:
    """backends: (backend, rank, codec, direction, available); requests: (request_id, codec, direction).

    The first available backend, by rank, that supports a request. None: 'software' under prefer_hardware, and always
    under software_only; null under require_hardware. Adds fell_back.
    """
    usable = backends.filter("available").select("backend", "rank", F.col("codec").alias("__c"), F.col("direction").alias("__d"))
    first = usable.groupBy("__c", "__d").agg(F.min_by("backend", F.struct("rank", "backend")).alias("backend"))
    found = requests.join(first, (F.col("codec") == F.col("__c")) & (F.col("direction") == F.col("__d")), "left")
    chosen = F.lit("software") if mode == "software_only" else F.col("backend") if mode == "require_hardware" else F.coalesce("backend", F.lit("software"))
    return found.select("request_id", "codec", "direction", chosen.alias("backend"), (F.col("backend").isNull() & F.lit(mode == "prefer_hardware")).alias("fell_back"))


def fallback_events(chosen: DataFrame) -> DataFrame:
    """select_backend's rows -> (request_id, codec, direction, kind): what a listener would be told of requests that no hardware took."""
    kind = F.when(F.col("backend").isNull(), "refused").when(F.col("fell_back"), "fallback")
    return chosen.select("request_id", "codec", "direction", kind.alias("kind")).filter("kind is not null")


class Backends:
    """A registry of backends: register and remove them; the first registered has the lowest rank. frame() is what select_backend takes."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str, str, bool]] = []
        self.next = 0

    def register(self, backend: str, supports: list[tuple[str, str]], available: bool = True) -> None:
        """supports: (codec, direction) pairs. A backend that is registered again takes the place of the old one, at the end."""
        self.remove(backend)
        self.rows += [(backend, self.next, codec, direction, available) for codec, direction in supports]
        self.next += 1

    def remove(self, backend: str) -> None:
        self.rows = [r for r in self.rows if r[0] != backend]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "backend string, rank int, codec string, direction string, available boolean")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
