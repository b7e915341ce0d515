"""Tables of the fixtures, read as clips, bytes, cues and tracks; in Spark, and as SQL text for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rate that clips are taken to have.
RATE = 8000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str, gain: float = 1.0) -> DataFrame:
    """embeddings as mono clips of 64 samples: clip_id, label, data. With gain 2.5 they exceed full scale."""
    sample = (lambda x: x.cast("double") * gain) if gain != 1.0 else (lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), "label", F.transform("embedding", sample).alias("data"))


def clips_sql(gain: float = 1.0) -> str:
    return f"clips AS (SELECT vec_id AS clip_id, label, list_transform(embedding, lambda x: x::DOUBLE{f' * {gain}::DOUBLE' if gain != 1.0 else ''}) AS data FROM embeddings)"


def pcm_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' UTF-8 bytes: id, raw."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("raw"))


BYTES_SQL = "bytes AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents)"
#: Bytes of a block of a text, a multiple of every sample's width: cutting pieces out of a short string is cheap.
BLOCK = 240
BLOCKS_SQL = f"{BYTES_SQL}, cut AS (SELECT id, h, unnest(range(0, (len(h) + {2 * BLOCK - 1}) // {2 * BLOCK})) AS block FROM bytes), blocks AS (SELECT id, block, h[block * {2 * BLOCK} + 1:(block + 1) * {2 * BLOCK}] AS h FROM cut)"


def long(df: DataFrame, key: str, column: str = "data", value: str = "sample") -> DataFrame:
    """A row per sample: key, pos, value (six places)."""
    at = df.select(key, F.posexplode(column).alias("pos", "x"))
    return at.select(key, "pos", (F.round("x", 6) + F.lit(0.0)).alias(value))


def long_sql(key: str, column: str = "data", source: str = "out", value: str = "sample") -> str:
    return f"SELECT {key}, (i - 1)::INT AS pos, round({column}[i], 6) + 0.0::DOUBLE AS {value} FROM (SELECT {key}, {column}, unnest(range(1, len({column}) + 1)) AS i FROM {source})"
