"""Helpers that several operators share: words, hashes, arrow batches, durable cuts of lineage."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words. bytes.split() splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
WHITESPACE = " \t\n\x0b\x0c\r"

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression is evaluated as often as it is written."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(a: Column, block: int = 256) -> Column:
    """For each element of an array of longs the sum of those before it.

    A fold that appends copies its array at every step; so sums run within blocks, and over the blocks' totals, which
    keeps the work near linear for arrays of many thousands.
    """
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    running = lambda x: F.aggregate(x, F.array(F.lit(0).cast("bigint")), append)
    count = F.ceil(F.size(a) / block).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(a, i * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<bigint>>"))
    shifted = lambda local, before: F.flatten(F.transform(local, lambda s, i: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + F.get(before, i))))
    totals = lambda local: running(F.transform(local, lambda s: F.element_at(s, -1)))
    return bind(F.transform(blocks, running), lambda local: bind(totals(local), lambda before: shifted(local, before)))


def seeded(seed: str, *cols: Column) -> Column:
    """A reproducible random order: hex MD5 of the seed and the columns, nulls told apart from empty strings."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, in the folder that spark.checkpoint.dir names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master (tests) gets one of our own; a cluster gets an error, as no folder of one machine will do."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/wavelake")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: for tables that hold texts, smaller than a checkpoint. It lives as long as the folder, which belongs to the application."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    return f"/{uri.removeprefix('file:').lstrip('/')}" if uri.startswith(("file:", "/")) else None


def stored_file(uri: str, content: bytes) -> None:
    """Writes a file of the shared folder, whole or not at all: tasks that are run again write the same once more."""
    aside = f"{uri}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(aside), "wb") as f:
            f.write(content)
        os.replace(_local(aside), path)
    else:
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        beside = f"{path}{aside.removeprefix(uri)}"
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(beside) as f:
            f.write(content)
        store.move(beside, path)


def mapped_file(uri: str) -> mmap.mmap:
    """A file of the shared folder in memory: mapped where the folder is mounted, else read into a mapping of its own."""
    if path := _local(uri):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    raw = store.open_input_file(path).readall()
    held = mmap.mmap(-1, len(raw))
    held.write(raw)
    return held


def id_text(df: DataFrame, column: str = "doc_id") -> Column:
    """A column of ids as text: pandas would turn whole numbers beside a null into floats, and large ones into others."""
    return df[f"`{column}`"].cast("string")


def with_id_of(out: DataFrame, df: DataFrame, column: str = "doc_id") -> DataFrame:
    """out, whose ids are text, with the type that df's have."""
    return out.withColumn(column, F.col(f"`{column}`").cast(df.schema[column].dataType))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Copies of a row that one array of numbers stands for.
COPIES = 4096


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Equal rows told apart by ``name``: 0, 1, ... They are counted where they lie before they are exchanged, and listed again by a stream of numbers, so a row that comes very often is no hot key."""
    times, block = free_name(rows, "times"), free_name(rows, "block")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(times))
    blocks = counted.select(*columns, times, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))).alias(block))
    last = F.least(F.col(times) - F.col(block) * COPIES, F.lit(COPIES)) - 1
    return blocks.select(*columns, block, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(name)).select(*columns, (F.col(block) * COPIES + F.col(name)).alias(name))


FILTER_BITS = 1 << 24


def members(ids: DataFrame, key: str) -> DataFrame:
    """A hashed bitmap of the values of ``key``: (bucket, bits), 2 MB at most, however many values there are."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    return ids.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))


def split_by(df: DataFrame, key: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the bitmap, rows whose key is not): what an exact join need not see is not shuffled.

    The bitmap is broadcast: its size is bounded by FILTER_BITS. Full, it lets all rows through to the join.
    """
    bucket, bit, bits = (free_name(df, c) for c in ("__bucket", "__bit", "__bits"))
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    joined = df.withColumn(bucket, F.bitmap_bucket_number(at)).withColumn(bit, F.bitmap_bit_position(at)).join(F.broadcast(bitmap.toDF(bucket, bits)), bucket, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return joined.filter(hit).select(*columns), joined.filter(~hit).select(*columns)


def utf8(text: object) -> bytes:
    """UTF-8 bytes of a pandas cell; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def fold(text: object) -> list[bytes]:
    """The words of a text with A-Z lower-cased; bytes.lower() and bytes.split() know ASCII only."""
    return utf8(text).lower().split()


class Interned(dict):
    """word -> place in ``words``; grows by every word that is looked up."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.words)
        self.words.append(word)
        return at

    def hashes(self, seed: int = 0) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), U64, len(self.words))


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``most``; one large item is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift, twice)."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))
