"""Raw samples in bytes, all six formats, vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.samples import FORMATS

#: Bytes of a piece, a multiple of every sample's width: the ten thousand pieces of an Arrow batch are 41 MB, however long the rows are.
PIECE = 4080
#: Samples that are handed back at once.
BATCH = 1 << 17


def decode(raw: bytes, form: str, big: bool = False) -> np.ndarray:
    """Samples in [-1, 1] (floats as they are); an incomplete last sample is dropped."""
    width, scale, _, bias = FORMATS[form]
    raw = raw[: len(raw) // width * width]
    order = ">" if big else "<"
    if scale is None:
        return np.frombuffer(raw, f"{order}f{width}").astype(float)
    if bias:
        return (np.frombuffer(raw, np.uint8).astype(float) - bias) / scale
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if big else b[:, ::-1]
        return ((b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]) ^ 0x800000).astype(float) / scale - 1.0
    return np.frombuffer(raw, f"{order}i{width}").astype(float) / scale


def encode(data: np.ndarray, form: str, big: bool = False) -> bytes:
    """Integers are clamped and truncated toward zero; floats are not clamped."""
    width, _, scale, bias = FORMATS[form]
    order, x = ">" if big else "<", np.asarray(data, float)
    if scale is None:
        return x.astype(f"{order}f{width}").tobytes()
    x = np.clip(x, -1.0, 1.0) * scale
    if bias:
        return np.minimum(x + bias, 255).astype(np.uint8).tobytes()
    if width == 3:
        b = x.astype(np.int64).astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:]
        return (b if big else b[:, ::-1]).tobytes()
    return x.astype(np.int64).astype(f"{order}i{width}").tobytes()


def decoded(raw: Column, form: str, big: bool = False) -> Column:
    """An array per row. A batch's arrays are in memory together, eight bytes a sample; ``long_decoded`` gives rows without them."""

    @F.pandas_udf("array<double>")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else decode(b, form, big) for b in x])

    return f(raw)


def sample_batches(batches: Iterator[pa.RecordBatch], form: str, big: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of (key, piece, raw) -> batches of (key, pos, sample), of BATCH samples and a piece at most."""
    width = FORMATS[form][0]
    for batch in batches:
        key, piece, raw = batch.columns
        first, n = piece.to_numpy() * (PIECE // width), pc.binary_length(raw).to_numpy() // width
        total, begin = np.cumsum(n), 0
        while begin < len(n):
            end = int(np.searchsorted(total, total[begin] + BATCH, "right"))
            x = np.concatenate([decode(b, form, big) for b in raw[begin:end].to_pylist()])
            own = n[begin:end]
            pos = np.arange(len(x)) + np.repeat(first[begin:end] - (np.cumsum(own) - own), own)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(np.repeat(np.arange(begin, end), own))), pa.array(pos.astype(np.int32)), pa.array(x)], [batch.schema.names[0], "pos", "sample"])
            begin = end


def long_decoded(df: DataFrame, key: str, raw: str, form: str, big: bool = False) -> DataFrame:
    """A row per sample: key, pos, sample; an incomplete last sample is dropped, a null or empty raw gives no row.

    Bytes are cut into pieces before they reach Python and come back as rows, so no array of a row's samples is ever made.
    """
    last = F.floor((F.octet_length(raw) - 1) / PIECE).cast("int")
    cut = df.filter(F.octet_length(raw) > 0).select(key, raw, F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = cut.select(key, "piece", F.substring(raw, F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("raw"))
    return pieces.mapInArrow(lambda batches: sample_batches(batches, form, big), f"`{key}` {df.schema[key].dataType.simpleString()}, pos int, sample double")


def encoded(data: Column, form: str, big: bool = False) -> Column:
    @F.pandas_udf("binary")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else encode(d, form, big) for d in x])

    return f(data)
