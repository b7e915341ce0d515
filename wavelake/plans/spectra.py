"""Queries over spectra, correlation and similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.samples import r6
from ..operators import spectral as sp
from ..registry import query
from .views import clips, clips_sql, long, long_sql

_X = f"{clips_sql()}, x AS (SELECT clip_id, label, unnest(range(0, len(data))) AS i, unnest(data) AS v FROM clips)"
_DFT = f"""WITH {_X}, dft AS (SELECT clip_id, label, k, sqrt(pow(sum(v * cos(2 * pi() * i * k / 64)), 2) + pow(sum(v * sin(2 * pi() * i * k / 64)), 2)) AS m FROM x, range(33) r(k) GROUP BY clip_id, label, k)"""


@query(f"{_DFT} SELECT clip_id, k::INT AS pos, round(m, 6) + 0.0::DOUBLE AS sample FROM dft")
def dft_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", sp.real_fft("data").alias("data")), "clip_id")


@query(
    f"WITH {_X}, c AS (SELECT clip_id, k, sum(v * cos(2 * pi() * i * k / 60)) AS re, -sum(v * sin(2 * pi() * i * k / 60)) AS im FROM x, range(60) r(k) WHERE i < 60 GROUP BY clip_id, k) SELECT clip_id, k::INT AS pos, round(re, 5) + 0.0::DOUBLE AS re, round(im, 5) + 0.0::DOUBLE AS im FROM c"
)
def dft_any_length(spark: SparkSession, d: str) -> DataFrame:
    """60 samples: not a power of two."""
    y = clips(spark, d).select("clip_id", F.posexplode(sp.mixed_radix_fft(sp.complex_of(F.slice("data", 1, 60)))).alias("pos", "c"))
    return y.select("clip_id", "pos", *((F.round(f"c.{p}", 5) + F.lit(0.0)).alias(p) for p in ("re", "im")))


@query(f"WITH {clips_sql()}, out AS (SELECT clip_id, data FROM clips) {long_sql('clip_id')}")
def fft_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = sp.ifft(sp.fft(sp.complex_of(F.col("data"))))
    return long(clips(spark, d).select("clip_id", F.transform(back, lambda c: c["re"]).alias("data")), "clip_id")


_MDCT = f"WITH {_X}, m AS (SELECT clip_id, k, sum(v * cos(pi() / 64 * (i + 0.5::DOUBLE + 16) * (k + 0.5::DOUBLE))) AS c FROM x, range(32) r(k) GROUP BY clip_id, k)"


@query(f"{_MDCT} SELECT clip_id, k::INT AS pos, round(c, 6) + 0.0::DOUBLE AS sample FROM m")
def mdct(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", sp.mdct("data").alias("data")), "clip_id")


@query(f"{_MDCT} SELECT clip_id, n::INT AS pos, round(sum(c * cos(pi() / 64 * (n + 0.5::DOUBLE + 16) * (k + 0.5::DOUBLE))) / 32, 6) + 0.0::DOUBLE AS sample FROM m, range(64) r(n) GROUP BY clip_id, n")
def imdct(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", sp.imdct(sp.mdct("data")).alias("data")), "clip_id")


@query(
    f"""WITH {_X}, g AS (SELECT a.i, b.j, sum(cos({math.pi / 16!r}::DOUBLE * (k + 0.5) * (i + 4.5)) * cos({math.pi / 16!r}::DOUBLE * (k + 0.5) * (j + 4.5))) / 8 AS w FROM range(16) a(i), range(16) b(j), range(8) c(k) GROUP BY 1, 2),
o AS (SELECT x.clip_id, 8 * f + g.i AS p, sum(g.w * x.v) AS v FROM x JOIN range(7) r(f) ON x.i BETWEEN 8 * f AND 8 * f + 15 JOIN g ON g.j = x.i - 8 * f GROUP BY 1, 2)
SELECT o.clip_id, round(max(abs(o.v - x.v)), 6) AS max_error FROM o JOIN x ON x.clip_id = o.clip_id AND x.i = o.p WHERE o.p BETWEEN 8 AND 47 GROUP BY 1"""
)
def mdct_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What is left of half-overlapping frames of 16 samples that are transformed, transformed back and added."""

    @F.pandas_udf("double")
    def error(data: pd.Series) -> pd.Series:
        return pd.Series([sp.mdct_round_trip_error(np.asarray(x, float), 8) for x in data])

    return clips(spark, d).select("clip_id", F.round(error("data"), 6).alias("max_error"))


@query(f"WITH {_X} SELECT a.clip_id, k::INT AS pos, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS sample FROM x a, range(16) r(k), x b WHERE b.clip_id = a.clip_id AND b.i = a.i - k GROUP BY a.clip_id, k")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return long(clips(spark, d).select("clip_id", sp.autocorrelation(F.col("data"), 16).alias("data")), "clip_id")


@query(
    f"""{_DFT}, ref AS (SELECT label, min(clip_id) AS reference FROM clips GROUP BY label)
SELECT a.label, a.clip_id, reference, round(least(greatest(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 0), 1), 6) + 0.0::DOUBLE AS similarity
FROM dft a JOIN ref USING (label) JOIN dft b ON b.clip_id = reference AND b.k = a.k GROUP BY a.label, a.clip_id, reference"""
)
def spectral_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every clip against the first clip of its label."""
    all_clips = clips(spark, d)
    first = all_clips.groupBy("label").agg(F.min_by("data", "clip_id").alias("data"), F.min("clip_id").alias("clip_id"))
    return sp.similar_to(all_clips, first).withColumn("similarity", r6(F.col("similarity")))


@query()
def similarity_across_rates(spark: SparkSession, d: str) -> DataFrame:
    """Every clip against its own first half, taken to have half the rate, silence trimmed."""
    c = clips(spark, d)
    half = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get(F.col("data"), 2 * i))
    return c.select("clip_id", F.round(sp.spectral_similarity("data", F.lit(8000), half, F.lit(4000), F.lit(0.01)), 6).alias("similarity"))


@query(f"WITH {clips_sql()} SELECT clip_id, round(list_sum(list_transform(data, lambda x: x * x)), 6) + 0.0::DOUBLE AS energy, round(list_max(list_transform(data, lambda x: abs(x))), 6) AS peak, round(sqrt(list_sum(list_transform(data, lambda x: x * x)) / 64), 6) AS rms, round(20 * log10(1 / sqrt(list_sum(list_transform(data, lambda x: pow(x - trunc(x * 127) / 127::DOUBLE, 2))) / 64)), 4) AS psnr, 64::BIGINT AS padded FROM clips")
def signal_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Energy, peak, level, and the peak signal-to-noise ratio of a 7-bit rounding."""
    square = lambda f: F.aggregate(F.transform("data", f), F.lit(0.0), lambda s, x: s + x)
    coarse = lambda x: x - F.when(x < 0, F.ceil(x * 127)).otherwise(F.floor(x * 127)) / F.lit(127.0)
    return clips(spark, d).select(
        "clip_id", r6(square(lambda x: x * x)).alias("energy"), r6(F.array_max(F.transform("data", lambda x: F.abs(x)))).alias("peak"),
        r6(F.sqrt(square(lambda x: x * x) / 64)).alias("rms"), F.round(20 * F.log10(1 / F.sqrt(square(lambda x: F.pow(coarse(x), F.lit(2.0))) / 64)), 4).alias("psnr"),
        F.size(sp.pad_pow2(F.col("data"))).cast("long").alias("padded"),
    )
