"""Queries that make signals: generators and window functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import apodize
from ..operators import generators as g
from ..registry import query

RATE = 8000
TWO_PI = repr(2 * math.pi)


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE AS sample"


def _made(name: str, df, sql: str) -> None:  # noqa: ANN001
    query(sql, name)(lambda spark, d: df(spark).select("frame", (F.round("sample", 6) + F.lit(0.0)).alias("sample")))


def _angle(freq: float) -> str:
    return f"({2 * math.pi * freq / RATE!r}::DOUBLE * frame)"


_made("generate_sine", lambda spark: g.sine(spark, 440.0, 0.25, RATE), f"SELECT range AS frame, {_r('sin(' + _angle(440.0).replace('frame', 'range') + ')')} FROM range(2000)")
_made(
    "generate_chord", lambda spark: g.chord(spark, [261.63, 329.63, 392.0], 0.25, RATE),
    f"SELECT frame, {_r('(sin(' + _angle(261.63) + ') + sin(' + _angle(329.63) + ') + sin(' + _angle(392.0) + ')) / 3')} FROM (SELECT range AS frame FROM range(2000))",
)
_made(
    "generate_sweep", lambda spark: g.sweep(spark, 100.0, 2000.0, 0.25, RATE),
    f"SELECT frame, {_r('sin(phase)')} FROM (SELECT range AS frame, sum({TWO_PI}::DOUBLE * 100.0::DOUBLE * exp({math.log(20.0)!r}::DOUBLE * range / 2000) / {RATE}) OVER (ORDER BY range) AS phase FROM range(2000))",
)
_made(
    "generate_beep", lambda spark: g.beep(spark, 880.0, 0.25, RATE),
    f"SELECT frame, {_r('0.4::DOUBLE * sin(' + _angle(880.0) + ') * CASE WHEN frame * 125000 < 220000000 THEN 1.0::DOUBLE WHEN frame * 125000 < 250000000 THEN 1 - (frame * 125000 - 220000000) / 30000000::DOUBLE ELSE 0.0::DOUBLE END')} FROM (SELECT range AS frame FROM range(2000))",
)
_made("generate_pluck", lambda spark: g.pluck(spark, 220.0, 0.25, RATE), f"SELECT frame, {_r('0.4::DOUBLE * exp(-3.0::DOUBLE * frame / 2000) * sin(' + _angle(220.0) + ')')} FROM (SELECT range AS frame FROM range(2000))")

_NOTE = """CASE WHEN i < attack THEN i / attack::DOUBLE WHEN i < attack + decay THEN 1 + (i - attack) / decay::DOUBLE * -0.35::DOUBLE
 WHEN i < n - release THEN 0.65::DOUBLE WHEN release > 1 THEN 0.65::DOUBLE * (n - 1 - i) / (release - 1) ELSE 0 END"""
_SHAPED = """shaped AS (SELECT *, greatest(least(480, (n - attack - release) // 2), 0) AS decay FROM (SELECT *, greatest(least(120, n // 4), 1) AS attack, greatest(least(640, n // 3), 1) AS release FROM notes))"""


def _tune_sql(notes: list[tuple[float, float]]) -> str:
    rows = ", ".join(f"({k}, {f!r}::DOUBLE, {int(s * RATE)})" for k, (f, s) in enumerate(notes))
    return f"""WITH notes AS (SELECT *, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS begin_at FROM (VALUES {rows}) t(k, f, n)), {_SHAPED},
one AS (SELECT *, unnest(range(0, n)) AS i FROM shaped) SELECT begin_at + i AS frame, {_r(f"0.4::DOUBLE * ({_NOTE}) * sin({TWO_PI}::DOUBLE * f / {RATE} * i)")} FROM one"""


_made("generate_note", lambda spark: g.melody(spark, [(440.0, 0.25)], RATE), _tune_sql([(440.0, 0.25)]))
_made("generate_melody", lambda spark: g.melody(spark, g.MARY, RATE), _tune_sql(g.MARY))


@query()
def generate_noise(spark: SparkSession, d: str) -> DataFrame:
    """White and pink noise: shape and statistics only, the random source differs."""
    return g.white_noise(spark, 0.5, RATE, 7).withColumn("colour", F.lit("white")).unionByName(g.pink_noise(spark, 0.5, RATE, 7).withColumn("colour", F.lit("pink")))


def _cosines(kind: str, x: str) -> str:
    return " + ".join(f"{a * (-1) ** k!r}::DOUBLE * cos({2.0 * k * math.pi!r}::DOUBLE * {x})" for k, a in enumerate(apodize.COSINE_SUMS[kind]))


_L = 64
_C = "((n - 31.5::DOUBLE) / 31.5::DOUBLE)"
_RISE = "(0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * ({i}) / {n}))"
_WINDOW_SQL = {k: _cosines(k, "n / 63.0::DOUBLE") for k in apodize.COSINE_SUMS} | {
    "rectangle": "1.0::DOUBLE",
    "bartlett": "CASE WHEN n <= 31 THEN 2.0::DOUBLE * n / 63 ELSE 2.0::DOUBLE - 2.0::DOUBLE * n / 63 END",
    "bartlett_hann": f"0.62::DOUBLE - 0.48::DOUBLE * abs(n / 63.0::DOUBLE - 0.5::DOUBLE) - 0.38::DOUBLE * cos({TWO_PI}::DOUBLE * n / 63)",
    "connes": f"pow(1 - {_C} * {_C}, 2)",
    "welch": f"1 - {_C} * {_C}",
    "gauss": f"exp(-0.5::DOUBLE * pow({_C} / 0.25::DOUBLE, 2))",
    "triangle": "CASE WHEN n + 1 <= 32 THEN 2.0::DOUBLE * (n + 1) / 65 ELSE 2.0::DOUBLE * (64 - n) / 65 END",
    "tukey": f"CASE WHEN n >= 48 THEN {_RISE.format(i='n - 48 + 15', n=15)} WHEN n <= 15 THEN {_RISE.format(i='n', n=15)} ELSE 1.0::DOUBLE END",
    "partial_tukey": f"CASE WHEN n < 16 THEN 0.0::DOUBLE WHEN n < 24 THEN {_RISE.format(i='n - 15', n=8)} WHEN n < 40 THEN 1.0::DOUBLE WHEN n < 48 THEN {_RISE.format(i='8 - (n - 40)', n=8)} ELSE 0.0::DOUBLE END",
    "punchout_tukey": f"CASE WHEN n < 4 THEN {_RISE.format(i='n + 1', n=4)} WHEN n < 12 THEN 1.0::DOUBLE WHEN n < 16 THEN {_RISE.format(i='4 - (n - 12)', n=4)} WHEN n < 48 THEN 0.0::DOUBLE WHEN n < 52 THEN {_RISE.format(i='n - 47', n=4)} WHEN n < 60 THEN 1.0::DOUBLE ELSE {_RISE.format(i='4 - (n - 60)', n=4)} END",
}


def _range(kind: str) -> dict[str, float]:
    return {"start": 0.25, "end": 0.75} if kind in ("partial_tukey", "punchout_tukey") else {}


@query("WITH r AS (SELECT range AS n FROM range(64)) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, n, round({v}, 6) + 0.0::DOUBLE AS weight FROM r" for k, v in _WINDOW_SQL.items()))
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    """All kinds at length 64."""
    n = F.col("id")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.round(apodize.window(k, n, _L, **_range(k)), 6) + F.lit(0.0)).alias("weight")) for k in apodize.KINDS])
    return spark.range(_L).select(n.alias("n"), F.explode(kinds).alias("w")).select("w.kind", "n", "w.weight")
