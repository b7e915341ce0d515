"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

Rows lie in logical partitions. How many rows each partition sends to each column (a shard is a run of equal
columns) is drawn first: a uniformly random permutation of all rows would give a matrix whose rows are
multivariate hypergeometric, so that law is drawn, row by row, from the partition sizes alone. Each partition then
permutes its own rows and deals them out by its row of the matrix, rows are exchanged by column, and each column
permutes what it got. Every permutation of all rows is equally likely (up to the hash that stands for randomness),
sizes are exact, and no task sees more than one partition or one column. Equal rows are told apart by a number first.

A hypergeometric number is drawn exactly, within SQL expressions, by rejection from a scaled ratio of uniforms
(Stadlober's HRUA scheme): a candidate is accepted by the exact log-probability ratio to the mode.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, numbered, seeded


@dataclass(frozen=True)
class Sharding:
    """shards: how many; columns: pieces of equal size that make up a shard; partitions: logical source partitions, at least, and part_rows: rows of one, about, where there are more; tries: candidates per draw (all are rejected with probability below 1e-20)."""

    shards: int = 24
    columns: int = 8
    partitions: int = 128
    part_rows: int = 1_000_000
    seed: str = "shard-1"
    tries: int = 64

    @property
    def width(self) -> int:
        return self.shards * self.columns


def uniform(seed: str, *at: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the arguments only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *at), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def log_factorial(n: Column) -> Column:
    """ln n!: by a table below 16 and Stirling's series from there (its error is below 1e-15)."""
    table = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(16)])
    x = n.cast("double") + 1.0
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.element_at(table, n.cast("int") + 1)).otherwise((x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + series)


def hypergeometric(good: Column, bad: Column, drawn: Column, seed: str, at: Column, tries: int) -> Column:
    """How many of ``drawn`` items, taken without replacement from good + bad ones, are good.

    The smaller of good and bad, and the smaller of drawn and the rest, keep the numbers small; symmetry gives the
    result back. With a deviation d, candidates are floor(mean + d * (v - 0.5) / u) for uniform u, v, accepted if
    2 ln u is at most the log ratio of their probability to the mode's.
    """
    total = good + bad

    def step(x: Column) -> Column:
        m, lo, hi, n = x["m"], x["lo"], x["hi"], x["n"]
        p = lo / n
        spread = F.sqrt((n - m).cast("double") * m * p * (1 - p) / F.greatest(n - 1, F.lit(1)) + 0.5)
        mode = F.floor((m + 1).cast("double") * (lo + 1) / (n + 2)).cast("bigint")
        shape = lambda k: log_factorial(k) + log_factorial(lo - k) + log_factorial(m - k) + log_factorial(hi - m + k)
        width = F.lit(2 * math.sqrt(2 / math.e)) * spread + F.lit(3 - 2 * math.sqrt(3 / math.e))

        def search(c: Column) -> Column:
            def judged(d: Column) -> Column:
                k = F.floor(d["value"]).cast("bigint")
                possible = (d["value"] >= 0) & (k <= F.least(lo, m))
                accepted = F.when(possible, 2 * F.log(d["u"]) <= c["peak"] - shape(k)).otherwise(F.lit(False))
                return F.when(accepted, k).otherwise(F.lit(-1).cast("bigint"))

            def trial(state: Column, t: Column) -> Column:
                u, v = uniform(seed, at, t, F.lit(1)), uniform(seed, at, t, F.lit(2))
                candidate = bind(u, lambda w: F.struct(w.alias("u"), (c["mean"] + c["width"] * (v - 0.5) / w).alias("value")))
                return F.when(state >= 0, state).otherwise(bind(candidate, judged))

            return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.lit(-1).cast("bigint"), trial, lambda k: F.when(k >= 0, k).otherwise(c["mode"]))

        constants = F.struct((m * p + 0.5).alias("mean"), width.alias("width"), mode.alias("mode"), shape(mode).alias("peak"))
        return F.when((m == 0) | (lo == 0), F.lit(0).cast("bigint")).otherwise(bind(constants, search))

    smaller = F.struct(F.least(drawn, total - drawn).alias("m"), F.least(good, bad).alias("lo"), F.greatest(good, bad).alias("hi"), total.alias("n"))
    few = bind(bind(smaller, step), lambda k: F.when(good > bad, F.least(drawn, total - drawn) - k).otherwise(k))
    return bind(few, lambda k: F.when(drawn > total - drawn, good - k).otherwise(k))


def column_sizes(total: Column, s: Sharding) -> Column:
    """Rows of each column: shards differ by one row at most, the larger ones first, and so do the columns of a shard."""
    shard = lambda i: F.floor(total / s.shards) + F.when(F.floor(i / s.columns) < total % s.shards, 1).otherwise(0)
    size = lambda i: F.floor(shard(i) / s.columns) + F.when(i % s.columns < shard(i) % s.columns, 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0), F.lit(s.width - 1)), lambda i: size(i).cast("bigint"))


def _dealt(parts: Column, sizes: Column, s: Sharding, base: int) -> Column:
    """parts: array of (part, n); sizes: rows of each column, as many in all. An array of (part, n, sends). base: what sets these draws apart from others."""
    whole = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def row(state: Column, p: Column) -> Column:
        """Deal the n rows of p over what the columns can still take, column by column."""

        def cell(c: Column, j: Column) -> Column:
            room = F.element_at(state["room"], j)
            draw = hypergeometric(room, c["rest"] - room, c["left"], s.seed, (p["part"] + F.lit(base)) * s.width + j, s.tries)
            after = lambda k: F.struct(F.concat(c["sends"], F.array(k)).alias("sends"), (c["left"] - k).alias("left"), (c["rest"] - room).alias("rest"))
            return bind(draw, after)

        start = F.struct(F.array().cast("array<bigint>").alias("sends"), p["n"].alias("left"), whole(state["room"]).alias("rest"))
        dealt = F.aggregate(F.sequence(F.lit(1), F.lit(s.width)), start, cell, lambda c: c["sends"])
        return F.element_at(
            F.transform(
                F.array(dealt),
                lambda d: F.struct(
                    F.zip_with(state["room"], d, lambda a, b: a - b).alias("room"),
                    F.concat(state["rows"], F.array(F.struct(p["part"].alias("part"), p["n"].alias("n"), d.alias("sends")))).alias("rows"),
                ),
            ),
            1,
        )

    start = F.struct(sizes.alias("room"), F.array().cast("array<struct<part:int,n:bigint,sends:array<bigint>>>").alias("rows"))
    return F.aggregate(parts, start, row, lambda x: x["rows"])


def communication_matrix(sizes: DataFrame, s: Sharding) -> DataFrame:
    """sizes: (part, n). One row per partition: part, n, total, sends (array: rows to each column).

    Drawn in two levels: first for groups of partitions, in one row; then, in a task for each group, for its partitions,
    whose columns have what the group sends. That is the same law, and both levels have about the root of as many rows.
    """
    per_group = math.ceil(math.sqrt(s.partitions))
    grouped = sizes.groupBy(F.floor(F.col("part") / per_group).cast("int").alias("group")).agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("group").alias("part"), "n")))
    one = grouped.groupBy().agg(listed.alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))
    top = one.select("total", F.explode(_dealt(F.col("groups"), column_sizes(F.col("total"), s), s, s.partitions)).alias("g")).select("total", F.col("g.part").alias("group"), "g.sends")
    return grouped.join(top, "group").select("total", F.explode(_dealt(F.col("parts"), F.col("sends"), s, 0)).alias("x")).select("x.part", "x.n", "total", "x.sends")


def _sums(a: Column) -> Column:
    """Running sums, starting with 0."""
    return F.aggregate(a, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def shard_rows(rows: DataFrame, key: list[str], s: Sharding = Sharding()) -> DataFrame:
    """``rows`` with __shard (0 to shards - 1) and __slot (gapless from 0 in each shard), a uniform random shuffle.

    Shard sizes differ by one at most. ``key`` names the columns that tell rows apart; rows equal in all of them would
    lie side by side (number them before, as shard_documents does). Nulls in the key are values like any other. With fewer rows than shards the
    last shards stay empty; an empty table gives an empty one. Columns named like the two results are replaced.
    """
    cols = [F.col(f"`{c}`") for c in key]
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("__shard", "__slot")]
    part = F.pmod(F.xxhash64(F.lit(s.seed), *cols), F.lit(s.partitions)).cast("int")
    slim = rows.select(*keep, part.alias("__part"), seeded(f"{s.seed}-local", *cols).alias("__first"), seeded(f"{s.seed}-again", *cols).alias("__second")).repartition("__part")
    sizes = slim.groupBy(F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(sizes, s).select(
        F.col("part").alias("__part"), "total", _sums("sends").alias("ends"), F.transform(F.sequence(F.lit(0), F.lit(s.shards)), lambda i: F.element_at(_sums("sends"), i * s.columns + 1)).alias("shard_ends")
    )
    local = Window.partitionBy("__part").orderBy("__first", *cols)
    placed = slim.withColumn("__rank", F.row_number().over(local) - 1).join(matrix, "__part")
    shard = F.size(F.filter("shard_ends", lambda e: e <= F.col("__rank"))) - 1
    within = F.size(F.filter(F.slice("ends", F.col("__shard") * s.columns + 1, s.columns), lambda e: e <= F.col("__rank"))) - 1
    dealt = placed.withColumn("__shard", shard.cast("int")).withColumn("__column", within.cast("int"))
    again = Window.partitionBy("__shard", "__column").orderBy("__second", *cols)
    size = F.floor(F.col("total") / s.shards) + F.when(F.col("__shard") < F.col("total") % s.shards, 1).otherwise(0)
    before = F.floor(size / s.columns) * F.col("__column") + F.least(F.col("__column"), size % s.columns)
    return (
        dealt.select(*keep, "__shard", "__column", "total", "__second")
        .withColumn("__slot", (before + F.row_number().over(again) - 1).cast("long"))
        .select(*keep, "__shard", "__slot")
    )


def shard_documents(docs: DataFrame, s: Sharding = Sharding()) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8; null text has none), text_crc32, law 'rows', shard, slot, grown_shard (null under this law).

    Repeated rows are numbered and dealt like any others, so they lie anywhere. A null id is a value like any other; a
    null or empty text has size 8. The text itself, however long, is read once and not exchanged; other columns are
    not read, whatever they are called. An empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    s = replace(s, partitions=max(s.partitions, -(-docs.count() // s.part_rows)))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shard_rows(numbered(slim, "copy"), ["doc_id", "text_crc32", "size", "copy"], s)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
