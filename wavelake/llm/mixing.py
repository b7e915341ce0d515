"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's documents lie on a token line of their own, in a seeded random order, and the line is cut into
blocks of equal size. Seats (one block each) go to the sources by the highest quotients target / (2k + 1). The
method never takes a seat back as the house grows, so the k-th stretch of seats, in the order of award, is the
quota of output shard k: integers for each shard that sum to the apportionment of the whole. Source s fills its
j-th seat, and with it a place in the seat's shard, with the block at place j modulo its number of blocks, in a
seeded order of its blocks; a source that is to be repeated is thus passed over again before any block is taken a
third time.

One size of block would leave small sources without a seat. So a source whose target has under SEATS blocks gets
blocks of half, a quarter, ... of the size, and the sources of one size of block share a house of their own, which
their targets fill. A source misses its target by about a block, so by 1 / SEATS of it at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, durable, free_name, n_words, seeded


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix.

    block_tokens: smallest block of large sources; max_blocks: blocks of the whole mix beyond which these grow (so
    the tables of seats and blocks stay within max_blocks and some hundred per source, whatever the input; what
    sources miss their targets by is bounded by SEATS alone); bucket_rows: documents, about, of a stretch of a
    source's token line that is ordered in one task; repeats: most times that anything is taken; shards: output
    shards that get quotas; weights: cycled over the sources in order.
    """

    seed: str = "mix-1"
    block_tokens: int = 16
    max_blocks: int = 65536
    bucket_rows: int = 20_000
    repeats: int = 3
    shards: int = 64
    weights: tuple[int, ...] = (1, 2, 3)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds weight and target.

    Targets share out all words by weight, none above ``repeats`` times its source's size; what is cut off is
    shared by weight among the others until none is above. Sources are ordered by cap per weight; with the k
    tightest at their cap, level k is what is left per unit of weight, and the first k whose next source stays
    below its cap is the fixed point of the resharing.
    """
    everything = Window.partitionBy()
    tight = Window.partitionBy().orderBy("per_weight", "source_no")
    cycle = F.array(*[F.lit(w) for w in mix.weights])
    order = Window.partitionBy().orderBy("source_null", "source_key")
    ranked = (
        sizes.withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(mix.weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * mix.repeats)
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.sum("cap").over(tight) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.sum("weight").over(tight) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    level = F.min(F.when(F.col("level") <= F.col("per_weight"), F.struct("per_weight", "source_no", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))))


def _line(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, size, source key, place in the seeded order and bucket, a durable table of a few bytes a row: texts are read and counted once. Buckets are stretches of places, so their number changes no order."""
    place = seeded(mix.seed, F.col("doc_id"))
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    line = durable(slim.select("doc_id", "size", F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("source_null"), place.alias("place")))
    bits = min(24, max(9, (line.count() // mix.bucket_rows).bit_length()))  # every row of a bucket is joined with its blocks, so there are not too few
    return line.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 6), 16, 10).cast("int"), 24 - bits))


#: Blocks that a source's target has at least, but for blocks of one word; and how often a block may be halved for that.
SEATS, HALVINGS = 64, 48


def _block_size(mix: Mix) -> Column:
    """Of a source, from its target and all words: the same for all but small sources."""
    whole = F.greatest(F.lit(mix.block_tokens), F.ceil(F.col("total") / mix.max_blocks)).cast("long")
    enough = lambda j: F.col("target") * F.pow(F.lit(2.0), j) >= SEATS * whole
    halved = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(0), F.lit(HALVINGS)), enough), F.lit(1)), F.lit(HALVINGS))
    return F.greatest(F.lit(1), F.floor(whole / F.pow(F.lit(2.0), halved))).cast("long")


KEY = ["source_key", "source_null"]


def plan(line: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(buckets, seats). buckets: source, bucket, first word on the source's line, source_size, target, block size.

    seats: source, k (which of its seats), block (the one that fills it), shard. Both are bounded by parameters
    and the number of sources, not by the number of documents.
    """
    cells = line.groupBy(*KEY, "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = targets(cells.groupBy(*KEY).agg(F.sum("words").alias("source_size"), F.sum("n").alias("source_docs")), mix)
    sources = (
        sources.withColumn("block_size", _block_size(mix))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_size")).cast("long"))
        .select(*KEY, "source_no", "source_size", "source_docs", "target", "total", "block_size", "blocks")
    )
    before = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = cells.withColumn("first", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("n")
    buckets = spans.join(sources, KEY)
    # No source can be awarded more seats than its target's share rounded up by a margin, nor more than its cap.
    house = F.round(F.sum("target").over(Window.partitionBy("block_size")) / F.col("block_size")).cast("long")
    most = F.least(F.ceil(F.col("target") / F.col("block_size")) + 2, F.col("blocks") * mix.repeats).cast("long")
    awarded = Window.partitionBy("block_size").orderBy(F.desc("quotient"), "source_no")
    seats = (
        sources.withColumn("house", house)
        .filter("blocks > 0")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
        .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
        .withColumn("award", F.row_number().over(awarded) - 1)
        .filter("award < greatest(house, 1)")
        .withColumn("shard", F.floor(F.col("award") * mix.shards / F.greatest("house", F.lit(1))).cast("int"))
        .withColumn("place_no", F.col("k") % F.col("blocks"))
        .select(*KEY, "source_no", "k", "place_no", "shard")
    )
    shuffled = Window.partitionBy(*KEY).orderBy("order", "block")
    blocks = (
        sources.filter("blocks > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("order", seeded(mix.seed, F.lit("block"), F.col("source_no"), F.col("block")))
        .select(*KEY, "block", (F.row_number().over(shuffled) - 1).cast("long").alias("place_no"))
    )
    return buckets, seats.join(blocks, [*KEY, "place_no"]).drop("place_no")


def _between(at: Column) -> Column:
    """Words taken from the bucket's first block up to line position ``at``; takes: how often each block is taken, from first_block on."""
    n = (F.floor(at / F.col("block_size")) - F.col("first_block")).cast("int")
    whole = F.when(n > 0, F.element_at("taken_before", n)).otherwise(F.lit(0))
    part = (at % F.col("block_size")) * F.coalesce(F.try_element_at("takes", n + 1), F.lit(0))
    return whole * F.col("block_size") + part


def _mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of _line with source_size, source_docs, target, block_size and taken."""
    line = _line(docs, mix)
    buckets, seats = plan(line, mix)
    takes = seats.groupBy(*KEY, "block").agg(F.count("k").alias("takes"), F.sort_array(F.collect_set("shard")).alias("shards"))
    # Each bucket needs the blocks that its stretch of the line touches.
    touched = buckets.withColumn("first_block", F.floor(F.col("first") / F.col("block_size")).cast("long")).withColumn(
        "block", F.explode(F.sequence(F.col("first_block"), F.floor((F.col("first") + F.col("words")) / F.col("block_size")).cast("long")))
    )
    listed = F.array_sort(F.collect_list(F.struct("block", F.coalesce("takes", F.lit(0)).alias("takes"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))))
    cells = (
        touched.join(takes, [*KEY, "block"], "left")
        .groupBy(*KEY, "bucket", "first", "first_block", "block_size", "source_size", "source_docs", "target")
        .agg(listed.alias("listed"))
        .withColumns({"takes": F.col("listed.takes"), "shards": F.col("listed.shards")})
        .drop("listed")
        .withColumn(
            "taken_before",
            F.aggregate("takes", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))),
        )
    )
    ordered = Window.partitionBy(*KEY, "bucket").orderBy("place", "doc_id", "size")
    placed = (
        line.join(cells, [*KEY, "bucket"])
        .withColumn("end", F.col("first") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("begin", F.col("end") - F.col("size"))
    )
    return placed.withColumn("taken", (_between(F.col("end")) - _between(F.col("begin"))).cast("long"))


def _shards() -> Column:
    """The output shards that hold words of a document, joined by ','; empty if none does."""
    first = (F.floor(F.col("begin") / F.col("block_size")) - F.col("first_block") + 1).cast("int")
    last = (F.floor((F.col("end") - 1) / F.col("block_size")) - F.col("first_block") + 1).cast("int")
    touched = F.when(F.col("size") > 0, F.array_sort(F.array_distinct(F.flatten(F.slice("shards", first, last - first + 1)))))
    return F.coalesce(F.array_join(touched, ","), F.lit(""))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, shards.

    size counts words; taken counts the words that the mix takes from the document, repeats included, and is at
    most ``repeats`` times its size; shards are the numbers of the output shards that they go to, joined by ','.
    A very long text lies on many blocks, of which any may be taken. Null and empty texts have size 0 and nothing is taken from them. A null
    source is a source of its own, ordered last. Documents with equal ids are told apart by size only, so equal
    rows may swap what they are given, not change it. Only doc_id, source and text are read. An empty table, or
    one without words, gives no seats.
    """
    return _mixed(docs, mix).select("doc_id", F.when(~F.col("source_null"), F.col("source_key")).alias("source"), "size", "source_size", "target", "taken", _shards().alias("shards"))


def shard_quotas(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Blocks that each output shard gets from each source: shard, source, quota."""
    _, seats = plan(_line(docs, mix), mix)
    return seats.groupBy("shard", *KEY).agg(F.count("k").alias("quota")).select("shard", F.when(~F.col("source_null"), F.col("source_key")).alias("source"), "quota")


#: Documents, about, whose whole numbers of copies are settled together.
SETTLED = 2048


def mixed_corpus(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as whole documents: each row of ``docs``, with its columns, none, one or several times.

    A document is to come taken / size times. Within pieces of about SETTLED documents of a source, dealt by a hash,
    the largest are settled first: each comes a whole number of times, at random one of the two nearest, and what it
    takes too much or too little is made good by those after it. So a piece misses its words by about its smallest
    documents. Rows with equal doc_ids share what all of them are given; documents without words are left out; a
    null source is a source; an empty table gives an empty one. Other columns may have any names.
    """
    piece = F.conv(F.substring("place", 9, 8), 16, 10).cast("long") % F.ceil(F.col("source_docs") / SETTLED)
    chance = F.conv(F.substring("place", 17, 8), 16, 10).cast("double") / 2.0**32
    one = F.struct((-F.col("size")).alias("order"), "place", "doc_id", "size", "taken", chance.alias("chance"))
    pieces = _mixed(docs, mix).filter("size > 0").groupBy(*KEY, piece.alias("piece")).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def settle(state: Column, x: Column) -> Column:
        wanted = (state["owed"] + x["taken"]) / x["size"]
        times = F.least(F.greatest(F.floor(wanted + x["chance"]), F.lit(0)), F.lit(mix.repeats)).cast("int")
        after = lambda t: F.struct((state["owed"] + x["taken"] - t * x["size"]).cast("double").alias("owed"), F.concat(state["times"], F.array(t)).alias("times"))
        return bind(times, after)

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("times"))
    settled = pieces.select(F.explode(F.arrays_zip(F.col("all.doc_id").alias("doc_id"), F.aggregate("all", start, settle, lambda x: x["times"]).alias("times"))).alias("x"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N"))
    id_, times_, copy = (free_name(docs, x) for x in ("__mix_id", "__times", "__copy"))
    times = settled.select("x.*").groupBy(key.alias(id_)).agg(F.round(F.avg("times")).cast("int").alias(times_)).filter(F.col(times_) > 0)
    several = docs.withColumn(id_, key).join(times, id_).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times_))))
    return several.filter(n_words(F.col("text")) > 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sql(mix: Mix = Mix()) -> str:
    """DuckDB SQL for mix_documents over documents, written from the definition: one line, one list of seats."""
    rounds = """
lv AS (SELECT *, sum(source_size) OVER () AS total, 3.0::DOUBLE * source_size AS cap FROM src),
ord AS (SELECT *, cap / weight AS pw, sum(cap) OVER w - cap AS capped, sum(weight) OVER () - sum(weight) OVER w + weight AS ow FROM lv WINDOW w AS (ORDER BY cap / weight, no)),
lam AS (SELECT max(l) AS lam FROM (SELECT (total - capped) / ow AS l FROM ord WHERE (total - capped) / ow <= pw ORDER BY pw, no LIMIT 1)),
tg AS (SELECT *, least(cap, coalesce(weight * lam, cap)) AS target FROM lv, lam)"""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('{mix.seed}|' || coalesce(doc_id::VARCHAR, '\N')) AS place FROM documents),
src AS (SELECT *, [{", ".join(map(str, mix.weights))}][(no % {len(mix.weights)} + 1)::INT] AS weight FROM
  (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source)),
{rounds},
b0 AS (SELECT *, greatest({mix.block_tokens}, ceil(total / {mix.max_blocks}))::BIGINT AS b0 FROM tg),
bl AS (SELECT *, greatest(1, floor(b0 / pow(2.0, coalesce(list_filter(range(0, {HALVINGS + 1}), lambda j: target * pow(2.0, j) >= {SEATS} * b0)[1], {HALVINGS}))))::BIGINT AS b FROM b0),
bs AS (SELECT *, ceil(source_size / b)::BIGINT AS nb, round(sum(target) OVER (PARTITION BY b) / b)::BIGINT AS house FROM bl),
cand AS (SELECT *, unnest(range(0, least(ceil(target / b) + 2, nb * {mix.repeats})::BIGINT)) AS k FROM bs),
aw AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY target / (2 * k + 1) DESC, no) - 1 AS award FROM cand WHERE nb > 0),
seat AS (SELECT *, (award * {mix.shards}) // greatest(house, 1) AS shard FROM aw WHERE award < greatest(house, 1)),
blk AS (SELECT no, block, row_number() OVER (PARTITION BY no ORDER BY md5('{mix.seed}|block|' || no || '|' || block), block) - 1 AS p FROM (SELECT no, unnest(range(0, nb)) AS block FROM bs)),
taken AS (SELECT seat.no, blk.block, count(*) AS n, list(shard) AS sh FROM seat JOIN blk ON blk.no = seat.no AND blk.p = seat.k % seat.nb GROUP BY 1, 2),
line AS (SELECT doc_id, size, source_size, target, bs.no, b, sum(size) OVER w AS e FROM d JOIN bs ON bs.source IS NOT DISTINCT FROM d.source
  WINDOW w AS (PARTITION BY bs.no ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, row_number() OVER () AS r, unnest(range((e - size)::BIGINT // b, e::BIGINT // b + 1)) AS block FROM line)
SELECT doc_id, size, source_size, target, sum(coalesce(n, 0) * greatest(0, least(e, (cut.block + 1) * b) - greatest(e - size, cut.block * b)))::BIGINT AS taken,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(sh) FILTER (size > 0 AND cut.block * b < e)))), ','), '') AS shards
FROM cut LEFT JOIN taken ON taken.no = cut.no AND taken.block = cut.block GROUP BY doc_id, size, source_size, target, cut.no, e"""
