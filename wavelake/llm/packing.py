"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Bins are ordered by the room that is left. Each carries bitmaps of the sources and of the duplicate clusters that it
holds; a piece goes to the first bin from the successor of its size on (the tightest) whose bitmaps allow it, else to
a new bin. Pieces come largest first. Documents are dealt by a hash into packs of bounded size, which are packed
independently of each other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, n_words, numbered, with_id_of


@dataclass(frozen=True)
class Packing:
    """capacity: words a bin holds; pack: documents packed together, about; per_source: documents of a source that may share a bin."""

    capacity: int = 2048
    pack: int = 4096
    per_source: int = 2


def best_fit(sizes: Sequence[int], sources: Sequence[object], clusters: Sequence[object], p: Packing) -> list[int]:
    """The bin of each piece, in the order given. All sizes are from 1 to p.capacity."""
    bits: dict[object, int] = {}
    bit_of = lambda kind, x: 1 << bits.setdefault((kind, x), len(bits))
    order: list[tuple[int, int]] = []  # (room left, bin), sorted
    planes: list[list[int]] = []  # per bin: plane k has the sources that it holds more than k times
    held: list[int] = []  # per bin: its clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = bit_of("source", source), bit_of("cluster", cluster)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (planes[order[at][1]][-1] & s or held[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = p.capacity, len(held)
            planes.append([0] * p.per_source)
            held.append(0)
        k = next(k for k, plane in enumerate(planes[b]) if not plane & s)
        planes[b][k] |= s
        held[b] |= c
        if room > size:  # a full bin is never looked at again
            insort(order, (room - size, b))
        out.append(b)
    return out


PACKED = "piece int, start long, words long, pack int, bin int, offset long"


def pack_documents(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, PACKED.

    A document of more than ``capacity`` words is cut into full pieces and a rest; start is a piece's first word in
    the document, offset its place in the bin, and (pack, bin) names the bin. No bin holds two documents of equal
    text, nor more than per_source of one source; a null source is a source of its own. Documents without words
    (null, empty) need no room: they have one row with no bin. Repeated rows are packed as often as they come; they
    are counted first and spread over packs by number, and rows without an id by their text, so no id or text is a
    hot pack. Of bins with equal room the older one is taken, of pieces of equal size the one with the smaller id (as
    text). Only doc_id, source and text are read, whatever other columns are called; an empty table gives an empty one.
    """
    packs = max(1, -(-docs.count() // p.pack))
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(id_text(docs).alias("doc_id"), "source", n_words(F.col("text")).alias("words"), F.xxhash64(text).alias("cluster"))
    salt = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("cluster")), F.when(F.col("copy") > 0, F.col("copy")))
    items = numbered(slim, "copy").withColumn("pack", F.pmod(salt, F.lit(packs)).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        group = group.sort_values(["doc_id", "cluster", "copy"], kind="stable")
        for doc, source, words, cluster in zip(group.doc_id, group.source, group.words, group.cluster, strict=True):
            cuts = range(0, int(words), p.capacity) if words else [0]
            rows.extend((doc, i, at, min(p.capacity, int(words) - at), None if pd.isna(source) else source, cluster) for i, at in enumerate(cuts))
        pieces = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "words", "source", "cluster"]).sort_values("words", ascending=False, kind="stable")
        real = pieces[pieces.words > 0]
        bins = pd.Series(best_fit(real.words.tolist(), real.source.tolist(), real.cluster.tolist(), p), index=real.index, dtype="Int64")
        pieces["bin"] = bins.reindex(pieces.index).astype("Int32")
        pieces["offset"] = (pieces.groupby("bin").words.cumsum() - pieces.words).astype("Int64")
        pieces["pack"] = group.pack.iloc[0]
        return pieces[["doc_id", *[x.split()[0] for x in PACKED.split(", ")]]]

    return with_id_of(items.groupBy("pack").applyInPandas(pack, f"doc_id string, {PACKED}"), docs)
