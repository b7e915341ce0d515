"""Connected components of a graph held in DataFrames, by alternating large-star and small-star steps.

In a large-star step every node hands its larger neighbours to the smallest node it knows; in a small-star step
it hands its smaller neighbours, and itself, to the smallest of them. Both keep components as they are, and they
end in stars whose centres are the components' smallest nodes (Kiveris et al., 2014). A step joins each edge with
one number per node, so no list of neighbours is ever gathered, and a node with very many edges is only a hot join
key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rounds after which something must be wrong: they grow with the logarithm of the longest path, if that.
MAX_ROUNDS = 50
#: Edges up to which one task holds them all (16 MB of numbers) and ends the work there; each round of the steps costs some jobs.
FEW_EDGES = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges in order, and the smallest node that each is linked with: of every edge the larger root is hung under the smaller one, then all paths are shortened."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b -> edges of one step, again with a > b, each once."""
    if large:
        seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = seen.join(least, seen["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        linked = edges.join(least, edges["a"] == least["n"])
        moved = linked.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(x.a.to_numpy(), x.b.to_numpy()) for x in batches if len(x)]
        if parts:
            node, root = roots_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pd.DataFrame({"node": node, "root": root})

    kind = dict(edges.dtypes)["a"]
    return durable(edges.coalesce(1).mapInPandas(ended, f"node {kind}, root {kind}"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), any order, repeats and loops allowed, of one ordered type. Returns (node, root): every node of
    an edge between different nodes, and the smallest node that it is linked with. Rows with a null are left out.

    Each round is cut off by a reliable checkpoint; the end is told by a count and a checksum of the edges. Edges that
    one task can hold, FEW_EDGES at most, are ended there; the result is the same.
    """
    now = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= FEW_EDGES:
        return _in_one_task(now)
    mark = None
    for _ in range(MAX_ROUNDS):
        now = durable(_star(_star(now, large=True), large=False))
        told = now.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if told == mark:
            break
        mark = told
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
