"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) integer edges -> (node, root) with the smallest node of each component as root.

    Alternates two steps until nothing changes: every larger neighbour of a node is hung on the
    node's smallest neighbour, then so are the smaller ones. The number of rounds is
    logarithmic in the size of a component. A node's minimum is a partial aggregate and its
    rows are joined back by an ordinary equi-join, so a hub does not meet in one task. Each
    round is written to the shared folder. Loops, repeated and null-ended edges are ignored;
    no edges give no rows. Nodes without edges do not appear.
    """
    cur = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 "edges")
    state = _state(cur)
    while state[0]:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = (both.join(low, "u").where("v > u and v <> m")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        hung = stored(hung, "edges")
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (hung.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        nxt = stored(nxt.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before, state, cur = state, _state(nxt), nxt
        if state == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
