"""Connected components by alternating large-star and small-star rounds.

Edges are two long columns. Every round is a few shuffles on node ids with
map-side combined minima; the minima are written before they are joined, so
that AQE can split the rows of a hub. Rounds end when the edges no longer
change, after about log(nodes) of them. Nothing is collected but a count and a
checksum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it within these edges), nodes that are their own smallest left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)      # the old root hears of the new one
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = new


def _minima(pairs: DataFrame) -> DataFrame:
    return staged(pairs.groupBy("u").agg(F.min("v").alias("_m")), "cc-minima").withColumnRenamed("u", "_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both)
    return (both.join(low, F.col("u") == F.col("_u")).where("v > u")
            .select(F.col("v").alias("u"), F.least("_m", "_u").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges hold u > v."""
    low = _minima(edges)
    joined = edges.join(low, F.col("u") == F.col("_u"))
    return (joined.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .unionByName(low.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge but the roots themselves; the
    root is the smallest node of the component. ``edges``: two long columns."""
    a, b = edges.columns[:2]
    edges = (edges.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = staged(edges, "cc-edges")
    mark = _mark(edges)
    while mark[0]:
        edges = staged(_small_star(staged(_large_star(edges), "cc-large")), "cc-small")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
