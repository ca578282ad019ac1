"""Connected components of a graph of links, as a few rounds of joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` of BIGINT to ``(id, component)``: the smallest id reachable from each id that has an edge.

    Alternates the two star steps: every node's larger neighbours, then its smaller ones, are tied to the smallest
    node known. The edges never grow, every step is a grouped minimum (combined before the shuffle) and an equi-join
    whose large keys Spark can split, and each round ends in a checkpoint. Null ends and loops are dropped.
    """
    e = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpoint(small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct())
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1000003)).first())


class Forest:
    """Union-find over the rows of one tile; keeps what links join, not the links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            if not open_.any():
                return
            i, j = i[open_], j[open_]
            np.minimum.at(self.root, high[open_], low[open_])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return i, self.root[i]
