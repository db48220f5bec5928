"""Connected components of a graph given as edges, without any part of it on the driver.

Edges are contracted inside each partition first, then large-star and small-star steps alternate until every
node points at the smallest node it can reach. A star step is two aggregations and joins keyed by node; the
edge set never grows beyond one edge for each node and step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canloom.llm.common import materialize, scratch


class Forest:
    """Union-find over arbitrary integers, the smallest of a set as its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    u = [x for x in forest.up if forest.root(x) != x]
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([forest.root(x) for x in u], pa.int64())], ["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above u points at the smallest of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # written, so that both sides of the join are plain and Spark can split the edges of a hot node
    least = materialize(least, "least", narrow=True)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour below u, and u, point at the smallest of these neighbours (edges run downwards)."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
    return e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges(u, v) with the smallest node of its component."""
    e = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u > v")
    e = materialize(e.repartition("u").mapInArrow(_contract, "u long, v long"), "edges", narrow=True)
    mark = _mark(e)
    while mark[0]:
        with scratch(e.sparkSession):
            e = materialize(_small_star(_large_star(e)), "edges", result=True, narrow=True)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
