"""Connected components over a table of links, by alternating large-star and small-star steps.

Each step is an aggregate (one minimum per node, combined before the shuffle) and a join on the node.  Minima of few
enough links are sent to all executors; those of more are written first, so that the join has a shuffle of its own on
either side and Spark splits a node with very many neighbours.  No group is collected; every round is written as a table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm.common import materialise


#: Links up to which the minima of their nodes (at most twice as many rows of two numbers) are broadcast.
BROADCAST_LINKS = 250_000


def _shared(least: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(least) if few else materialise(least, "least")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _shared(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), few)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = _shared(edges.groupBy("u").agg(F.min("v").alias("m")), few)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    Links of a node with itself or with null are ignored; no links give an empty table.
    """
    x, y = F.col(a), F.col(b)
    edges = links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges, before = materialise(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        few = now["n"] <= BROADCAST_LINKS
        edges = materialise(_small_star(_large_star(edges, few), few), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def local_roots(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row the least id of its part, for links between rows ``x`` and ``y`` of one small group."""
    root = ids.copy()
    while True:
        before, least = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        if (root == before).all():
            return root
