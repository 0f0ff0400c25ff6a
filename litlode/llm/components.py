"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle), a join of that minimum
back to the edges and a distinct. Spark splits a hot node of that join at run time only where
both sides come straight from a shuffle, so the join has a second key, told from the first, by
which the minimum isn't dealt yet.
No node's neighbours are ever gathered in one place and nothing goes to the driver but
two numbers that tell whether a round has changed the edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.common import cut


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges(a, b)`` with the ``m`` of their a."""
    again = F.xxhash64("a").alias("again")
    return edges.select("a", "b", again).join(least.select("a", "m", again), ["a", "again"]).drop("again")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b; each node points its larger (or smaller) neighbours at the least one."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = _with_least(edges, least).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node it reaches.

    Nulls and self-loops are ignored; repeated and reversed edges count once. An empty edge
    list gives an empty result. ``max_rounds`` guards against a defect only: rounds needed
    grow with the logarithm of a component's size, and reaching it raises.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges, was = cut(edges), None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if was == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        was = now
    raise RuntimeError("connected components did not settle")


def merge_pairs(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find over arrays: join i[k] with j[k]; returns the parents, fully compressed."""
    while True:
        p, q = parent[i], parent[j]
        differ = p != q
        if not differ.any():
            return parent
        i, j, p, q = i[differ], j[differ], p[differ], q[differ]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
