"""Connected components by alternating large-star and small-star steps.

A step sends a node's neighbours to the smallest of them; a number of rounds that grows with the logarithm of the longest path makes
every component a star around its smallest node. Nothing is joined by a component's name: a step joins edges by their own node, a
node that already points at its smallest neighbour needs no join, and the smallest neighbours are a saved table, so Spark may split
the edges of a crowded node between tasks.

Edges are made distinct, and grouped, in tasks whose number grows with that of the edges, so a task's memory doesn't.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.sources.saved import saved

#: Rounds after which it gives up with an error; a path of 2**40 nodes needs fewer.
MAX_ROUNDS = 60
#: Edges that one task makes distinct and groups, and nodes from which on a side of a join is hashed in shares, never sorted or broadcast.
TASK_EDGES, HASHED_NODES = 500_000, 200_000


def _dealt(edges: DataFrame, count: int) -> DataFrame:
    """``count`` ``edges`` by both nodes, so that a crowded node's are shared out."""
    return edges.repartition(math.ceil((count + 1) / TASK_EDGES), "u", "v")


def _lowest(edges: DataFrame, count: int) -> tuple[DataFrame, int]:
    """u and m, its smallest neighbour among those smaller than it, and how many u there are."""
    low = saved(_dealt(edges, count).groupBy("u").agg(F.min("v").alias("m")), "lowest")
    return low, low.count()


def _hashed(low: DataFrame, count: int) -> DataFrame:
    return low.hint("shuffle_hash") if count > HASHED_NODES else low


def _large(edges: DataFrame, count: int, low: DataFrame, nodes: int) -> DataFrame:
    """Each node's larger neighbours, sent to the smallest of the node and its neighbours. ``edges`` (u, v), v the smaller."""
    sent = edges.select(F.col("v").alias("c"), "u").join(_hashed(low.withColumnRenamed("u", "c"), nodes), "c", "left").select("u", F.coalesce("m", "c").alias("v"))
    return _dealt(sent, count).distinct()


def _small(edges: DataFrame, count: int) -> DataFrame:
    """Each node's smaller neighbours and the node itself, sent to the smallest of them."""
    low, nodes = _lowest(edges, count)
    sent = edges.join(_hashed(low, nodes), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).filter("u != v")
    return _dealt(sent, count + nodes).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (u, v); nodes may be of any type that has an order.

    Loops and nulls are left out, repeated and turned edges are one. Nodes without an edge to another aren't there.
    """
    edges = saved(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars")  # repeated edges end with the first round
    for _ in range(MAX_ROUNDS):
        # a star round its smallest node: no node has two smaller neighbours, and no smaller neighbour has one of its own
        count = edges.count()
        low, nodes = _lowest(edges, count)
        if count == nodes and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        large = saved(_large(edges, count, low, nodes), "stars")
        edges = saved(_small(large, large.count()), "stars")
    raise RuntimeError("components did not settle")
