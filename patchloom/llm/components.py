"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step sends every node's neighbours to the smallest of them; the steps need a number of rounds that grows
with the logarithm of the longest path, and no node's neighbours are ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.saved import saved

#: Rounds after which it gives up with an error; 2**40 nodes in one path need fewer.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v). Large: the larger neighbours of u to the smallest of u and its neighbours; small: u and its smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = near.join(low, "u")
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), the component being its smallest node. Loops are ignored."""
    edges = saved(edges.select("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2**40), F.sum(F.xxhash64("v", "u") % 2**40)).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = state
        edges = saved(_star(saved(_star(edges, True), "edges"), False), "edges")
    raise RuntimeError("components did not settle")
