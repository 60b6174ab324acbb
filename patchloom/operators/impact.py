"""Impact to any depth: a search from each change along reversed edges, level by level, each symbol once and by its first path.

A search takes symbols in the order in which they were found. That order is the list of the edges' places from the change to the
symbol, compared from the front, so no queue is needed: of a level's candidates for one symbol the smallest list wins, and a
level's symbols come in the order of their lists. Edges are saved once, in buckets of their target. A level is one join of the last level's
symbols with them, in which only the symbols move, and an anti-join with
what has been found; it is saved, so that a lost executor costs one level. Levels are as many as the depth at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.graph import SECOND
from patchloom.sources.saved import saved, saved_by


def _open_steps(level: DataFrame, found: DataFrame | None, cap: int) -> DataFrame:
    """Symbols of ``level`` that are still taken: a step is all that one symbol leads to, and begins while fewer than ``cap`` are found."""
    sizes = level.groupBy("change_key", "parent").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("change_key").orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    if found is not None:
        sizes = sizes.join(found.groupBy("change_key").agg(F.count("*").alias("had")), "change_key", "left")
        sizes = sizes.withColumn("before", F.col("before") + F.coalesce("had", F.lit(0)))
    return level.join(sizes.filter(F.col("before") < cap).select("change_key", "parent"), ["change_key", "parent"], "left_semi")


def _first_changes(found: DataFrame, cap: int) -> DataFrame:
    """``found`` up to the step that brings all changes together, in their order, to ``cap`` paths.

    Every change with a path brings one at least, so the first ``cap`` of them are all that can matter, and each has stopped at
    its own step already: what is put in one order is bounded by the cap and the largest step.
    """
    first = found.groupBy("change_place", "change_key").agg(F.count("*").alias("n")).orderBy("change_place", "change_key").limit(cap).select("change_key")
    sizes = found.join(F.broadcast(first), "change_key", "left_semi").groupBy("change_place", "change_key", "depth", "parent").agg(F.count("*").alias("size"))
    earlier = Window.orderBy("change_place", "change_key", "depth", "parent").rowsBetween(Window.unboundedPreceding, -1)
    use = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).filter(F.col("before") < cap).select("change_key", "depth", "parent")
    return found.join(use, ["change_key", "depth", "parent"], "left_semi")


def search(
    changes: DataFrame, edges: DataFrame, depth: int, weights: dict[str, float] | None = None, rounded: bool = True, types: tuple[str, ...] = (), cap: int | None = None,
    over_all: bool = False, trim: bool = False, known: DataFrame | None = None, decay: float = SECOND,
) -> DataFrame:
    """change_key, impacted_key, depth, score, path (keys, the caller first), edge_ords (the caller's edge first).

    ``changes`` (stable_key; place, where ``over_all``), ``edges`` (from_key, to_key, type, confidence, ord) of ``types`` or of any, a smaller
    ord first; ord may be of any type that has an order. Where both have a ``graph`` column, a change is searched in its own graph: deleted
    symbols in the base, others in the head. Callers that aren't ``known`` (stable_key, graph if there) are passed over. A score is the
    parent's times weight, confidence and, from depth two on, ``decay``; ``rounded`` to 3 places before it passes on.

    ``cap`` stops after the step that reaches so many paths, of each change or, ``over_all``, of all changes in the order of their place;
    with ``trim`` each change's best ``cap`` stay, by score and key. Cycles end, as every symbol is found once; a change isn't impacted by
    itself. Null keys meet nothing, repeated changes are one, and of equal edges one counts.
    """
    if depth < 1 or (over_all and cap is None):
        raise ValueError("a search needs a depth of 1 at least, and a cap if it is over all changes")
    graphs = ["graph"] if "graph" in edges.columns and "graph" in changes.columns else []
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (weights or {"": 1.0}).items() for x in pair]), F.col("type")), F.lit(1.0))
    use = edges.filter(F.col("type").isin(*types)) if types else edges
    to = use.select(*graphs, F.col("to_key").alias("at"), F.col("from_key").alias("node"), "ord", (weight * F.col("confidence")).alias("gain"))
    if known is not None:
        to = to.join(known.select(*graphs, F.col("stable_key").alias("node")), [*graphs, "node"], "left_semi")
    to = saved_by(to.filter(F.col("at").isNotNull()), "edges", [*graphs, "at"])
    kind = edges.schema["ord"].dataType.simpleString()
    place = ["change_place"] if over_all else []
    start = changes.filter(F.col("stable_key").isNotNull()).groupBy(*graphs, F.col("stable_key").alias("change_key")).agg(*([F.min("place").alias("change_place")] if over_all else [F.lit(0).alias("one")])).drop("one")
    start = saved(start, "changes")  # or its grouping would be kept in the first join, and the edges move
    frontier = start.select(*graphs, *place, "change_key", F.col("change_key").alias("node"), F.array().cast(f"array<{kind}>").alias("ords"), F.array("change_key").alias("path"), F.lit(1.0).alias("score"))
    seen, found = frontier.select(*graphs, "change_key", "node"), None
    for level in range(1, depth + 1):
        gain = F.col("score") * F.col("gain") if level == 1 else F.col("score") * F.col("gain") * F.lit(decay)
        ahead = frontier.withColumnsRenamed({"node": "at", "ords": "parent"}).hint("shuffle_hash").join(to, [*graphs, "at"]).join(seen, [*graphs, "change_key", "node"], "left_anti")
        ahead = ahead.select(*graphs, *place, "change_key", "node", "parent", F.concat("parent", F.array("ord")).alias("ords"), F.concat(F.array("node"), "path").alias("path"), (F.round(gain, 3) if rounded else gain).alias("score"))
        first = F.row_number().over(Window.partitionBy(*graphs, "change_key", "node").orderBy("ords"))
        reached = saved(ahead.withColumn("n", first).filter("n = 1").drop("n"), "level")
        ahead = reached if cap is None else _open_steps(reached, found, cap)
        own = ahead.withColumn("depth", F.lit(level))
        found = own if found is None else found.unionByName(own)
        if level < depth and reached.isEmpty():
            break
        frontier, seen = ahead.drop("parent"), seen.unionByName(ahead.select(*graphs, "change_key", "node"))
    if over_all:
        found = _first_changes(found, cap)
    if trim:
        best = F.row_number().over(Window.partitionBy("change_key").orderBy(F.col("score").desc(), "node"))
        found = found.withColumn("n", best).filter(F.col("n") <= cap)
    return found.select("change_key", F.col("node").alias("impacted_key"), "depth", F.round("score", 3).alias("score"), "path", F.reverse("ords").alias("edge_ords"))


def ranked_paths(paths: DataFrame, symbols: DataFrame, top: int) -> DataFrame:
    """The ``top`` paths by score, then the caller's name, numbered by place: what a summary shows. ``symbols`` (stable_key, qualified_name)."""
    named = paths.join(symbols.select(F.col("stable_key").alias("impacted_key"), F.col("qualified_name").alias("impacted_name")), "impacted_key")
    order = [F.col("score").desc(), F.col("impacted_name"), F.col("change_key"), F.col("impacted_key")]
    return named.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def blast_radius_rows(changes: DataFrame, paths: DataFrame, base: DataFrame, head: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: changes, exported, impacted, paths, score and level, where exported are the exported symbol rows of both sides that a change names.

    ``before`` and ``after`` are the change's keys; 3, 5 and 8 times scores as elsewhere.
    """
    keys = changes.select(F.explode(F.array(before, after)).alias("stable_key")).filter("stable_key IS NOT NULL").distinct()
    rows = base.select("stable_key", "exported").unionByName(head.select("stable_key", "exported")).filter("exported").join(keys, "stable_key", "left_semi")
    one = lambda x: x.withColumn("__k", F.lit(1))
    n = one(changes.agg(F.count("*").alias("changes"))).join(one(rows.agg(F.count("*").alias("exported"))), "__k")
    n = n.join(one(paths.agg(F.countDistinct("impacted_key").alias("impacted"), F.count("*").alias("paths"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("scores"))), "__k")
    score = F.least(F.lit(100), F.round(F.col("changes") * 3 + F.col("exported") * 5 + F.col("scores") * 8)).cast("int")
    return n.select("changes", "exported", "impacted", "paths", score.alias("score"), F.when(score >= 60, "high").when(score >= 25, "medium").otherwise("low").alias("level"))
