"""Registered queries of impact at any depth and of stored graphs, with SQL made of one level after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchloom.operators import graph, impact
from patchloom.plans import adapters as A
from patchloom.plans.catalog import _EDG, _STRICT_W, _paths_sql, query
from patchloom.sources import graphs
from patchloom.sources.saved import kept_folder
from patchloom.sources.tables import table

_key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def deep_edges(s, d):
    """The edges of the catalog, and above customers the nations that call them and the regions that import those."""
    customer, nation = table(s, d, "customer"), table(s, d, "nation")
    edge = lambda rows, a, b, kind, c: rows.select(a.alias("from_key"), b.alias("to_key"), F.lit(kind).alias("type"), F.lit(c).alias("confidence"), b.substr(F.instr(b, ":") + 1, F.length(b)).cast("long").alias("ord"), F.lit(True).alias("type_resolved"))
    more = edge(customer, _key("nation", "c_nationkey"), _key("customer", "c_custkey"), "CALLS", 0.8).unionByName(edge(nation, _key("region", "n_regionkey"), _key("nation", "n_nationkey"), "IMPORTS", 0.7))
    return A.edges(s, d).unionByName(more)


_DEEP = f"""{_EDG}, deep AS (SELECT from_key, to_key, type, confidence, ord FROM edges UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CALLS', 0.8, c_custkey FROM customer
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'IMPORTS', 0.7, n_nationkey FROM nation)"""


def search_sql(depth: int, weights: str = "1.0", rounded: bool = True, where: str = "true", cap: int | None = None, over_all: bool = False, trim: bool = False, head: str = _DEEP) -> str:
    """CTEs up to ``found`` (change_key, node, depth, ords, path, score): the search of ``operators.impact`` unrolled."""
    fix = (lambda x: f"round({x}, 3)") if rounded else (lambda x: x)
    out = [head, f"w AS (SELECT *, {weights} * confidence AS gain FROM deep WHERE {where})", "f0 AS (SELECT DISTINCT stable_key AS change_key, stable_key AS node, CAST([] AS BIGINT[]) AS parent, CAST([] AS BIGINT[]) AS ords, [stable_key] AS path, CAST(1.0 AS DOUBLE) AS score FROM changes)"]
    for k in range(1, depth + 1):
        gain = "f.score * w.gain" + (" * 0.55" if k > 1 else "")
        seen = " UNION ALL ".join(f"SELECT change_key, node FROM f{j}" for j in range(k))
        out.append(f"a{k} AS (SELECT f.change_key, w.from_key AS node, f.ords AS parent, list_append(f.ords, w.ord) AS ords, list_prepend(w.from_key, f.path) AS path, CAST({fix(gain)} AS DOUBLE) AS score FROM f{k - 1} f JOIN w ON w.to_key = f.node)")
        out.append(f"b{k} AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY change_key, node ORDER BY ords) AS n FROM a{k} WHERE (change_key, node) NOT IN ({seen})) WHERE n = 1)")
        if cap is None:
            out.append(f"f{k} AS (SELECT * FROM b{k})")
        else:
            had = " + ".join(f"(SELECT count(*) FROM f{j} WHERE f{j}.change_key = s.change_key)" for j in range(1, k)) or "0"
            out.append(f"s{k} AS (SELECT change_key, parent, coalesce(sum(count(*)) OVER (PARTITION BY change_key ORDER BY parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM b{k} GROUP BY change_key, parent)")
            out.append(f"f{k} AS (SELECT b.* FROM b{k} b JOIN s{k} s ON s.change_key = b.change_key AND s.parent = b.parent WHERE earlier + {had} < {cap})")
    out.append("u AS (" + " UNION ALL ".join(f"SELECT *, CAST({k} AS INT) AS depth FROM f{k}" for k in range(1, depth + 1)) + ")")
    last = "u"
    if over_all:
        out.append("z AS (SELECT change_key, depth, parent, coalesce(sum(count(*)) OVER (ORDER BY CAST(split_part(change_key, ':', 2) AS BIGINT), depth, parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM u GROUP BY change_key, depth, parent)")
        out.append(f"v AS (SELECT u.* FROM u JOIN z ON z.change_key = u.change_key AND z.depth = u.depth AND z.parent = u.parent WHERE earlier < {cap})")
        last = "v"
    if trim:
        out.append(f"t AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY change_key ORDER BY score DESC, node) AS n FROM {last}) WHERE n <= {cap})")
        last = "t"
    out.append(f"found AS (SELECT change_key, node AS impacted_key, depth, round(score, 3) AS score, array_to_string(path, ',') AS path, array_to_string(list_reverse(ords), ',') AS edge_ords FROM {last})")
    return ", ".join(out)


def _shown(paths):
    return paths.withColumn("path", F.array_join("path", ",")).withColumn("edge_ords", F.array_join(F.transform("edge_ords", lambda x: x.cast("string")), ","))


def _placed(s, d):
    return A.changes(s, d).withColumn("place", F.substring_index("stable_key", ":", -1).cast("long"))


@query("impact_paths_deep", search_sql(4, _STRICT_W) + " SELECT * FROM found")
def impact_paths_deep(s, d):
    """Four levels: orders, customers, nations, regions; many paths meet in a nation, and the first counts."""
    return _shown(impact.search(A.changes(s, d), deep_edges(s, d), 4, graph.WEIGHTS))


@query("impact_paths_capped", search_sql(3, rounded=False, cap=12, trim=True) + " SELECT * FROM found")
def impact_paths_capped(s, d):
    """Each change's search stops after the step that reaches twelve, and its best twelve stay."""
    return _shown(impact.search(A.changes(s, d), deep_edges(s, d), 3, rounded=False, cap=12, trim=True))


@query("impact_paths_capped_over_all", search_sql(2, _STRICT_W, where="type IN ('CALLS', 'IMPORTS')", cap=200, over_all=True) + " SELECT * FROM found")
def impact_paths_capped_over_all(s, d):
    """All changes together stop after the step that reaches two hundred."""
    return _shown(impact.search(_placed(s, d), deep_edges(s, d), 2, graph.WEIGHTS, types=("CALLS", "IMPORTS"), cap=200, over_all=True))


@query("impact_evidence", search_sql(2, rounded=False, where="type = 'CALLS'", cap=12, trim=True, head=f"{_EDG}, deep AS (SELECT * FROM edges)") + " SELECT * FROM found")
def impact_evidence(s, d):
    """Impact paths over calls alone, capped at 12 and trimmed, with keys and edges of each path."""
    return _shown(graph.impact_paths(A.changes(s, d), A.edges(s, d), None, rounded=False, cap=12, types=("CALLS",), trim=True, evidence=True))


_GO = search_sql(2, where="type = 'CALLS' AND from_key IN (SELECT stable_key FROM gs WHERE in_head)", cap=200, over_all=True, head=f"{_DEEP}, {A.GRAPH_SYMBOLS_SQL}")


def _go(s, d):
    return impact.search(_placed(s, d), deep_edges(s, d), 2, types=("CALLS",), cap=200, over_all=True, known=A.graph_symbols(s, d, True))


@query("impact_go", _GO + " SELECT change_key, impacted_key, impacted_name, depth, score, CAST(place AS INT) AS place FROM (SELECT f.*, qualified_name AS impacted_name, row_number() OVER (ORDER BY score DESC, qualified_name, change_key, impacted_key) AS place FROM found f JOIN gs ON stable_key = impacted_key AND in_head) WHERE place <= 8")
def impact_go(s, d):
    """Calls alone, known callers alone; the eight best by score and name."""
    return impact.ranked_paths(_go(s, d), A.graph_symbols(s, d, True), 8).select("change_key", "impacted_key", "impacted_name", "depth", "score", "place")


@query("blast_radius_go", _GO + ", " + A.SYMBOLS_SQL + ", r AS (SELECT (SELECT count(*) FROM changes) AS changes, (SELECT count(*) FROM (SELECT * FROM base UNION ALL SELECT * FROM head) WHERE exported AND stable_key IN (SELECT stable_key FROM changes)) AS exported, count(DISTINCT impacted_key) AS impacted, count(*) AS paths, coalesce(sum(score), 0) AS scores FROM found) SELECT changes, exported, impacted, paths, CAST(least(100, round(changes * 3 + exported * 5 + scores * 8)) AS INT) AS score, CASE WHEN least(100, round(changes * 3 + exported * 5 + scores * 8)) >= 60 THEN 'high' WHEN least(100, round(changes * 3 + exported * 5 + scores * 8)) >= 25 THEN 'medium' ELSE 'low' END AS level FROM r")
def blast_radius_go(s, d):
    """Exported symbols are counted as rows of both sides."""
    key = F.col("stable_key")
    return impact.blast_radius_rows(A.changes(s, d), _go(s, d), A.symbols(s, d, False), A.symbols(s, d, True), key, key)


@query("stored_graph_impact", _paths_sql(_STRICT_W, True) + " SELECT * FROM paths")
def stored_graph_impact(s, d):
    """The graph published in buckets of its targets, opened again, and searched without moving an edge."""
    folder = kept_folder(s, f"graphs-{uuid.uuid4().hex}")
    graphs.publish(s, folder, "head", {"edges": A.edges(s, d), "symbols": A.graph_symbols(s, d, True)}, 16)
    return graph.impact_paths(A.changes(s, d), graphs.opened(s, folder, "head", "edges"), graph.WEIGHTS)


@query("stored_graph_header", "SELECT 'head' AS snapshot_key, 'ready' AS status, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM orders) AS edges, (SELECT count(*) FROM part WHERE p_partkey % 10 <> 1) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS symbols")
def stored_graph_header(s, d):
    """A version replaced by a second one: what the manifest says, and how much its parts hold."""
    folder = kept_folder(s, f"graphs-{uuid.uuid4().hex}")
    for head in (False, True):
        graphs.publish(s, folder, "head", {"edges": A.edges(s, d), "symbols": A.graph_symbols(s, d, head)}, 8)
    found = graphs.manifest(s, folder, "head")
    count = lambda part: graphs.opened(s, folder, "head", part).agg(F.count("*").alias(part)).withColumn("__k", F.lit(1))
    both = count("edges").join(count("symbols"), "__k")
    return both.select(F.lit(found["key"]).alias("snapshot_key"), F.lit(found["status"]).alias("status"), "edges", "symbols")
