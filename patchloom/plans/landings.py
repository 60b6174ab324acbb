"""Registered queries of sources and sinks: relations landed as JSON lines, cases written and replayed, archives, saved indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchloom.operators import graph, state
from patchloom.plans import adapters as A
from patchloom.plans.catalog import _GS, _PAT, query
from patchloom.sources import archives, context, tables
from patchloom.sources.saved import kept_folder, saved, saved_by
from patchloom.sources.tables import table


def _folder(s, name):
    return kept_folder(s, f"{name}-{uuid.uuid4().hex}")


@query("landed_files", f"{_PAT} SELECT path, 'modified' AS status, CAST(additions AS INT) AS additions, CAST(deletions AS INT) AS deletions, sha256(patch) AS patch_hash FROM patches")
def landed_files(s, d):
    """Changed files as a scan lands them: JSON lines, read under their schema, each row held to the relation's rule."""
    folder = _folder(s, "landed")
    A.patches(s, d).select("path", F.lit("modified").alias("status"), F.col("additions").cast("int").alias("additions"), F.col("deletions").cast("int").alias("deletions"), "patch").write.json(folder)
    return tables.relation(s, folder, "changed_files").select("path", "status", "additions", "deletions", F.sha2("patch", 256).alias("patch_hash"))


_CASES = "SELECT 'case-' || o_orderkey AS case_id, o_orderpriority AS category, CAST(o_custkey AS BIGINT) AS author, o_totalprice AS size FROM orders"


def _cases(s, d):
    return table(s, d, "orders").select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("author"), F.col("o_totalprice").alias("size"))


@query("replayed_cases", _CASES)
def replayed_cases(s, d):
    """Cases written as JSON lines, all or none, and replayed under a schema in which a repeated key is an error."""
    folder = _folder(s, "cases")
    context.write_cases(_cases(s, d), folder, "category")
    return tables.replay_cases(s, folder, "case_id string, category string, author long, size double", "case_id")


@query("written_cases", "SELECT o_orderpriority AS category, count(*) AS cases FROM orders GROUP BY 1")
def written_cases(s, d):
    """What the sink says that it has written."""
    return context.write_cases(_cases(s, d), _folder(s, "cases"), "category")


#: Twenty documents to an archive; every seventh is over the limit of an entry.
_PER, _MOST = 20, 3000
_ARCHIVES = f"""WITH f AS (SELECT 'a' || (doc_id // {_PER}) || '.zip' AS archive, 'docs/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN repeat(coalesce(text, ''), 1 + {_MOST} // (1 + strlen(coalesce(text, '')))) ELSE coalesce(text, '') END AS content FROM documents)
SELECT archive, path, CAST(least(strlen(content), {_MOST + 1}) AS BIGINT) AS n_bytes, CASE WHEN strlen(content) > {_MOST} THEN 'too_large' ELSE 'kept' END AS status, CASE WHEN strlen(content) <= {_MOST} THEN sha256(content) END AS content_hash FROM f"""


@query("archive_entries", _ARCHIVES)
def archive_entries(s, d):
    """Documents packed into archives of a repository each, and their entries read back under limits."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("doc_id") % 7 == 0, F.repeat(text, (1 + F.floor(F.lit(_MOST) / (1 + F.octet_length(text)))).cast("int"))).otherwise(text)
    files = table(s, d, "documents").select(F.concat(F.lit("a"), F.floor(F.col("doc_id") / _PER).cast("string"), F.lit(".zip")).alias("archive"), F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.cast("binary").alias("content"))
    found = archives.archive_entries(archives.packed(files, ["archive"]), shares=2, most_entry_bytes=_MOST)
    return found.select("archive", "path", "n_bytes", "status", F.sha2("content", 256).alias("content_hash"))


@query("saved_index", "SELECT 'part:' || p_partkey AS stable_key, p_name AS qualified_name FROM part WHERE p_partkey % 10 <> 1")
def saved_index(s, d):
    """A snapshot saved, then replaced by one of the head; one that isn't ready stands beside it and gives nothing."""
    folder = _folder(s, "index")
    header = lambda status: s.range(1).select(F.lit(status).alias("status"))
    for head, status, key in ((False, "ready", "k"), (True, "running", "other"), (True, "ready", "k")):
        tables.save_index(s, header(status), A.symbols(s, d, head).select("stable_key", "qualified_name"), folder, key)
    return tables.load_ready(s, folder, "k").unionByName(tables.load_ready(s, folder, "other"))


@query("last_symbols", "SELECT 'part:' || l_partkey AS stable_key, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag)) AS signature FROM lineitem GROUP BY 1")
def last_symbols(s, d):
    """A key that is declared more than once has its last declaration."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "signature"]
    rows = table(s, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("stable_key"), F.col("l_returnflag").alias("signature"), *order[:-1])
    return state.last_of_key(rows, ["stable_key"], order).select("stable_key", "signature")


_INCREMENTAL = _GS + """, ch AS (SELECT DISTINCT path FROM gs WHERE path LIKE 'part/%' AND CAST(split_part(path, '/', 2) AS INT) % 10 = 3), bs AS (SELECT stable_key, path FROM gs WHERE in_base), hs AS (SELECT stable_key, path FROM gs WHERE in_head),
be AS (SELECT e.from_key, e.to_key, e.type, e.ord, g.path AS source_path FROM edges e JOIN bs g ON g.stable_key = from_key), he AS (SELECT e.from_key, e.to_key, e.type, e.ord, g.path AS source_path FROM edges e JOIN hs g ON g.stable_key = from_key),
af AS (SELECT path FROM ch UNION SELECT path FROM bs WHERE stable_key IN (SELECT from_key FROM be WHERE to_key IN (SELECT stable_key FROM bs WHERE path IN (SELECT path FROM ch)))),
sy AS (SELECT * FROM bs WHERE path NOT IN (SELECT path FROM af) UNION ALL SELECT * FROM hs WHERE path IN (SELECT path FROM af))"""
_GONE = "gone AS (SELECT stable_key FROM bs WHERE path IN (SELECT path FROM ch) AND stable_key NOT IN (SELECT stable_key FROM sy))"


def _incremental(s, d):
    part = F.split("path", "/")
    base, head = (saved(A.graph_symbols(s, d, x).select("stable_key", "path"), "symbols") for x in (False, True))
    changed = head.unionByName(base).filter(F.col("path").startswith("part/") & (part[1].cast("int") % 10 == 3)).select("path").distinct()
    buckets = max(64, 8 * table(s, d, "lineitem").rdd.getNumPartitions())  # they grow in number with the scan
    edges = saved_by(A.edges(s, d).select("from_key", "to_key", "type", "ord"), "edges", ["from_key"], buckets)  # stored once, where both sides' symbols come to them
    of = lambda symbols: edges.join(symbols.select(F.col("stable_key").alias("from_key"), F.col("path").alias("source_path")).hint("shuffle_hash"), "from_key").select("from_key", "to_key", "type", "ord", "source_path")
    base_edges, head_edges = of(base), of(head)
    affected = saved(graph.affected_paths(base, base_edges, changed), "affected")
    again = lambda rows, c: rows.join(affected.select(F.col("path").alias(c)), c, "left_semi")
    return graph.incremental_index(base, base_edges, again(head, "path"), again(head_edges, "source_path"), changed, affected)


@query("incremental_symbols", _INCREMENTAL + " SELECT stable_key, path FROM sy")
def incremental_symbols(s, d):
    """The head's symbols from the base's and those of the files parsed again."""
    return _incremental(s, d)[0]


@query("incremental_edges", f"{_INCREMENTAL}, {_GONE} SELECT DISTINCT from_key, to_key, type, ord FROM (SELECT * FROM be WHERE source_path NOT IN (SELECT path FROM af) AND to_key NOT IN (SELECT stable_key FROM gone) UNION ALL SELECT * FROM he WHERE source_path IN (SELECT path FROM af))")
def incremental_edges(s, d):
    """The head's edges from the base's and those of the files parsed again, without those into symbols that are gone."""
    return _incremental(s, d)[1].select("from_key", "to_key", "type", "ord").distinct()
