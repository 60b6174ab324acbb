"""Registered queries of the code-evidence operators, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import diff, evaluation, findings, graph, review, rules, state
from patchloom.plans import adapters as A
from patchloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Patterns for the corpus: its texts hold no code, so these stand in for the code rules.
CORPUS_RULES = (
    ("corpus/symbols", r"[#$%&]{3}", "style", "medium", 0.90, "all"),
    ("corpus/bars", r" \| ", "style", "low", 0.85, "all"),
    ("corpus/token", r"token = ", "security", "critical", 0.93, "source"),
    ("corpus/shout", r"[A-Z]{4,}!!", "style", "high", 0.86, "all"),
)
_SYM, _EDG, _PAT = (f"WITH {x}" for x in (A.SYMBOLS_SQL, A.EDGES_SQL, A.PATCHES_SQL))
NOW = "1998-08-02 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- diffs -----------------------------------------------------------------------------------------------------------


@query("diff_lines", f"{_PAT} SELECT path, CAST(pos AS INT) AS pos, kind, content, CAST(left_line AS INT) AS left_line, CAST(right_line AS INT) AS right_line FROM lines")
def diff_lines(s, d):
    return diff.parse_patch(A.patches(s, d))


@query("added_lines", f"{_PAT} SELECT path, CAST(right_line AS INT) AS right_line, content FROM lines WHERE kind = 'added'")
def added_lines(s, d):
    return diff.added_lines(diff.parse_patch(A.patches(s, d))).select("path", "right_line", "content")


@query("right_line_lookup", f"{_PAT} SELECT path, CAST(right_line AS INT) AS right_line, kind, content FROM lines WHERE right_line IS NOT NULL")
def right_line_lookup(s, d):
    return diff.right_lines(diff.parse_patch(A.patches(s, d)))


@query("reverse_patch", f"{_PAT} SELECT path, '@@ -1,' || len(ls) || ' +1,' || len(ls) || ' @@' || chr(10) || array_to_string([CASE WHEN x LIKE '+%' THEN CASE WHEN x LIKE '+++%' THEN x ELSE '-' || x[2:] END WHEN x LIKE '-%' THEN CASE WHEN x LIKE '---%' THEN x ELSE '+' || x[2:] END ELSE x END FOR x IN string_split(patch, chr(10))[2:]], chr(10)) AS patch FROM patches JOIN raw USING (doc_id)")
def reverse_patch(s, d):
    return A.patches(s, d).select("path", diff.reversed_patch(F.col("patch")).alias("patch"))


@query("patch_budget_prefix", f"{_PAT} SELECT path, CAST(least(length(patch), room) AS BIGINT) AS kept_chars FROM (SELECT *, 30000 - coalesce(sum(length(patch)) OVER (PARTITION BY change_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM patches) WHERE room > 0")
def patch_budget_prefix(s, d):
    return diff.patch_budget(A.patches(s, d), "change_id", "doc_id", 30_000).select("path", "kept_chars")


_REDACT = "regexp_replace(regexp_replace(regexp_replace(patch, '-----BEGIN [^-]+-----[\\s\\S]*?-----END [^-]+-----', '[REDACTED_PEM]', 'g'), '(?i)bearer\\s+[a-z0-9._~+/-]{8,}', 'Bearer [REDACTED]', 'g'), '(?i)(api[_-]?key|token|secret|password|private[_-]?key)(\\s*[:=]\\s*)[^\\s,;]+', '\\1\\2[REDACTED]', 'g')"
_BUDGET = _PAT.replace("WITH", "WITH RECURSIVE", 1) + f""", x AS (SELECT change_id, path, row_number() OVER (PARTITION BY change_id ORDER BY doc_id) AS n, {_REDACT} AS p FROM patches),
r AS (SELECT change_id, 0::BIGINT AS n, 0::BIGINT AS used, NULL::VARCHAR AS path, NULL::VARCHAR AS omission, 0::BIGINT AS patch_chars, 0::BIGINT AS kept_chars, NULL::VARCHAR AS patch_hash, NULL::VARCHAR AS kept_hash FROM (SELECT DISTINCT change_id FROM x) UNION ALL
  SELECT change_id, n, used + length(kept), path, omission, length(p), length(kept), sha256(p), CASE WHEN NOT out THEN sha256(kept) END FROM (SELECT *, CASE WHEN out THEN '' WHEN length(p) <= 30000 - used THEN p ELSE regexp_extract(substr(p, 1, CAST(30000 - used AS BIGINT)), '^([\\s\\S]*\\n)', 1) END AS kept, CASE WHEN n > 15 THEN 'file_limit' WHEN used >= 30000 THEN 'patch_budget' WHEN length(p) > 30000 - used THEN 'patch_truncated' WHEN p = '' THEN 'patch_unavailable' END AS omission
    FROM (SELECT x.change_id, x.n, r.used, x.path, x.p, x.n > 15 OR r.used >= 30000 AS out FROM r JOIN x ON x.change_id = r.change_id AND x.n = r.n + 1)))
SELECT change_id, path, omission, patch_chars, kept_chars, patch_hash, kept_hash FROM r WHERE n > 0"""


@query("patch_budget_lines", _BUDGET)
def patch_budget_lines(s, d):
    return diff.patch_budget_by_line(A.patches(s, d), "change_id", "doc_id", 30_000, 15)


@query("change_totals", f"{_PAT} SELECT change_id, CAST(sum(CASE WHEN n <= 12 THEN additions ELSE 0 END) AS BIGINT) AS additions, CAST(sum(CASE WHEN n <= 12 THEN deletions ELSE 0 END) AS BIGINT) AS deletions, count(*) > 12 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY doc_id) AS n FROM patches) GROUP BY change_id")
def change_totals(s, d):
    return diff.change_totals(A.patches(s, d), "change_id", "doc_id", 12)


# --- rules and findings ----------------------------------------------------------------------------------------------

_RULES_SQL = "rules(rule_id, pattern, category, severity, confidence, scope) AS (VALUES " + ", ".join(f"('{i}', '{p}', '{c}', '{v}', CAST({f} AS DOUBLE), '{o}')" for i, p, c, v, f, o in CORPUS_RULES) + ")"
_CAND_SQL = f"{_PAT}, {_RULES_SQL}, cand AS (SELECT rule_id, category, severity, confidence, path, CAST(right_line AS INT) AS line, trim(content) AS excerpt FROM lines, rules WHERE kind = 'added' AND regexp_matches(content, pattern) AND (scope = 'all' OR NOT regexp_matches(path, '{T.TEST_PATH}')))"


def _candidates(s, d):
    return rules.rule_candidates(diff.added_lines(diff.parse_patch(A.patches(s, d))), CORPUS_RULES)


def _with_ordinal(rows):
    return rows.withColumn("ordinal", F.concat_ws("|", "rule_id", "path", F.lpad(F.col("line").cast("string"), 8, "0"))).withColumn("change_id", F.floor(F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("long") / 20))


_ORD_SQL = _CAND_SQL + ", o AS (SELECT *, rule_id || '|' || path || '|' || lpad(CAST(line AS VARCHAR), 8, '0') AS ordinal, CAST(regexp_extract(path, '/([0-9]+)[.]', 1) AS BIGINT) // 20 AS change_id FROM cand)"
_RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_VER_SQL = _ORD_SQL + ", v AS (SELECT *, sha256(path || ':' || line || ':' || category || ':' || rule_id) AS fingerprint, CASE WHEN confidence < CASE severity WHEN 'critical' THEN 0.85 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.80 ELSE 1.01 END THEN 'below_publish_threshold' END AS rejection_reason FROM o)"


@query("rule_candidates", _CAND_SQL + " SELECT * FROM cand")
def rule_candidates(s, d):
    return _candidates(s, d)


def _verified(s, d):
    lines = diff.parse_patch(A.patches(s, d))
    return findings.verify(_with_ordinal(rules.rule_candidates(diff.added_lines(lines), CORPUS_RULES)), diff.right_lines(lines))


@query("verified_findings", _VER_SQL + " SELECT fingerprint, rule_id, path, line, CASE WHEN rejection_reason IS NULL THEN 'verified' ELSE 'rejected' END AS status, rejection_reason FROM v")
def verified_findings(s, d):
    return _verified(s, d).select("fingerprint", "rule_id", "path", "line", "status", "rejection_reason")


@query("published_findings_strict", _VER_SQL + f" SELECT fingerprint, row_number() OVER (PARTITION BY change_id ORDER BY {_RANK_SQL} DESC, confidence DESC, ordinal) <= 10 AS publishable, CASE WHEN row_number() OVER (PARTITION BY change_id ORDER BY {_RANK_SQL} DESC, confidence DESC, ordinal) > 10 THEN 'publication_limit' END AS rejection_reason FROM v WHERE rejection_reason IS NULL")
def published_findings_strict(s, d):
    return findings.publish_strict(_verified(s, d), "change_id", 10).select("fingerprint", "publishable", "rejection_reason")


@query("published_findings_plain", _ORD_SQL + f" SELECT fingerprint, publishable, CASE WHEN publishable THEN 'verified' ELSE 'rejected' END AS status FROM (SELECT sha256(rule_id || chr(10) || path || chr(10) || line) AS fingerprint, row_number() OVER (PARTITION BY change_id ORDER BY {_RANK_SQL} DESC, ordinal) <= 10 AND confidence >= CASE severity WHEN 'critical' THEN 0.90 WHEN 'high' THEN 0.85 ELSE 0.80 END AS publishable FROM o)")
def published_findings_plain(s, d):
    return findings.publish_plain(_with_ordinal(_candidates(s, d)), "change_id", 10).select("fingerprint", "publishable", "status")


@query("risk_rollup", _VER_SQL + f", g AS (SELECT change_id, count(*) AS candidates, count(*) FILTER (rejection_reason IS NULL) AS verified, count(*) FILTER (rejection_reason IS NOT NULL) AS rejected, max(CASE WHEN rejection_reason IS NULL THEN {_RANK_SQL} ELSE 0 END) AS top FROM v GROUP BY change_id) SELECT change_id, candidates, verified, rejected, CASE WHEN top >= 3 THEN 'high' WHEN top = 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN top >= 3 THEN 'neutral' ELSE 'success' END AS conclusion FROM g")
def risk_rollup(s, d):
    return findings.risk_rollup(_verified(s, d), "change_id")


@query("proximity_findings", _PAT + ", a AS (SELECT path, CAST(right_line AS INT) AS line, content FROM lines WHERE kind = 'added') SELECT DISTINCT a.path, a.line FROM a JOIN a b ON a.path = b.path AND abs(a.line - b.line) <= 8 WHERE regexp_matches(a.content, '[0-9]{3}') AND regexp_matches(b.content, '\\b(the|der|la)\\b')")
def proximity_findings(s, d):
    return rules.remote_in_transaction(diff.added_lines(diff.parse_patch(A.patches(s, d))), "[0-9]{3}", r"\b(the|der|la)\b")


# --- symbols and graph -----------------------------------------------------------------------------------------------

_CHG = _SYM + ", c AS (SELECT coalesce(h.stable_key, b.stable_key) AS stable_key, coalesce(h.qualified_name, b.qualified_name) AS qualified_name, CASE WHEN b.stable_key IS NULL THEN 'ADDED' WHEN h.stable_key IS NULL THEN 'DELETED' WHEN b.content_hash <> h.content_hash OR b.signature <> h.signature THEN 'MODIFIED' END AS change, CASE WHEN b.stable_key IS NULL OR h.stable_key IS NULL THEN true ELSE b.content_hash <> h.content_hash END AS body_changed, CASE WHEN b.stable_key IS NULL OR h.stable_key IS NULL THEN true ELSE b.signature <> h.signature END AS signature_changed FROM base b FULL JOIN head h USING (stable_key))"


@query("symbol_changes", _CHG + " SELECT * FROM c WHERE change IS NOT NULL")
def symbol_changes(s, d):
    return graph.compare_symbols(A.symbols(s, d, False), A.symbols(s, d, True))


@query("symbol_change_counts", _CHG + " SELECT change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY change")
def symbol_change_counts(s, d):
    return symbol_changes(s, d).groupBy("change").agg(F.count("*").alias("n"))


_MOVED = _SYM.replace("WITH", "WITH RECURSIVE", 1).replace("p_name AS qualified_name", "lower(p_type) AS qualified_name") + """, lost AS (SELECT *, row_number() OVER (PARTITION BY kind, qualified_name ORDER BY stable_key) AS n FROM base WHERE stable_key NOT IN (SELECT stable_key FROM head)),
new AS (SELECT kind, qualified_name, list({'k': stable_key, 'h': content_hash} ORDER BY stable_key) AS heads FROM head WHERE stable_key NOT IN (SELECT stable_key FROM base) GROUP BY 1, 2),
r AS (SELECT kind, qualified_name, 0::BIGINT AS n, CAST([] AS VARCHAR[]) AS used, NULL::VARCHAR AS from_key, NULL::VARCHAR AS to_key, 0::INT AS tier FROM new UNION ALL
  SELECT kind, qualified_name, n, CASE WHEN len(same) = 1 OR len(free) = 1 THEN list_append(used, CASE WHEN len(same) = 1 THEN same[1].k ELSE free[1].k END) ELSE used END, stable_key,
    CASE WHEN len(same) = 1 THEN same[1].k WHEN len(free) = 1 THEN free[1].k END, CASE WHEN len(same) = 1 THEN 1 WHEN len(free) = 1 THEN 2 END FROM (SELECT l.kind, l.qualified_name, l.n, r.used, l.stable_key, [x FOR x IN heads IF NOT list_contains(r.used, x.k)] AS free, [x FOR x IN heads IF NOT list_contains(r.used, x.k) AND x.h = l.content_hash] AS same
    FROM r JOIN lost l ON l.kind = r.kind AND l.qualified_name = r.qualified_name AND l.n = r.n + 1 JOIN new ON new.kind = l.kind AND new.qualified_name = l.qualified_name))
SELECT from_key, to_key, tier FROM r WHERE to_key IS NOT NULL"""


@query("symbol_changes_moved", _MOVED)
def symbol_changes_moved(s, d):
    base, head = A.symbols(s, d, False), A.symbols(s, d, True)
    return graph.moved_symbols(base.withColumn("qualified_name", F.lower("signature")), head.withColumn("qualified_name", F.lower("signature")))


@query("unique_name_links", "WITH names AS (SELECT p_name AS name, count(*) AS n, 'part:' || min(p_partkey) AS k FROM part GROUP BY p_name), e AS (SELECT DISTINCT 'order:' || l_orderkey AS from_key, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT from_key, CASE WHEN n = 1 THEN k ELSE 'unresolved:' || e.name END AS to_key, CAST(CASE WHEN n = 1 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence FROM e JOIN names ON names.name = e.name")
def unique_name_links(s, d):
    part, line = table(s, d, "part"), table(s, d, "lineitem")
    symbols = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("stable_key"), F.col("p_name").alias("name"))
    used = line.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("from_key"), F.concat(F.lit("unresolved:"), "p_name").alias("to_key"), F.lit(0.4).alias("confidence")).distinct()
    return graph.link_unique_names(used, symbols, 0.7)


def _paths_sql(weights: str, rounded: bool) -> str:
    fix = (lambda x: f"round({x}, 3)") if rounded else (lambda x: x)
    return f"""{_EDG}, w AS (SELECT *, {weights} * confidence AS gain FROM edges),
d1 AS (SELECT change_key, node, ord AS o1, {fix('gain')} AS score FROM (SELECT stable_key AS change_key, from_key AS node, ord, gain, row_number() OVER (PARTITION BY stable_key, from_key ORDER BY ord) AS n FROM changes JOIN w ON to_key = stable_key WHERE from_key <> stable_key) WHERE n = 1),
d2 AS (SELECT change_key, node, {fix('parent * gain * 0.55')} AS score FROM (SELECT change_key, from_key AS node, score AS parent, gain, row_number() OVER (PARTITION BY change_key, from_key ORDER BY o1, ord) AS n FROM d1 JOIN w ON to_key = node WHERE from_key <> change_key) t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.change_key = t.change_key AND d1.node = t.node)),
paths AS (SELECT change_key, node AS impacted_key, CAST(1 AS INT) AS depth, round(score, 3) AS score FROM d1 UNION ALL SELECT change_key, node, CAST(2 AS INT), round(score, 3) FROM d2)"""


_STRICT_W = "CASE type WHEN 'IMPORTS' THEN 0.6 ELSE 1.0 END"


@query("impact_paths_strict", _paths_sql(_STRICT_W, True) + " SELECT * FROM paths")
def impact_paths_strict(s, d):
    return graph.impact_paths(A.changes(s, d), A.edges(s, d), graph.WEIGHTS)


@query("impact_paths_plain", _paths_sql("1.0", False) + " SELECT * FROM paths")
def impact_paths_plain(s, d):
    return graph.impact_paths(A.changes(s, d), A.edges(s, d), None, rounded=False)


_GS = f"{_EDG}, {A.GRAPH_SYMBOLS_SQL}"
_SEMANTIC = _GS + """, inside AS (SELECT stable_key AS to_key, qualified_name AS changed_name FROM gs WHERE (in_base OR in_head) AND path = 'part/0'), outside AS (SELECT stable_key AS from_key, qualified_name AS impacted_name FROM gs WHERE (in_base OR in_head) AND path <> 'part/0'),
p AS (SELECT to_key, from_key, changed_name, impacted_name, arg_min(CASE WHEN type = 'TESTS' THEN 1.0 ELSE confidence END, ord) AS score FROM edges JOIN inside USING (to_key) JOIN outside USING (from_key) WHERE type_resolved AND type IN ('CALLS', 'READS', 'WRITES', 'EXTENDS', 'IMPLEMENTS', 'OVERRIDES', 'TESTS') GROUP BY ALL)
SELECT changed_name, impacted_name, score, CAST(row_number() OVER (ORDER BY score DESC, changed_name, impacted_name, to_key, from_key) AS INT) AS place FROM p ORDER BY place LIMIT 12"""


@query("semantic_impact", _SEMANTIC)
def semantic_impact(s, d):
    changed = s.createDataFrame([("part/0",)], "path string")
    return graph.semantic_impact(A.graph_symbols(s, d, False), A.graph_symbols(s, d, True), A.edges(s, d), changed)


@query("blast_radius", _paths_sql(_STRICT_W, True) + ", r AS (SELECT (SELECT count(*) FROM changes) AS changes, (SELECT count(*) FROM paths) AS paths, CAST(least(100, round(3 * (SELECT count(*) FROM changes) + 5 * (SELECT count(*) FILTER (exported) FROM changes) + 8 * (SELECT coalesce(sum(score), 0) FROM paths))) AS INT) AS score) SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM r")
def blast_radius(s, d):
    return graph.blast_radius(A.changes(s, d), impact_paths_strict(s, d), "strict")


@query("direct_relationships", _EDG + " SELECT DISTINCT CASE WHEN a.stable_key IS NOT NULL THEN to_key ELSE from_key END AS other_key, CASE WHEN a.stable_key IS NOT NULL THEN 'callee' ELSE 'caller' END AS side, type FROM edges LEFT JOIN changes a ON a.stable_key = from_key LEFT JOIN changes b ON b.stable_key = to_key WHERE type_resolved AND (a.stable_key IS NULL) <> (b.stable_key IS NULL)")
def direct_relationships(s, d):
    return graph.direct_relationships(A.edges(s, d), A.changes(s, d))


_SHARED = ", calls AS (SELECT DISTINCT from_key, to_key FROM edges WHERE type = 'CALLS' AND type_resolved), shared AS (SELECT to_key AS candidate_key, count(*) AS callers FROM calls WHERE from_key IN (SELECT from_key FROM calls WHERE to_key IN (SELECT stable_key FROM changes)) AND to_key NOT IN (SELECT stable_key FROM changes) GROUP BY to_key)"


@query("shared_callers", _EDG + _SHARED + " SELECT * FROM shared")
def shared_callers(s, d):
    return graph.shared_callers(A.edges(s, d), A.changes(s, d))


@query("test_edges", _EDG + ", s AS (SELECT 'order:' || o_orderkey AS stable_key, o_orderpriority LIKE '1%' AS t FROM orders UNION ALL SELECT 'part:' || p_partkey, false FROM part) SELECT DISTINCT from_key, to_key, 'TESTS' AS type FROM edges JOIN s a ON a.stable_key = from_key JOIN s b ON b.stable_key = to_key WHERE type = 'CALLS' AND a.t AND NOT b.t")
def test_edges(s, d):
    orders = table(s, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("stable_key"), F.col("o_orderpriority").startswith("1").alias("test_source"))
    parts = table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("stable_key"), F.lit(False).alias("test_source"))
    return graph.derive_test_edges(A.edges(s, d), orders.unionByName(parts))


_TOKENS = r"list_distinct([t FOR t IN string_split_regex(lower(regexp_replace(qualified_name, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+') IF length(t) >= 3])"
_SIMPLE = r"lower(list_last(string_split_regex(regexp_replace(qualified_name, '[.#:$]+$', ''), '[.#:$]')))"
_REUSE = _GS + _SHARED + f""", direct AS (SELECT DISTINCT CASE WHEN a.stable_key IS NOT NULL THEN to_key ELSE from_key END AS stable_key FROM edges LEFT JOIN changes a ON a.stable_key = from_key LEFT JOIN changes b ON b.stable_key = to_key WHERE type_resolved AND (a.stable_key IS NULL) <> (b.stable_key IS NULL)),
tk AS (SELECT DISTINCT unnest({_TOKENS}) AS t FROM changes), ov AS (SELECT stable_key, count(*) AS overlap FROM (SELECT stable_key, unnest({_TOKENS}) AS t FROM gs WHERE in_head) JOIN tk USING (t) GROUP BY 1),
f AS (SELECT gs.stable_key, qualified_name, test_source AND direct.stable_key IS NOT NULL AS fixture, {_SIMPLE} IN (SELECT {_SIMPLE} FROM changes) AS name, kind IN (SELECT kind FROM changes) AS kd, shared.candidate_key IS NOT NULL AS called, coalesce(overlap, 0) AS overlap
  FROM gs LEFT JOIN direct ON direct.stable_key = gs.stable_key LEFT JOIN shared ON candidate_key = gs.stable_key LEFT JOIN ov ON ov.stable_key = gs.stable_key WHERE in_head AND gs.stable_key NOT IN (SELECT stable_key FROM changes)),
t AS (SELECT stable_key, qualified_name, CASE WHEN fixture THEN 'test_fixture' WHEN name AND kd THEN 'same_contract' WHEN called AND kd THEN 'same_role' WHEN called THEN 'caller_pattern' WHEN overlap >= 1 AND kd THEN 'similar_logic' END AS tier, overlap FROM f)
SELECT stable_key, qualified_name, tier, CASE tier WHEN 'same_contract' THEN 'direct' WHEN 'test_fixture' THEN 'extendable' WHEN 'same_role' THEN 'extendable' ELSE 'partial' END AS fit, CAST(CASE tier WHEN 'test_fixture' THEN 0.90 WHEN 'same_contract' THEN 0.95 WHEN 'same_role' THEN 0.84 WHEN 'caller_pattern' THEN 0.72 ELSE round(least(0.69, 0.50 + 0.08 * overlap), 2) END AS DOUBLE) AS score FROM t WHERE tier IS NOT NULL ORDER BY score DESC, qualified_name, stable_key"""


@query("reuse_candidates", _REUSE + " LIMIT 12")
def reuse_candidates(s, d):
    return graph.reuse_candidates(A.graph_symbols(s, d, True), A.changes(s, d), A.edges(s, d))


@query("reuse_candidates_small", _REUSE + " LIMIT 8")
def reuse_candidates_small(s, d):
    """The variant without an inheritance tier, the eight best."""
    return graph.reuse_candidates(A.graph_symbols(s, d, True), A.changes(s, d), A.edges(s, d), 8, inheritance=False)


@query("index_equality", _SYM + " SELECT (SELECT count(*) FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM head)) AS missing, (SELECT count(*) FROM (SELECT * FROM head EXCEPT ALL SELECT * FROM base)) AS extra")
def index_equality(s, d):
    return graph.snapshot_difference(A.symbols(s, d, False), A.symbols(s, d, True))


# --- evaluation ------------------------------------------------------------------------------------------------------

_PRED = "WITH predicted AS (SELECT doc_id, source AS category FROM documents WHERE regexp_matches(text, '[#$%&!]{2}')), expected AS (SELECT l.doc_id, source AS category FROM labels l JOIN documents USING (doc_id) WHERE quality = 0)"


def _predicted(s, d):
    return table(s, d, "documents").filter(F.col("text").rlike("[#$%&!]{2}")).select("doc_id", F.col("source").alias("category"))


def _expected(s, d):
    return table(s, d, "labels").filter("quality = 0").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", F.col("source").alias("category"))


_Z = f"CAST({T.Z95} AS DOUBLE)"
_WILSON = f"round(greatest(0.0, least(1.0, (p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z} * sqrt((p*(1-p) + {_Z}*{_Z}/(4*n))/n) / (1 + {_Z}*{_Z}/n))), 4) AS precision_low, round(greatest(0.0, least(1.0, (p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z} * sqrt((p*(1-p) + {_Z}*{_Z}/(4*n))/n) / (1 + {_Z}*{_Z}/n))), 4) AS precision_high"
_METRICS = _PRED + f", c AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND e.doc_id IS NOT NULL) AS tp, count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM (SELECT DISTINCT * FROM predicted) p FULL JOIN (SELECT DISTINCT * FROM expected) e ON p.doc_id = e.doc_id AND p.category = e.category), m AS (SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, {_WILSON} FROM (SELECT *, CAST(tp + fp AS DOUBLE) AS n, tp / CAST(tp + fp AS DOUBLE) AS p FROM c))"


@query("replay_metrics", _METRICS + " SELECT * FROM m")
def replay_metrics(s, d):
    return evaluation.set_counts(_predicted(s, d), _expected(s, d), ["doc_id", "category"])


@query("category_metrics", _PRED + ", a AS (SELECT p.category, count(*) AS predicted, count(e.doc_id) AS tp FROM predicted p LEFT JOIN (SELECT DISTINCT * FROM expected) e USING (doc_id, category) GROUP BY 1), b AS (SELECT category, count(*) AS expected FROM expected GROUP BY 1) SELECT category, coalesce(predicted, 0) AS predicted, coalesce(expected, 0) AS expected, coalesce(tp, 0) AS tp FROM a FULL JOIN b USING (category)")
def category_metrics(s, d):
    return evaluation.category_counts(_predicted(s, d), _expected(s, d), ["doc_id", "category"], "category")


@query("mismatches", _PRED + " SELECT doc_id, category, 'false_positive' AS kind FROM predicted p WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.doc_id = p.doc_id) UNION ALL SELECT doc_id, category, 'false_negative' FROM expected e WHERE NOT EXISTS (SELECT 1 FROM predicted p WHERE e.doc_id = p.doc_id)")
def mismatches(s, d):
    p, e = _predicted(s, d), _expected(s, d)
    return p.join(e.select("doc_id"), "doc_id", "left_anti").withColumn("kind", F.lit("false_positive")).unionByName(e.join(p.select("doc_id"), "doc_id", "left_anti").withColumn("kind", F.lit("false_negative")))


@query("benchmark_gate", _METRICS + ", n AS (SELECT count(*) AS cases, count(*) FILTER (quality = 0) AS positive, count(*) FILTER (quality = 1) AS negative FROM labels), t AS (SELECT round(max(CASE WHEN k = ceil(c * 0.95) THEN value END), 2) AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS c FROM events WHERE value IS NOT NULL)) SELECT tp, fp, fn, cases, positive, negative, p95, failures, failures = '' AS passed FROM (SELECT *, concat_ws(',', CASE WHEN NOT cases >= 100 THEN 'cases' END, CASE WHEN NOT positive >= 20 THEN 'positive' END, CASE WHEN NOT negative >= 20 THEN 'negative' END, CASE WHEN NOT precision >= 0.8 THEN 'precision' END, CASE WHEN NOT recall >= 0.7 THEN 'recall' END, CASE WHEN NOT p95 <= 1000 THEN 'latency' END) AS failures FROM m, n, t)")
def benchmark_gate(s, d):
    cases = table(s, d, "labels").agg(F.count("*").alias("cases"), F.count_if(F.col("quality") == 0).alias("positive"), F.count_if(F.col("quality") == 1).alias("negative"))
    times = evaluation.nearest_rank(table(s, d, "events").select("value", F.lit(1).alias("k")), "value", {"p95": 0.95}, ["k"])
    one = lambda x: x.withColumn("k", F.lit(1))
    metrics = one(replay_metrics(s, d)).join(one(cases), "k").join(times.drop("n"), "k")
    return evaluation.gate(metrics, evaluation.BENCHMARK).select("tp", "fp", "fn", "cases", "positive", "negative", "p95", "failures", "passed")


@query("latency_percentiles", "SELECT event_type, max(n) AS n, round(max(CASE WHEN k = ceil(n * 0.5) THEN value END), 2) AS p50, round(max(CASE WHEN k = ceil(n * 0.95) THEN value END), 2) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1")
def latency_percentiles(s, d):
    return evaluation.nearest_rank(table(s, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


@query("readiness", "SELECT completed, failed, queued, rate, completed + failed >= 20 AND rate >= 0.95 AS ready FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS queued, round(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) FILTER (o_orderstatus IN ('F', 'P')) AS DOUBLE), 4) AS rate FROM orders)")
def readiness(s, d):
    n = lambda x: F.count_if(F.col("o_orderstatus").isin(*x))
    out = table(s, d, "orders").agg(n("F").alias("completed"), n("P").alias("failed"), n("O").alias("queued"), evaluation.share(n("F"), n("FP")).alias("rate"))
    return out.withColumn("ready", (F.col("completed") + F.col("failed") >= 20) & (F.col("rate") >= 0.95))


_FACTS = "WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 40), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.01)"


def _facts(s, d):
    line = table(s, d, "lineitem")
    return tuple(line.filter(x).select("l_orderkey", "l_partkey") for x in ("l_quantity < 40", "l_discount > 0.01"))


@query("tool_agreement", _FACTS + " SELECT *, round(agreed / CAST(agreed + only_first + only_second AS DOUBLE), 4) AS rate FROM (SELECT count(*) FILTER (x AND y) AS agreed, count(*) FILTER (y IS NULL) AS only_first, count(*) FILTER (x IS NULL) AS only_second FROM (SELECT *, true AS x FROM a) FULL JOIN (SELECT *, true AS y FROM b) USING (l_orderkey, l_partkey))")
def tool_agreement(s, d):
    return evaluation.agreement(*_facts(s, d), ["l_orderkey", "l_partkey"])


@query("conflict_count", _FACTS + " SELECT count(*) AS facts, count(*) FILTER (n < 2) AS conflicts FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)")
def conflict_count(s, d):
    a, b = _facts(s, d)
    return evaluation.conflicts(a.withColumn("r", F.lit(1)).unionByName(b.withColumn("r", F.lit(2))), ["l_orderkey", "l_partkey"], "r", 2)


@query("review_queue", _FACTS + " SELECT l_orderkey, l_partkey, 'disagreement' AS reason FROM a FULL JOIN b USING (l_orderkey, l_partkey) WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM a INTERSECT SELECT (l_orderkey, l_partkey) FROM b) UNION ALL SELECT l_orderkey, l_partkey, 'sample' FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey) - 1 AS k FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) WHERE k % 20 = 0")
def review_queue(s, d):
    return evaluation.review_queue(*_facts(s, d), ["l_orderkey", "l_partkey"], 20)


@query("holdout_sample", "SELECT doc_id, source, sha256('policy-1' || chr(10) || source || chr(10) || doc_id) AS sample_rank FROM documents WHERE len(string_split(text, chr(10))) BETWEEN 3 AND 60 ORDER BY 3 LIMIT 50")
def holdout_sample(s, d):
    rows = table(s, d, "documents").filter(F.size(F.split("text", "\n")).between(3, 60)).select("doc_id", "source")
    return evaluation.hash_sample(rows, "policy-1", ["source", "doc_id"], 50)


_LANES = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS HUGEINT)) AS VARCHAR)" for k in range(4))


@query("table_fingerprint", f"WITH x AS (SELECT sha256(CAST(to_json({{'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size}}) AS VARCHAR)) AS h FROM part) SELECT sha256(CAST(count(*) AS VARCHAR) || ':' || {_LANES}) AS fingerprint, count(*) AS n_rows FROM x")
def table_fingerprint(s, d):
    return evaluation.fingerprint_of(table(s, d, "part").select("p_partkey", "p_name", "p_size"))


# --- state -----------------------------------------------------------------------------------------------------------


@query("delivery_outcomes", "WITH x AS (SELECT event_id, 'd' || (event_id % 1000) AS delivery_id, event_type, sha256(event_type) AS h FROM events) SELECT event_id, delivery_id, CASE WHEN n = 1 THEN 'accepted' WHEN h = f THEN 'duplicate' ELSE 'conflict' END AS outcome FROM (SELECT *, row_number() OVER w AS n, first_value(h) OVER w AS f FROM x WINDOW w AS (PARTITION BY delivery_id ORDER BY event_id))")
def delivery_outcomes(s, d):
    rows = table(s, d, "events").select("event_id", F.concat(F.lit("d"), (F.col("event_id") % 1000).cast("string")).alias("delivery_id"), "event_type")
    return state.deliveries(rows, "delivery_id", ["event_type"], ["event_id"]).select("event_id", "delivery_id", "outcome")


@query("rate_limit_windows", "SELECT event_id, user_id, CAST(w AS BIGINT) AS window_start, row_number() OVER (PARTITION BY user_id, w ORDER BY event_id) <= 2 AS allowed FROM (SELECT *, floor(epoch(ts) / 86400) * 86400 AS w FROM events)")
def rate_limit_windows(s, d):
    return state.rate_limited(table(s, d, "events"), "user_id", "ts", ["event_id"], 2, 86400).select("event_id", "user_id", F.col("window_start").cast("long").alias("window_start"), "allowed")


_LEASE = "SELECT o_orderkey, attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END AS status, CAST(2 * pow(2, attempts) AS BIGINT) AS delay FROM (SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS BIGINT) AS attempts FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00')"


@query("lease_expiry", _LEASE)
def lease_expiry(s, d):
    jobs = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed").alias("status"), (F.col("o_orderkey") % 3).alias("attempts"), F.col("o_orderdate").alias("lease_expires_at"))
    out = state.expire_leases(jobs, F.lit("1998-01-01 00:00:00").cast("timestamp"))
    return out.select("o_orderkey", "attempts", "status", state.retry_delay(F.col("attempts")).alias("delay"))


@query("budget_admission", "WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), r AS (SELECT conv_id, turn, chars, n, chars <= 1500 AS admitted, CASE WHEN chars <= 1500 THEN 1 ELSE 0 END AS calls, CASE WHEN chars <= 1500 THEN chars ELSE 0 END AS used FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.chars, c.n, r.calls < 4 AND r.used + c.chars <= 1500, r.calls + CASE WHEN r.calls < 4 AND r.used + c.chars <= 1500 THEN 1 ELSE 0 END, r.used + CASE WHEN r.calls < 4 AND r.used + c.chars <= 1500 THEN c.chars ELSE 0 END FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1) SELECT conv_id, turn, chars, admitted FROM r")
def budget_admission(s, d):
    return state.admit_by_budget(table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars")), "conv_id", "turn", "chars", 4, 1500)


@query("budget_spend", "SELECT conv_id, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY 1")
def budget_spend(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("latest_runs", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_runs(s, d):
    return state.latest(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("stale_runs", "SELECT o_orderkey, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) < o_orderdate + INTERVAL 30 DAY, false) AS stale FROM orders")
def stale_runs(s, d):
    rows = table(s, d, "orders").withColumn("done", F.expr("o_orderdate + INTERVAL 30 DAY"))
    return state.superseded(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "done").select("o_orderkey", "stale")


@query("retention_counts", f"SELECT o_orderstatus, count(*) AS total, count(*) FILTER (NOT o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 365 DAY) AS kept FROM orders GROUP BY 1")
def retention_counts(s, d):
    orders = table(s, d, "orders")
    kept = state.retained(orders, "o_orderdate", F.lit(NOW).cast("timestamp"), 365).groupBy("o_orderstatus").agg(F.count("*").alias("kept"))
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("total")).join(kept, "o_orderstatus", "left").select("o_orderstatus", "total", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


@query("repository_deletion_counts", "SELECT 'orders' AS relation, count(*) AS removed FROM orders WHERE o_custkey % 100 = 7 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 100 = 7)")
def repository_deletion_counts(s, d):
    gone = table(s, d, "orders").filter("o_custkey % 100 = 7").select("o_orderkey")
    lines = table(s, d, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return gone.agg(F.count("*").alias("removed")).select(F.lit("orders").alias("relation"), "removed").unionByName(lines.agg(F.count("*").alias("removed")).select(F.lit("lineitem").alias("relation"), "removed"))


@query("upsert_merge", "SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(n.p_name, o.p_name) AS p_name, coalesce(n.p_size, o.p_size) AS p_size FROM (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE upper(p_name) END AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 5 = 0) n USING (p_partkey)")
def upsert_merge(s, d):
    part = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    new = part.filter("p_partkey % 5 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 != 0, F.upper("p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return state.upsert(part.filter("p_partkey % 3 <> 0"), new, ["p_partkey"])


@query("feedback_match", "WITH x AS (SELECT o_orderkey, o_custkey % 20 AS repository_id, sha256('f' || o_orderkey) AS fingerprint, o_orderdate AS created_at, o_orderstatus FROM orders), f AS (SELECT o_orderkey AS comment_id, repository_id, substr(fingerprint, 1, 14) AS prefix FROM x WHERE o_orderkey % 3 <> 0) SELECT comment_id, fingerprint FROM (SELECT comment_id, fingerprint, row_number() OVER (PARTITION BY comment_id ORDER BY created_at DESC, fingerprint DESC) AS n FROM f JOIN x ON substr(fingerprint, 1, 14) = prefix AND x.repository_id = f.repository_id AND o_orderstatus = 'F') WHERE n = 1")
def feedback_match(s, d):
    found = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("repository_id"), F.sha2(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), 256).alias("fingerprint"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected").alias("status"))
    comments = found.select(F.col("o_orderkey").alias("comment_id"), "repository_id", F.substring("fingerprint", 1, 14).alias("prefix"))
    seen = comments.filter("comment_id % 3 = 0")
    return state.feedback_matches(comments, found.drop("o_orderkey"), ["repository_id"], seen)


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("redact_plain", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '-----BEGIN [^-]+-----[\\s\\S]*?-----END [^-]+-----', '[REDACTED_PEM]', 'g'), '(?i)bearer\\s+[a-z0-9._~+/-]{8,}', 'Bearer [REDACTED]', 'g'), '(?i)(api[_-]?key|token|secret|password|private[_-]?key)(\\s*[:=]\\s*)[^\\s,;]+', '\\1\\2[REDACTED]', 'g') AS text FROM documents")
def redact_plain(s, d):
    return table(s, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query("redact_vendor", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED AWS ACCESS KEY]', 'g'), '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{16,}\\b', 'Bearer [REDACTED]', 'g'), '(?i)(\\b(?:password|passwd|api[_-]?key|secret|access[_-]?token)\\b\\s*[:=]\\s*[''\"]?)[^''\"\\s,;]{8,}([''\"]?)', '\\1[REDACTED]\\2', 'g') AS text FROM documents")
def redact_vendor(s, d):
    return table(s, d, "documents").select("doc_id", T.redact(F.col("text"), T.VENDOR_REDACTIONS).alias("text"))


_PATHS = "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)"


def _page_paths(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))


@query("safe_paths", _PATHS + " SELECT page_id, path <> '' AND position(chr(92) IN path) = 0 AND NOT regexp_matches(path, '^[A-Za-z]:') AND len([x FOR x IN string_split(path, '/') IF x IN ('', '.', '..')]) = 0 AS safe FROM p")
def safe_paths(s, d):
    return _page_paths(s, d).select("page_id", T.is_safe_path(F.col("path")).alias("safe"))


@query("glob_policy", "SELECT doc_id, regexp_matches(p, '^src1[^/]*/.*$') AND NOT regexp_matches(p, '^(?:.*/)?[^/]*\\.fr$') AS included FROM (SELECT doc_id, source || '/' || doc_id || '.' || lang AS p FROM documents)")
def glob_policy(s, d):
    return A.patches(s, d).select("doc_id", T.path_included(F.col("path"), ["src1*/**"], ["**/*.fr"]).alias("included"))


def _listed(value: str, rows) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{n}'" for n, p in rows) + " END"


_NAMES = ("src/a.go", "src/B.java", "lib/c.TSX", "test/d.py", "x/e_spec.rb", "docs/f.md", "pom.xml", "conf/g.yaml", "h.rs", "src/test/i.kt", "j.cc", "k.swift", "l.bin", "web/m.mjs", "n.phtml", "o.cs", "p.h")
_MADE = f"WITH m AS (SELECT doc_id, source || '/' || ([{', '.join(repr(x) for x in _NAMES)}])[1 + doc_id % {len(_NAMES)}] AS path FROM documents)"


def _made_paths(s, d):
    return table(s, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (1 + F.col("doc_id") % len(_NAMES)).cast("int"))).alias("path"))


@query("language_and_role", f"{_MADE} SELECT doc_id, {_listed('lower(path)', T.LANGUAGES)} AS language, coalesce({_listed('lower(path)', T.ROLES)}, 'other') AS role FROM m")
def language_and_role(s, d):
    return _made_paths(s, d).select("doc_id", T.language_of_path(F.col("path")).alias("language"), T.file_role(F.col("path")).alias("role"))


@query("name_tokens", "SELECT DISTINCT p_partkey, t AS token FROM (SELECT p_partkey, unnest(string_split_regex(lower(regexp_replace(p_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS t FROM part) WHERE length(t) >= 3")
def name_tokens(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(T.name_tokens(F.col("p_name"))).alias("token"))


@query("content_hashes", "SELECT p_partkey, sha256(p_type || p_name) AS content_hash FROM part")
def content_hashes(s, d):
    return table(s, d, "part").select("p_partkey", F.sha2(F.concat("p_type", "p_name"), 256).alias("content_hash"))


# --- review ----------------------------------------------------------------------------------------------------------


@query("truth_set_eval", "WITH e AS (SELECT DISTINCT l_returnflag AS repo, l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 40), a AS (SELECT DISTINCT l_returnflag AS repo, l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.01), r AS (SELECT repo, count(*) FILTER (x AND y) AS tp, count(*) FILTER (y IS NULL) AS fp, count(*) FILTER (x IS NULL) AS fn FROM (SELECT *, true AS x FROM a) FULL JOIN (SELECT *, true AS y FROM e) USING (repo, l_orderkey, l_partkey) GROUP BY repo), u AS (SELECT * FROM r UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM r) SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision FROM u")
def truth_set_eval(s, d):
    line = table(s, d, "lineitem").withColumn("repo", F.col("l_returnflag"))
    return review.truth_set(line.filter("l_quantity < 40"), line.filter("l_discount > 0.01"), ["l_orderkey", "l_partkey"], "repo")


@query("coverage_levels", "WITH f AS (SELECT p_brand, CASE WHEN p_size > 45 THEN 'skipped' WHEN p_size < 3 THEN 'absent' WHEN p_size = 20 THEN 'failed' ELSE 'indexed' END AS status FROM part), c AS (SELECT p_brand, count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'absent') AS absent, count(*) FILTER (status = 'failed') AS failed FROM f GROUP BY 1) SELECT *, CASE WHEN indexed = 0 THEN 'FAILED' WHEN failed > 0 OR skipped > 0 THEN 'PARTIAL' ELSE 'SEMANTIC' END AS level FROM c")
def coverage_levels(s, d):
    status = F.when(F.col("p_size") > 45, "skipped").when(F.col("p_size") < 3, "absent").when(F.col("p_size") == 20, "failed").otherwise("indexed")
    return review.coverage_level(table(s, d, "part").select("p_brand", status.alias("status")), "p_brand")


@query("decision_gate", "SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_totalprice <= 200000 THEN 'budget' END, CASE WHEN NOT o_orderstatus <> 'P' THEN 'state' END, CASE WHEN NOT o_orderpriority NOT LIKE '5%' THEN 'priority' END) AS reasons FROM orders")
def decision_gate(s, d):
    checks = [("budget", F.col("o_totalprice") <= 200000), ("state", F.col("o_orderstatus") != "P"), ("priority", ~F.col("o_orderpriority").startswith("5"))]
    return table(s, d, "orders").select("o_orderkey", review.reasons(checks).alias("reasons"))


@query("decision_history", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS revision, lead(o_orderkey) OVER w IS NOT NULL AS superseded FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def decision_history(s, d):
    return review.decision_history(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("quota_shortfall", """WITH RECURSIVE t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM labels JOIN documents USING (doc_id)), z AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source) AS n FROM t GROUP BY 1), q AS (SELECT CAST(ceil(300 / count(*)) AS BIGINT) AS quota FROM z),
r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS carried, 0::BIGINT AS taken, NULL::VARCHAR AS source, 0::BIGINT AS take UNION ALL SELECT z.n, quota + carried - least(quota + carried, 300 - taken, size), taken + least(quota + carried, 300 - taken, size), z.source, least(quota + carried, 300 - taken, size) FROM r JOIN z ON z.n = r.n + 1, q)
SELECT source, doc_id FROM t JOIN r USING (source) WHERE k <= take""")
def quota_shortfall(s, d):
    return review.quota_sample(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id"), "source", "doc_id", 300)


@query("interleaved_queue", "WITH t AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM labels), r AS (SELECT doc_id, quality = 0 AS positive, row_number() OVER (PARTITION BY quality = 0 ORDER BY doc_id) - 1 AS k FROM labels WHERE quality IS NOT NULL), q AS (SELECT r.*, t.n AS p, greatest(1, t.p // t.n) AS each FROM r, t) SELECT doc_id, positive, CAST(CASE WHEN positive THEN k * (each + 1) WHEN k // each < p THEN (k // each) * (each + 1) + 1 + k % each ELSE k + p END AS BIGINT) AS place FROM q")
def interleaved_queue(s, d):
    return review.interleaved(table(s, d, "labels").filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("positive")), "positive", "doc_id")


@query("manifest_check", "WITH a AS (SELECT n_name AS name, sha256(n_name) AS checksum FROM nation WHERE n_nationkey % 7 <> 0), e AS (SELECT n_name AS name, sha256(n_name || CASE WHEN n_nationkey % 5 = 0 THEN '!' ELSE '' END) AS checksum FROM nation WHERE n_nationkey % 6 <> 0) SELECT * FROM (SELECT name, CASE WHEN e.checksum IS NULL THEN 'unknown' WHEN a.checksum IS NULL THEN 'missing' WHEN a.checksum <> e.checksum THEN 'mismatch' END AS problem FROM a FULL JOIN e USING (name)) WHERE problem IS NOT NULL")
def manifest_check(s, d):
    nation = table(s, d, "nation")
    applied = nation.filter("n_nationkey % 7 <> 0").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("checksum"))
    expected = nation.filter("n_nationkey % 6 <> 0").select(F.col("n_name").alias("name"), F.sha2(F.concat("n_name", F.when(F.col("n_nationkey") % 5 == 0, "!").otherwise("")), 256).alias("checksum"))
    return review.manifest_check(applied, expected)


@query("markdown_rules", "WITH l AS (SELECT source, doc_id, k, trim(regexp_extract(ls[k], '^\\s*[-*]\\s+(.+)$', 1)) AS rule FROM (SELECT CAST(doc_id AS VARCHAR) AS source, doc_id, string_split(substr(text, 1, 20000), chr(10)) AS ls, unnest(range(1, len(string_split(substr(text, 1, 20000), chr(10))) + 1)) AS k FROM (SELECT doc_id, '- ' || replace(text, chr(10), chr(10) || '* ') AS text FROM documents))) SELECT source, ordinal, 'md-' || substr(sha256(rule), 1, 12) AS rule_key, rule FROM (SELECT source, rule, CAST(row_number() OVER (PARTITION BY source ORDER BY k) AS INT) AS ordinal FROM l WHERE rule <> '') WHERE ordinal <= 100")
def markdown_rules(s, d):
    return review.markdown_rules(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n* ")).alias("text")))


@query("unreferenced_snapshots", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def unreferenced_snapshots(s, d):
    line = table(s, d, "lineitem")
    return review.unreferenced(table(s, d, "part").select(F.col("p_partkey").alias("id")), line.select(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("base_id"), F.col("l_suppkey").alias("head_id")))


@query("audit_outcomes", "SELECT o_orderkey, coalesce(upper(stage), 'PENDING') AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, min(CASE WHEN l_linestatus = 'F' THEN 'committed' ELSE 'denied' END) AS stage FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey")
def audit_outcomes(s, d):
    ended = table(s, d, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.when(F.col("l_linestatus") == "F", "committed").otherwise("denied")).alias("stage"))
    return review.audit_outcome(table(s, d, "orders").select("o_orderkey"), ended, ["o_orderkey"])


def _kind_latencies(k: str) -> str:
    at = lambda p: f"round(max(CASE WHEN kind = '{k}' AND r = ceil(n * {p}) THEN ms END), 2)"
    return f"{at(0.5)} AS {k}_p50, {at(0.95)} AS {k}_p95, round(max(CASE WHEN kind = '{k}' THEN ms END), 2) AS {k}_max"


@query("load_summary", f"WITH s AS (SELECT event_type, value AS ms, CASE event_id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'failures' ELSE 'completed' END AS kind FROM events WHERE value IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY event_type, kind ORDER BY ms) AS r, count(*) OVER (PARTITION BY event_type, kind) AS n FROM s) SELECT event_type, count(*) AS requests, count(*) FILTER (kind = 'completed') AS completed, count(*) FILTER (kind = 'rejected') AS rejected, count(*) FILTER (kind = 'failures') AS failures, round(count(*) FILTER (kind = 'completed') * 1000.0::DOUBLE / 60000.0::DOUBLE, 4) AS completed_per_second, {_kind_latencies('completed')}, {_kind_latencies('rejected')}, {_kind_latencies('failures')} FROM o GROUP BY 1")
def load_summary(s, d):
    status = F.when(F.col("event_id") % 5 == 0, 409).when(F.col("event_id") % 5 == 1, 500).otherwise(200)
    return evaluation.load_summary(table(s, d, "events").filter("value IS NOT NULL").select("event_type", "value", status.alias("status")), "status", "value", 60_000.0, ["event_type"])


@query("change_groups", "WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)), f AS (SELECT l_orderkey, min('part:' || l_partkey) AS b FROM l GROUP BY 1), t AS (SELECT DISTINCT 'part:' || l_partkey AS a, b FROM l JOIN f USING (l_orderkey)), e AS (SELECT a, b FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b), g(path, grp) USING KEY (path) AS (SELECT 'part:' || p_partkey, 'part:' || p_partkey FROM part UNION SELECT e.a, min(v.grp) FROM recurring.g AS u JOIN e ON e.a = u.path JOIN recurring.g AS v ON v.path = e.b WHERE v.grp < u.grp GROUP BY e.a) SELECT path, grp AS \"group\" FROM g")
def change_groups(s, d):
    """Groups of all parts that lines of one order tie: each order ties its parts to its smallest one."""
    parts = table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("l_partkey"))
    return review.tied_groups(parts, table(s, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("fact_audit", _GS + " SELECT count(*) AS calls, count(*) FILTER (c.stable_key IS NOT NULL AND b.stable_key IS NULL) AS from_unchanged, count(DISTINCT from_key) FILTER (c.stable_key IS NOT NULL AND b.stable_key IS NULL) AS callers, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> o_custkey % 100) AS annotation_mismatches FROM edges LEFT JOIN changes c ON c.stable_key = to_key LEFT JOIN changes b ON b.stable_key = from_key WHERE type = 'CALLS' AND type_resolved")
def fact_audit(s, d):
    notes = table(s, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("from_key"), F.lit("note").alias("to_key"), F.lit("ANNOTATED_WITH").alias("type"), F.lit(1.0).alias("confidence"), F.col("o_orderkey").alias("ord"), F.lit(True).alias("type_resolved"), F.concat(F.lit("order/"), (F.col("o_custkey") % 100).cast("string")).alias("source_path"))
    return graph.fact_audit(A.edges(s, d).withColumn("source_path", F.lit(None).cast("string")).unionByName(notes), A.changes(s, d), A.graph_symbols(s, d, True))


from patchloom.plans import families, impacts, landings, languages, streams  # noqa: E402,F401 (registers the other families)
