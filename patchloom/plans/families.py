"""Registered queries of policy, admission, job, packet, source and scalar operators, each with its SQL for DuckDB where SQL can say it.

The star-schema tables stand in for runs, jobs, events and cases; derivations are the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import diff, findings, graph, jobs, packets, policy, review, rules, state, symbols
from patchloom.plans import adapters as A
from patchloom.plans.catalog import _EDG, _GS, _ORD_SQL, _PAT, _SYM, NOW, ORACLES, query
from patchloom.sources import context
from patchloom.sources.tables import table

_ts = lambda text: F.lit(text).cast("timestamp")
_text = lambda c: F.col(c).cast("string")


def _fail(*checks: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks) + ")"


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("is_high_risk_path", f"SELECT doc_id, regexp_matches(p, '{T.HIGH_RISK_PATH}') AS high_risk, regexp_matches(p, '{T.TEST_PATH}') AS test FROM (SELECT doc_id, (['src/auth/a.ts', 'lib/b.ts', 'payment/c.go', 'x/database.sql', 'tests/d.ts', 'e_test.go'])[1 + doc_id % 6] AS p FROM documents)")
def is_high_risk_path(s, d):
    names = F.array(*[F.lit(x) for x in ("src/auth/a.ts", "lib/b.ts", "payment/c.go", "x/database.sql", "tests/d.ts", "e_test.go")])
    rows = table(s, d, "documents").select("doc_id", F.element_at(names, (1 + F.col("doc_id") % 6).cast("int")).alias("p"))
    return rows.select("doc_id", T.is_high_risk_path(F.col("p")).alias("high_risk"), T.is_test_path(F.col("p")).alias("test"))


@query("path_parts", "SELECT page_id, regexp_extract(p, '[^/]*$') AS base, regexp_replace(p, '/?[^/]*$', '') AS folder, lower(regexp_extract(p, '[^/](\\.[^./]*)$', 1)) AS extension FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)")
def path_parts(s, d):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return table(s, d, "pages").select("page_id", T.base_name(p).alias("base"), T.folder_of(p).alias("folder"), T.extension_of(p).alias("extension"))


@query("evidence_ids", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE 'evidence:sha256:' || sha256(text) END AS evidence_id FROM documents WHERE text IS NOT NULL")
def evidence_ids(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.evidence_id(F.col("text")).alias("evidence_id"))


@query("embedded_json", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{\"k\": ' || o_orderkey || '}' WHEN 1 THEN '[' || o_custkey || ']' ELSE '{\"c\": ' || o_custkey || '}' END AS body FROM orders")
def embedded_json(s, d):
    k, c = _text("o_orderkey"), _text("o_custkey")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('Here:\n```json\n{"k": '), k, F.lit("}\n```\nand ```\n[]\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("```\n["), c, F.lit("]\n```"))).otherwise(F.concat(F.lit('  {"c": '), c, F.lit("}\n")))
    return table(s, d, "orders").select("o_orderkey", T.embedded_json(said).alias("body"))


@query("canonical_digests", "SELECT o_orderkey, sha256('{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def canonical_digests(s, d):
    return table(s, d, "orders").select("o_orderkey", T.canonical_digest({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "none": F.lit(None).cast("string")}).alias("digest"))


@query("scope_hashes", "SELECT l_orderkey, sha256(array_to_string(list_sort(list(DISTINCT 'part/' || l_partkey)), chr(10))) AS scope_hash FROM lineitem GROUP BY 1")
def scope_hashes(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(T.scope_hash(F.collect_set(F.concat(F.lit("part/"), _text("l_partkey")))).alias("scope_hash"))


@query("evaluation_categories", "SELECT p_partkey, replace(CASE WHEN c <> '' THEN c WHEN r LIKE 'human/%' THEN substr(r, 7) ELSE split_part(r, '/', 1) END, '-', '_') AS category FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'data-integrity' WHEN 1 THEN '' END AS c, CASE p_partkey % 2 WHEN 0 THEN 'human/test-gap' ELSE 'go/security/x' END AS r FROM part)")
def evaluation_categories(s, d):
    category = F.when(F.col("p_partkey") % 3 == 0, "data-integrity").when(F.col("p_partkey") % 3 == 1, "")
    rule = F.when(F.col("p_partkey") % 2 == 0, "human/test-gap").otherwise("go/security/x")
    return table(s, d, "part").select("p_partkey", T.evaluation_category(category, rule).alias("category"))


@query("http_retry_delays", "SELECT event_id, CAST(floor(least(10000.0, greatest(CASE WHEN event_id % 4 = 0 THEN 3000.0 ELSE 0.0 END, 250.0 * pow(2.0, event_id % 7)) * (0.8 + (event_id % 5) * 0.1)) + 0.5) AS BIGINT) AS delay FROM events")
def http_retry_delays(s, d):
    hint = F.when(F.col("event_id") % 4 == 0, 3000)
    return table(s, d, "events").select("event_id", jobs.http_retry_delay(F.col("event_id") % 7 + 1, hint, F.lit(0.8) + (F.col("event_id") % 5) * 0.1).alias("delay"))


@query("canonical_calls", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'java:a.B#<init>(java.lang.Object,int)' WHEN 1 THEN 'java:a.Box#get()' WHEN 2 THEN 'java:a.M#put(java.util.Map,java.lang.Object)' ELSE 'unresolved:x' END AS to_key, 'java:callsite:p/' || p_partkey || ':' || p_size AS from_key FROM part")
def canonical_calls(s, d):
    from patchloom.operators import evaluation

    key = F.when(F.col("p_partkey") % 4 == 0, "java:a.B<T>#<init>(T,int)").when(F.col("p_partkey") % 4 == 1, "java:a.Box<java.util.List<T>>#get()").when(F.col("p_partkey") % 4 == 2, "java:a.M#put(java.util.Map<K,java.util.List<V>>,V)").otherwise("unresolved:x")
    facts = table(s, d, "part").select("p_partkey", F.concat(F.lit("p/"), _text("p_partkey")).alias("source_path"), F.col("p_size").alias("line"), key.alias("to_key"))
    return evaluation.canonical_facts(facts).select(F.regexp_extract("source_path", "([0-9]+)$", 1).cast("long").alias("p_partkey"), "to_key", "from_key")


# --- diffs, rules, findings ------------------------------------------------------------------------------------------


@query("changed_line_sets", f"{_PAT} SELECT DISTINCT path, CASE kind WHEN 'added' THEN 'RIGHT' ELSE 'LEFT' END AS side, CAST(CASE kind WHEN 'added' THEN right_line ELSE left_line END AS INT) AS line FROM lines WHERE kind <> 'context'")
def changed_line_sets(s, d):
    return diff.changed_line_sets(A.patches(s, d))


_CODE = ("eval(x)", "const f = new Function('a')", "items.forEach(async (i) => {})", "try { a() } catch (e) {}", 'const password = "hunter2hunter2"', "db.query(`select ${id}`)", "json.Unmarshal(b, &v)", "resp, err := http.Get(u)", "cfg := tls.Config{InsecureSkipVerify: true}", "os.Chmod(p, 0777)", "ctx, _ := context.WithTimeout(c, t)", "rows := db.Query(fmt.Sprintf(q, x))", "  http.ListenAndServe(a, h)", "return a + b", 'exec.Command("sh", "-c", fmt.Sprintf(c, a))')
_FILES = ("src/m.go", "src/m_test.go", "lib/app.ts", "tests/app.ts")
_sql = lambda x: "'" + x.replace("'", "''") + "'"
_CODE_SQL = f"code AS (SELECT p_partkey, p_partkey || '/' || ([{', '.join(map(_sql, _FILES))}])[1 + p_partkey % {len(_FILES)}] AS path, CAST(10 + p_partkey % 7 AS INT) AS right_line, ([{', '.join(map(_sql, _CODE))}])[1 + p_partkey % {len(_CODE)}] AS content FROM part)"
_TEST = T.TEST_PATH.replace("'", "''")


def _code(s, d):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + F.col("p_partkey") % len(xs)).cast("int"))
    return table(s, d, "part").select("p_partkey", F.concat(_text("p_partkey"), F.lit("/"), pick(_FILES)).alias("path"), (10 + F.col("p_partkey") % 7).cast("int").alias("right_line"), pick(_CODE).alias("content"))


def _rules_sql(ids=None, scoped=True) -> str:
    use = [r for r in rules.RULES if ids is None or r[0] in ids]
    values = ", ".join(f"({_sql(i)}, {_sql(p)}, '{c}', '{v}', CAST({f} AS DOUBLE), '{o if scoped else 'all'}')" for i, p, c, v, f, o in use)
    return f"WITH {_CODE_SQL}, rl(rule_id, pattern, category, severity, confidence, scope) AS (VALUES {values}) SELECT rule_id, category, severity, confidence, path, right_line AS line, trim(content) AS excerpt FROM code, rl WHERE regexp_matches(content, pattern) AND (scope = 'all' OR (scope = 'source' AND NOT regexp_matches(path, '{_TEST}')) OR (scope = 'go' AND path LIKE '%.go' AND NOT regexp_matches(path, '{_TEST}')))"


@query("code_rules", _rules_sql())
def code_rules(s, d):
    """The rules themselves on lines of code, by their scopes."""
    return rules.rule_candidates(_code(s, d))


@query("code_rules_plain", _rules_sql(rules.PLAIN_IDS, False))
def code_rules_plain(s, d):
    return rules.rule_candidates(_code(s, d), tuple(r for r in rules.RULES if r[0] in rules.PLAIN_IDS), scoped=False)


_CLOSE = "close AS (SELECT p_partkey, p_partkey || '/m.go' AS path, p_partkey % 4 AS k FROM part)"


@query("unguarded_closes", f"WITH {_CLOSE} SELECT path, CAST(14 AS INT) AS line FROM close WHERE k IN (0, 3)")
def unguarded_closes(s, d):
    """A file a part: an assignment, then a close, with a check between (1), before (0), out of reach of an assignment (2), or none (3)."""
    k = F.col("p_partkey") % 4
    line = lambda n, text: F.struct(F.lit(n).alias("right_line"), text.alias("content"))
    lines = F.array(line(5, F.when(k == 2, "resp, err := get()").otherwise("x := 1")), line(9, F.when(k == 0, "if err != nil { return }").otherwise("y := 2")), line(10, F.when(k == 2, "z := 3").otherwise("resp, err := get()")), line(12, F.when(k == 1, "if err != nil { return }").otherwise("w := 4")), line(14, F.lit("defer resp.Body.Close()")))
    rows = table(s, d, "part").select(F.concat(_text("p_partkey"), F.lit("/m.go")).alias("path"), F.explode(lines).alias("l")).select("path", "l.right_line", "l.content", F.lit("added").alias("kind"))
    return rules.unguarded_close(rows, True)


@query("finding_fingerprints", _ORD_SQL + ", x AS (SELECT *, 'Shouts: ' || upper(severity) || '!' AS title FROM o) SELECT ordinal, sha256(path || ':' || line || ':' || category || ':' || regexp_replace(lower(title), '[^A-Za-z0-9_]+', '-', 'g')) AS titled, sha256(rule_id || chr(10) || path || chr(10) || line) AS plain, sha256(rule_id || '|' || path || '|' || line || '|' || excerpt) AS claim, sha256(category || chr(10) || path || chr(10) || line || chr(10) || title) AS model FROM x")
def finding_fingerprints(s, d):
    from patchloom.plans.catalog import _candidates, _with_ordinal

    rows = _with_ordinal(_candidates(s, d)).withColumn("title", F.concat(F.lit("Shouts: "), F.upper("severity"), F.lit("!")))
    c = F.col
    return rows.select("ordinal", findings.fingerprint(c("path"), c("line"), c("category"), policy.title_identity(F.lit(""), c("title"))).alias("titled"), findings.fingerprint_plain(c("rule_id"), c("path"), c("line")).alias("plain"), policy.fingerprint_claim(c("rule_id"), c("path"), c("line"), c("excerpt")).alias("claim"), policy.fingerprint_titled(c("category"), c("path"), c("line"), c("title")).alias("model"))


_MODEL = f"WITH {_CODE_SQL}, cd AS (SELECT p_partkey, path, CAST(right_line + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS line, CASE p_partkey % 5 WHEN 0 THEN 'style' ELSE 'security' END AS category, CASE p_partkey % 7 WHEN 0 THEN 'urgent' ELSE 'high' END AS severity, CASE p_partkey % 6 WHEN 0 THEN 1.5 ELSE 0.9 END::DOUBLE AS confidence, 'Title ' || p_partkey AS title, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || substr(content, 1, 6) ELSE 'nothing like it' END AS excerpt FROM code)"


@query("admitted_candidates", _MODEL + " SELECT cd.path, line, category, severity, confidence, title, content AS excerpt, sha256(category || chr(10) || cd.path || chr(10) || line || chr(10) || title) AS fingerprint FROM cd JOIN code ON code.path = cd.path AND right_line = line WHERE category <> 'style' AND severity <> 'urgent' AND confidence <= 1 AND (trim(cd.excerpt) = '' OR position(trim(cd.excerpt) IN trim(content)) > 0)")
def admitted_candidates(s, d):
    code, k = _code(s, d), F.col("p_partkey")
    said = code.select("path", (F.col("right_line") + F.when(k % 11 == 0, 1).otherwise(0)).cast("int").alias("line"), F.when(k % 5 == 0, "style").otherwise("security").alias("category"), F.when(k % 7 == 0, "urgent").otherwise("high").alias("severity"), F.when(k % 6 == 0, 1.5).otherwise(0.9).alias("confidence"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" "), F.substring("content", 1, 6))).otherwise("nothing like it").alias("excerpt"))
    return policy.admitted(said, code)


@query("merged_findings", "WITH x AS (SELECT 0 AS g, o_orderkey AS k, 'f' || (o_orderkey % 500) AS fingerprint FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey, 'f' || (o_orderkey % 700) FROM orders WHERE o_orderstatus = 'O') SELECT fingerprint, k FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY g, k) AS n FROM x) WHERE n = 1")
def merged_findings(s, d):
    group = lambda status, m: table(s, d, "orders").filter(F.col("o_orderstatus") == status).select(F.concat(F.lit("f"), (F.col("o_orderkey") % m).cast("string")).alias("fingerprint"), F.col("o_orderkey").alias("k"))
    return policy.merged([group("F", 500), group("O", 700)], "k")


#: Lines of an order may share a number; this tells them apart.
_LINE = "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)"
_FILES_SQL = f"f AS (SELECT l_orderkey, {_LINE} AS ln, (['src/auth/a.ts', 'lib/b.ts', 'tests/c.ts', 'docs/d.md', 'e.go'])[1 + l_partkey % 5] AS path, CAST(l_quantity * 5 AS BIGINT) AS additions, CAST(l_suppkey % 40 AS BIGINT) AS deletions, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS n FROM lineitem)"


def _change_files(s, d):
    names = F.array(*[F.lit(x) for x in ("src/auth/a.ts", "lib/b.ts", "tests/c.ts", "docs/d.md", "e.go")])
    return table(s, d, "lineitem").select("l_orderkey", F.expr(_LINE).alias("ln"), F.element_at(names, (1 + F.col("l_partkey") % 5).cast("int")).alias("path"), (F.col("l_quantity") * 5).cast("long").alias("additions"), (F.col("l_suppkey") % 40).alias("deletions"))


def _summary_sql(variant: str, limit: int) -> str:
    u = f"n <= {limit}"
    source = (policy.SCRIPT_FILES if variant == "script" else policy.SOURCE_FILES)
    untested = "tests = 0 AND additions + deletions > 50" if variant == "plain" else "tests = 0 AND sources > 0"
    checks = [("sensitive", "sensitive > 0"), ("untested", untested), ("large", "additions + deletions > 1000")] + ([] if variant == "plain" else [("truncated", f"total_files > {limit}")])
    return f"""WITH {_FILES_SQL}, g AS (SELECT l_orderkey, count(*) AS total_files, least(count(*), {limit}) AS reviewed_files, CAST(coalesce(sum(additions) FILTER ({u}), 0) AS BIGINT) AS additions, CAST(coalesce(sum(deletions) FILTER ({u}), 0) AS BIGINT) AS deletions, count(*) FILTER ({u} AND regexp_matches(path, '{T.HIGH_RISK_PATH}')) AS sensitive,
count(*) FILTER ({u} AND regexp_matches(path, '{T.TEST_PATH}')) AS tests, count(*) FILTER ({u} AND regexp_matches(path, '{source}')) AS sources FROM f GROUP BY 1), h AS (SELECT *, {_fail(*checks)} AS reasons FROM g)
SELECT l_orderkey, total_files, reviewed_files, additions, deletions, sensitive, reasons, CASE WHEN sensitive > 0 OR additions + deletions > 1000 THEN 'high' WHEN reasons <> '' THEN 'medium' ELSE 'low' END AS risk FROM h"""


@query("change_summaries", _summary_sql("plain", 100))
def change_summaries(s, d):
    return policy.change_summary(_change_files(s, d), "l_orderkey", "ln")


@query("change_summaries_script", _summary_sql("script", 3))
def change_summaries_script(s, d):
    return policy.change_summary(_change_files(s, d), "l_orderkey", "ln", 3, "script")


@query("change_summaries_source", _summary_sql("source", 3))
def change_summaries_source(s, d):
    return policy.change_summary(_change_files(s, d), "l_orderkey", "ln", 3, "source")


@query("overall_risk", "SELECT o_orderkey, CASE WHEN 'high' IN (a, b) THEN 'high' WHEN 'medium' IN (a, b) THEN 'medium' ELSE 'low' END AS risk, CASE WHEN 'high' IN (a, b) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failure' ELSE 'neutral' END ELSE 'success' END AS conclusion FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' END AS a, CASE WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS b FROM orders)")
def overall_risk(s, d):
    a, b = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low"), F.when(F.col("o_totalprice") > 150000, "medium").otherwise("low")
    rows = table(s, d, "orders").select("o_orderkey", policy.highest(a, b, F.lit(None).cast("string")).alias("risk"))
    return rows.withColumn("conclusion", policy.conclusion(F.col("risk"), F.col("o_orderkey") % 2 == 0))


_FOUND_SQL = f"fd AS (SELECT l_orderkey, {_LINE} AS ln, 'src/' || l_partkey AS path, CAST(l_quantity AS INT) AS line, (['critical', 'high', 'medium', 'low'])[1 + l_suppkey % 4] AS severity, 'rule/' || (l_partkey % 9) AS rule_id, l_discount > 0.03 AS publishable, sha256('f' || l_orderkey || '/' || {_LINE}) AS fingerprint FROM lineitem)"


def _findings(s, d):
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), (1 + F.col("l_suppkey") % 4).cast("int"))
    return table(s, d, "lineitem").select("l_orderkey", F.expr(_LINE).alias("ln"), F.concat(F.lit("src/"), _text("l_partkey")).alias("path"), F.col("l_quantity").cast("int").alias("line"), severity.alias("severity"), F.concat(F.lit("rule/"), (F.col("l_partkey") % 9).cast("string")).alias("rule_id"), (F.col("l_discount") > 0.03).alias("publishable"), F.sha2(F.concat(F.lit("f"), _text("l_orderkey"), F.lit("/"), F.expr(_LINE).cast("string")), 256).alias("fingerprint"))


@query("check_annotations", f"WITH {_FOUND_SQL} SELECT l_orderkey, path, line AS start_line, line AS end_line, CASE WHEN severity IN ('critical', 'high') THEN 'failure' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END AS level, substr(upper(severity) || ': ' || repeat('t', 300), 1, 255) AS title, rule_id || chr(10) || chr(10) || 'Suggestion: none' AS message FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln) AS n FROM fd WHERE publishable) WHERE n <= 3")
def check_annotations(s, d):
    rows = _findings(s, d).withColumn("title", F.repeat(F.lit("t"), 300)).withColumn("claim", F.col("rule_id")).withColumn("suggestion", F.lit("none"))
    return policy.annotations(rows, "l_orderkey", "ln", 3)


@query("markdown_reports", _summary_sql("plain", 100).replace("WITH ", f"WITH {_FOUND_SQL}, ", 1).replace("SELECT l_orderkey, total_files, reviewed_files, additions, deletions, sensitive, reasons, CASE", "SELECT l_orderkey, '## Review' || chr(10) || chr(10) || '**Risk: ' || upper(risk) || '**' || chr(10) || chr(10) || reviewed_files || ' of ' || total_files || ' files, +' || additions || '/-' || deletions || chr(10) || chr(10) || '### Files' || chr(10) || chr(10) || (SELECT string_agg('- `' || path || '` (modified)', chr(10) ORDER BY ln) FROM f WHERE f.l_orderkey = r.l_orderkey) || chr(10) || chr(10) || '### Risk signals' || chr(10) || chr(10) || CASE WHEN reasons = '' THEN 'none' ELSE '- ' || replace(reasons, ',', chr(10) || '- ') END || chr(10) || chr(10) || '### Findings' || chr(10) || chr(10) || coalesce((SELECT string_agg('- **' || upper(severity) || '** `' || path || ':' || line || '` ' || rule_id || ' (`' || substr(fingerprint, 1, 12) || '`)', chr(10) ORDER BY ln) FROM fd WHERE publishable AND fd.l_orderkey = r.l_orderkey), 'none') || chr(10) AS markdown FROM (SELECT *, CASE", 1) + ") r")
def markdown_reports(s, d):
    files = _change_files(s, d).withColumn("status", F.lit("modified"))
    return policy.report(policy.change_summary(files, "l_orderkey", "ln"), files, _findings(s, d), "l_orderkey", "ln")


# --- graph -----------------------------------------------------------------------------------------------------------

@query("symbol_changes_no_files", _SYM + ", b AS (SELECT *, CASE WHEN CAST(substr(stable_key, 6) AS BIGINT) % 13 = 0 THEN 'file' ELSE kind END AS kd FROM base), h AS (SELECT *, CASE WHEN CAST(substr(stable_key, 6) AS BIGINT) % 13 = 0 THEN 'file' ELSE kind END AS kd FROM head), c AS (SELECT coalesce(h.stable_key, b.stable_key) AS stable_key, CASE WHEN b.stable_key IS NULL THEN 'ADDED' WHEN h.stable_key IS NULL THEN 'DELETED' WHEN b.content_hash <> h.content_hash OR b.signature <> h.signature THEN 'MODIFIED' END AS change FROM (SELECT * FROM b WHERE kd <> 'file') b FULL JOIN (SELECT * FROM h WHERE kd <> 'file') h USING (stable_key)) SELECT * FROM c WHERE change IS NOT NULL")
def symbol_changes_no_files(s, d):
    marked = lambda head: A.symbols(s, d, head).withColumn("kind", F.when(F.substring("stable_key", 6, 20).cast("long") % 13 == 0, "file").otherwise(F.col("kind")))
    return graph.compare_symbols(marked(False), marked(True), files="none").select("stable_key", "change")


@query("symbol_changes_file_edges", _SYM + ", b AS (SELECT *, CAST(substr(stable_key, 6) AS BIGINT) % 13 = 0 AS fl FROM base), h AS (SELECT *, CAST(substr(stable_key, 6) AS BIGINT) % 13 = 0 AS fl FROM head), c AS (SELECT coalesce(h.stable_key, b.stable_key) AS stable_key, coalesce(h.fl, b.fl) AS fl, CASE WHEN b.stable_key IS NULL THEN 'ADDED' WHEN h.stable_key IS NULL THEN 'DELETED' WHEN b.content_hash <> h.content_hash OR b.signature <> h.signature THEN 'MODIFIED' END AS change FROM b FULL JOIN h USING (stable_key)) SELECT stable_key, change FROM c WHERE change IS NOT NULL AND (NOT fl OR change <> 'MODIFIED')")
def symbol_changes_file_edges(s, d):
    marked = lambda head: A.symbols(s, d, head).withColumn("kind", F.when(F.substring("stable_key", 6, 20).cast("long") % 13 == 0, "file").otherwise(F.col("kind")))
    return graph.compare_symbols(marked(False), marked(True), files="edges").select("stable_key", "change")


_MODULES = """WITH sy AS (SELECT 'file:' || p_partkey AS stable_key, 'file' AS kind, 'src/m' || (p_partkey % 40) || '/f' || p_partkey || (['.ts', '.tsx', '/index.ts'])[1 + p_partkey % 3] AS path, '$module' AS name, true AS exported, false AS is_default FROM part
UNION ALL SELECT 'sym:' || p_partkey, 'function', 'src/m' || (p_partkey % 40) || '/f' || p_partkey || (['.ts', '.tsx', '/index.ts'])[1 + p_partkey % 3], 'fn' || (p_partkey % 3), p_partkey % 4 <> 0, p_partkey % 2 = 0 FROM part),
ed AS (SELECT DISTINCT l_orderkey || '/' || (__LINE__) AS id, 'order:' || l_orderkey AS from_key, 0.5::DOUBLE AS confidence, 'src/m' || (l_partkey % 40) || '/user.ts' AS source_path, l_partkey AS p, (['*', 'default', 'fn0', 'fn1', 'fn2'])[1 + l_suppkey % 5] AS x, l_linenumber % 4 AS how FROM lineitem),
k AS (SELECT *, 'external:' || CASE how WHEN 0 THEN './f' || p WHEN 1 THEN '../m' || (p % 40) || '/./f' || p WHEN 2 THEN 'lodash' ELSE './f' || p || '.ts' END || '#' || x AS to_key, 'src/m' || (p % 40) || '/f' || p || CASE how WHEN 3 THEN '.ts' ELSE '' END AS base FROM ed),
t AS (SELECT id, n, base || CASE WHEN how = 3 THEN '' ELSE (['.ts', '.tsx', '/index.ts'])[n] END AS path FROM k, range(1, 4) AS r(n) WHERE how <> 2 AND (how <> 3 OR n = 1)),
f AS (SELECT id, arg_min(t.path, n) AS path, arg_min(stable_key, n) AS file_key FROM t JOIN sy ON sy.path = t.path AND kind = 'file' GROUP BY id),
o AS (SELECT path, name, min(stable_key) AS found FROM (SELECT path, name, stable_key FROM sy WHERE exported AND kind <> 'file' UNION ALL SELECT path, 'default', stable_key FROM sy WHERE exported AND is_default) GROUP BY 1, 2 HAVING count(*) = 1)
SELECT id, coalesce(CASE WHEN x = '*' THEN file_key ELSE found END, to_key) AS to_key, CASE WHEN CASE WHEN x = '*' THEN file_key ELSE found END IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM k LEFT JOIN f USING (id) LEFT JOIN o ON o.path = f.path AND o.name = x""".replace("__LINE__", _LINE)


@query("module_links", _MODULES)
def module_links(s, d):
    part, line = table(s, d, "part"), table(s, d, "lineitem")
    k, p = F.col("p_partkey"), F.col("l_partkey")
    pick = lambda c, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + c % len(xs)).cast("int"))
    path = F.concat(F.lit("src/m"), (k % 40).cast("string"), F.lit("/f"), k.cast("string"), pick(k, (".ts", ".tsx", "/index.ts")))
    files = part.select(F.concat(F.lit("file:"), k.cast("string")).alias("stable_key"), F.lit("file").alias("kind"), path.alias("path"), F.lit("$module").alias("name"), F.lit(True).alias("exported"), F.lit(False).alias("is_default"))
    own = part.select(F.concat(F.lit("sym:"), k.cast("string")).alias("stable_key"), F.lit("function").alias("kind"), path.alias("path"), F.concat(F.lit("fn"), (k % 3).cast("string")).alias("name"), (k % 4 != 0).alias("exported"), (k % 2 == 0).alias("is_default"))
    how, text, folder = F.col("l_linenumber") % 4, p.cast("string"), (p % 40).cast("string")
    spec = F.when(how == 0, F.concat(F.lit("./f"), text)).when(how == 1, F.concat(F.lit("../m"), folder, F.lit("/./f"), text)).when(how == 2, F.lit("lodash")).otherwise(F.concat(F.lit("./f"), text, F.lit(".ts")))
    edges = line.select(F.concat(_text("l_orderkey"), F.lit("/"), F.expr(_LINE).cast("string")).alias("id"), F.concat(F.lit("external:"), spec, F.lit("#"), pick(F.col("l_suppkey"), ("*", "default", "fn0", "fn1", "fn2"))).alias("to_key"), F.lit(0.5).alias("confidence"), F.concat(F.lit("src/m"), folder, F.lit("/user.ts")).alias("source_path")).distinct()
    return graph.link_modules(edges, files.unionByName(own)).select("id", "to_key", "confidence")


@query("blast_radius_plain", _EDG + """, w AS (SELECT *, confidence AS gain FROM edges),
d1 AS (SELECT change_key, node, ord AS o1, gain AS score FROM (SELECT stable_key AS change_key, from_key AS node, ord, gain, row_number() OVER (PARTITION BY stable_key, from_key ORDER BY ord) AS n FROM changes JOIN w ON to_key = stable_key WHERE from_key <> stable_key) WHERE n = 1),
d2 AS (SELECT change_key, node FROM (SELECT change_key, from_key AS node, row_number() OVER (PARTITION BY change_key, from_key ORDER BY o1, ord) AS n FROM d1 JOIN w ON to_key = node WHERE from_key <> change_key) t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.change_key = t.change_key AND d1.node = t.node)),
p AS (SELECT node, 6 AS steps FROM d1 UNION ALL SELECT node, 3 FROM d2), r AS (SELECT (SELECT count(*) FROM changes) AS changes, (SELECT count(*) FROM p) AS paths, CAST(least(100, 5 * (SELECT count(*) FROM changes) + 8 * (SELECT count(DISTINCT node) FROM p) + (SELECT coalesce(sum(steps), 0) FROM p)) AS INT) AS score) SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM r""")
def blast_radius_plain(s, d):
    return graph.blast_radius(A.changes(s, d), graph.impact_paths(A.changes(s, d), A.edges(s, d), None, rounded=False), "plain")


@query("blast_radius_semantic", _EDG + ", r AS (SELECT (SELECT count(*) FROM changes) AS changes, (SELECT count(*) FROM (SELECT DISTINCT to_key, from_key FROM edges JOIN changes ON stable_key = to_key WHERE type_resolved)) AS paths), q AS (SELECT *, CAST(least(100, 2 * changes + 8 * paths) AS INT) AS score FROM r) SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM q")
def blast_radius_semantic(s, d):
    near = A.edges(s, d).filter("type_resolved").join(A.changes(s, d).select(F.col("stable_key").alias("to_key")), "to_key", "left_semi").select(F.col("from_key").alias("impacted_key"), "to_key").distinct()
    return graph.blast_radius(A.changes(s, d), near.withColumn("score", F.lit(1.0)).withColumn("depth", F.lit(1)), "semantic")


@query("shared_caller_evidence", _EDG + ", cl AS (SELECT from_key, to_key, ord FROM edges WHERE type = 'CALLS' AND type_resolved), an AS (SELECT from_key, ord FROM cl WHERE to_key IN (SELECT stable_key FROM changes)), ow AS (SELECT from_key, to_key AS candidate_key, ord FROM cl WHERE to_key NOT IN (SELECT stable_key FROM changes) AND from_key IN (SELECT from_key FROM an)) SELECT DISTINCT candidate_key, ord FROM ow UNION SELECT candidate_key, an.ord FROM ow JOIN an USING (from_key)")
def shared_caller_evidence(s, d):
    return graph.shared_caller_evidence(A.edges(s, d), A.changes(s, d))


@query("incoming_edges", _EDG + " SELECT from_key, type FROM edges WHERE to_key = 'order:7' AND type IN ('CALLS', 'IMPORTS')")
def incoming_edges(s, d):
    return graph.incoming(A.edges(s, d), "order:7", ("CALLS", "IMPORTS")).select("from_key", "type")


@query("symbols_at_path", _GS + " SELECT stable_key FROM gs WHERE in_head AND path = 'order/3'")
def symbols_at_path(s, d):
    return graph.symbols_at(A.graph_symbols(s, d, True), "order/3").select("stable_key")


@query("unchanged_callers", _GS + ", gr AS (SELECT 'g' || (CAST(substr(path, 7) AS BIGINT) % 5) AS g, path FROM (SELECT DISTINCT path FROM gs WHERE path LIKE 'order/%')), tst AS (SELECT DISTINCT path FROM gs WHERE test_source AND path LIKE 'order/1%'), core AS (SELECT g, stable_key AS id FROM gr JOIN gs USING (path)), near AS (SELECT g, from_key AS id, true AS into_core FROM edges JOIN core ON to_key = id UNION SELECT g, to_key, false FROM edges JOIN core ON from_key = id), n2 AS (SELECT near.*, qualified_name AS name, gs.path FROM near JOIN gs ON gs.stable_key = near.id WHERE in_head AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.g = near.g AND gr.path = gs.path)) SELECT g AS \"group\", 'caller' AS kind, name FROM n2 WHERE into_core AND path NOT IN (SELECT path FROM tst) UNION SELECT g, 'test', path FROM gr WHERE path IN (SELECT path FROM tst) UNION SELECT g, 'test', path FROM n2 WHERE path IN (SELECT path FROM tst)")
def unchanged_callers(s, d):
    return graph.unchanged_callers(*_card_inputs(s, d))


def _card_inputs(s, d):
    sy = A.graph_symbols(s, d, True).select(F.col("stable_key").alias("id"), F.col("qualified_name").alias("name"), "path", "test_source")
    ties = A.edges(s, d).select(F.col("from_key").alias("from_id"), F.col("to_key").alias("to_id"), F.lit("calls").alias("type"))
    groups = sy.filter("path LIKE 'order/%'").select(F.concat(F.lit("g"), (F.substring("path", 7, 9).cast("long") % 5).cast("string")).alias("group"), "path").distinct()
    files = sy.select("path", F.when(F.col("test_source") & F.col("path").startswith("order/1"), "test").otherwise("source").alias("role")).distinct()
    return sy.drop("test_source"), ties, groups, files


@query("affected_paths", _GS + ", k AS (SELECT stable_key FROM gs WHERE in_head AND path IN ('part/3', 'part/4')) SELECT 'part/3' AS path UNION SELECT 'part/4' UNION SELECT path FROM gs WHERE in_head AND stable_key IN (SELECT from_key FROM edges WHERE to_key IN (SELECT stable_key FROM k))")
def affected_paths(s, d):
    changed = s.createDataFrame([("part/3",), ("part/4",)], "path string")
    return graph.affected_paths(A.graph_symbols(s, d, True), A.edges(s, d), changed)


# --- jobs and journals -----------------------------------------------------------------------------------------------

_JOBS_SQL = "j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'retry' ELSE 'processing' END AS status, CAST(o_orderkey % 4 AS INT) AS attempts, o_orderdate AS available_at, o_orderdate + INTERVAL 1 DAY AS created_at, o_orderkey % 5 AS lease_generation, o_orderdate + INTERVAL 400 DAY AS lease_expires_at FROM orders)"


def _jobs(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), k.alias("review_run_id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "retry").otherwise("processing").alias("status"), (k % 4).cast("int").alias("attempts"), F.col("o_orderdate").alias("available_at"), F.expr("o_orderdate + INTERVAL 1 DAY").alias("created_at"), (k % 5).alias("lease_generation"), F.expr("o_orderdate + INTERVAL 400 DAY").alias("lease_expires_at"))


@query("claimed_jobs", f"WITH {_JOBS_SQL} SELECT id, 'processing' AS status, attempts, lease_generation + 1 AS lease_generation FROM (SELECT * FROM j WHERE status IN ('queued', 'retry') AND available_at <= TIMESTAMP '{NOW}' AND attempts < 3 ORDER BY created_at, id LIMIT 20)")
def claimed_jobs(s, d):
    return jobs.claim(_jobs(s, d), _ts(NOW), 20).select("id", "status", "attempts", "lease_generation")


@query("fenced_writes", f"WITH {_JOBS_SQL} SELECT l_orderkey, l_linenumber, coalesce(status = 'processing' AND lease_generation = l_suppkey % 5 AND lease_expires_at > l_shipdate, false) AS valid FROM lineitem LEFT JOIN j ON id = l_orderkey")
def fenced_writes(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 5).alias("generation"), F.col("l_shipdate").alias("ts"))
    return jobs.fenced(line, _jobs(s, d)).select("l_orderkey", "l_linenumber", "valid")


@query("expired_batch", f"WITH {_JOBS_SQL} SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'retry' END AS status FROM (SELECT * FROM j WHERE status = 'processing' AND lease_expires_at <= TIMESTAMP '{NOW}' ORDER BY lease_expires_at, id LIMIT 100)")
def expired_batch(s, d):
    return state.expire_leases(_jobs(s, d), _ts(NOW), batch=100).select("id", "attempts", "status")


def lease_sql(events: str, lease: int, timed: bool) -> str:
    """The recursion over ``events`` (id, n from 1 on in order, seq, kind, generation, ms) that gives r: each event's result, and whether a lease ran out before it."""
    over = "r.status = 'processing' AND r.until <= e.ms"
    lapsed = over if timed else "false"
    mine = "e.kind IN ('renew', 'complete') AND x.status = 'processing' AND e.generation = x.generation AND x.until > e.ms"
    return f"""e AS ({events}),
r AS (SELECT DISTINCT id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, 0::BIGINT AS ms, false AS ok, 'queued' AS status, 0 AS attempts, 0::BIGINT AS generation, 0::BIGINT AS until, false AS lapsed, 0::BIGINT AS ended FROM e
UNION ALL SELECT id, n, seq, kind, ms, claims OR expires OR mine, CASE WHEN claims THEN 'processing' WHEN expires THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'retry' END WHEN mine AND kind = 'complete' THEN 'completed' ELSE status END,
  attempts + CASE WHEN expires THEN 1 ELSE 0 END, generation + CASE WHEN claims THEN 1 ELSE 0 END, CASE WHEN claims OR (mine AND kind = 'renew') THEN ms + {lease} ELSE until END, lapsed, until
FROM (SELECT e.id, e.n, e.seq, e.kind, e.ms, x.status, x.attempts, x.generation, x.until, x.lapsed, e.kind = 'claim' AND x.status IN ('queued', 'retry') AND x.attempts < 3 AS claims, e.kind = 'expire' AND x.status = 'processing' AND x.until <= e.ms AS expires, {mine} AS mine
  FROM (SELECT r.id, r.n, r.generation, r.until, {lapsed} AS lapsed, CASE WHEN {lapsed} THEN CASE WHEN r.attempts + 1 >= 3 THEN 'failed' ELSE 'retry' END ELSE r.status END AS status, r.attempts + CASE WHEN {lapsed} THEN 1 ELSE 0 END AS attempts FROM r JOIN e ON e.id = r.id AND e.n = r.n + 1) x JOIN e ON e.id = x.id AND e.n = x.n + 1))"""


_LEASES = lease_sql("SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id AS seq, (['claim', 'renew', 'expire', 'complete'])[1 + event_id % 4] AS kind, 1 + event_id % 3 AS generation, CAST(floor(epoch(ts)) AS BIGINT) AS ms FROM events", jobs.LEASE_SECONDS, False)


@query("lease_replay", f"WITH RECURSIVE {_LEASES} SELECT id, seq, kind, ok, status, attempts, generation FROM r WHERE n > 0")
def lease_replay(s, d):
    """The life of each user's job, as their events tell it."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("claim", "renew", "expire", "complete")]), (1 + F.col("event_id") % 4).cast("int"))
    rows = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), (1 + F.col("event_id") % 3).alias("generation"), F.unix_timestamp("ts").alias("ts"))
    return jobs.replay_leases(rows)


@query("run_times", "SELECT l_partkey AS id, arg_max(status, {a: l_shipdate, b: l_orderkey, c: l_linenumber}) AS status, CAST(min(CASE WHEN status = 'in_progress' THEN l_shipdate END) AS VARCHAR) AS started_at, CAST(arg_max(l_shipdate, {a: l_shipdate, b: l_orderkey, c: l_linenumber}) FILTER (status IN ('completed', 'failed')) AS VARCHAR) AS completed_at FROM (SELECT *, (['in_progress', 'completed', 'failed', 'queued'])[1 + l_orderkey % 4] AS status FROM lineitem) GROUP BY 1")
def run_times(s, d):
    status = F.element_at(F.array(*[F.lit(x) for x in ("in_progress", "completed", "failed", "queued")]), (1 + F.col("l_orderkey") % 4).cast("int"))
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("id"), status.alias("status"), F.col("l_shipdate").alias("ts"), "l_shipdate", "l_orderkey", "l_linenumber")
    return jobs.run_times(rows, ["l_shipdate", "l_orderkey", "l_linenumber"]).select("id", "status", _text("started_at").alias("started_at"), _text("completed_at").alias("completed_at"))


_JOURNAL = """WITH RECURSIVE e AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, kind, hash, remote_id NULLS FIRST) AS n, l_linenumber AS seq, kind, hash, remote_id
  FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'sent' ELSE 'confirmed' END AS kind, 'h' || (l_suppkey % 2) AS hash, CASE WHEN l_linenumber > 1 THEN l_partkey % 2 + 1 END AS remote_id FROM lineitem)),
r AS (SELECT DISTINCT run_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::VARCHAR AS kind, false AS ok, 'none' AS state, NULL::VARCHAR AS known, NULL::BIGINT AS remote_id FROM e
UNION ALL SELECT run_id, n, seq, kind, sent OR confirmed, CASE WHEN sent THEN 'sent' WHEN confirmed THEN 'confirmed' ELSE state END, CASE WHEN sent THEN hash ELSE known END, CASE WHEN sent OR confirmed THEN coalesce(told, remote) ELSE remote END
FROM (SELECT e.run_id, e.n, e.seq, e.kind, e.hash, e.remote_id AS told, r.state, r.known, r.remote_id AS remote, e.kind = 'sent' AND r.known IS NULL AS sent, e.kind = 'confirmed' AND coalesce(r.known = e.hash, false) AND e.remote_id IS NOT NULL AND coalesce(r.remote_id = e.remote_id, true) AS confirmed FROM r JOIN e ON e.run_id = r.run_id AND e.n = r.n + 1))
SELECT run_id, 'check_result' AS operation, seq, kind, ok, state, remote_id FROM r WHERE n > 0"""


@query("journal_replay", _JOURNAL)
def journal_replay(s, d):
    """Publications as lines of an order tell them."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit("check_result").alias("operation"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_linenumber") == 1, "sent").otherwise("confirmed").alias("kind"), F.concat(F.lit("h"), (F.col("l_suppkey") % 2).cast("string")).alias("hash"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 2 + 1).alias("remote_id"))
    return jobs.replay_journal(rows)


_PULLS = "r AS (SELECT o_orderkey AS id, o_custkey % 50 AS repository_id, o_custkey AS pull_number, o_orderdate AS created_at FROM orders)"


def _pulls(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("repository_id"), F.col("o_custkey").alias("pull_number"), F.col("o_orderdate").alias("created_at"))


@query("slot_claims", f"WITH {_PULLS}, sl AS (SELECT repository_id, pull_number, max(id) AS active_run_id FROM r WHERE pull_number % 3 = 0 GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY repository_id, pull_number ORDER BY created_at DESC, id DESC) AS n FROM r) SELECT l.id AS run_id, n = 1 AND (active_run_id IS NULL OR active_run_id = l.id) AS acquired FROM l LEFT JOIN sl USING (repository_id, pull_number)")
def slot_claims(s, d):
    runs = _pulls(s, d)
    slots = runs.filter("pull_number % 3 = 0").groupBy("repository_id", "pull_number").agg(F.max("id").alias("active_run_id"))
    return jobs.slot_claims(runs.select(F.col("id").alias("run_id")), runs, slots)


_HOOK = """h AS (SELECT event_id, (['pull_request', 'check_run', 'issue_comment', 'push'])[1 + event_id % 4] AS event, (['opened', 'created', 'rerequested', 'closed', 'synchronize'])[1 + event_id % 5] AS action, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 5 END AS installation_id, CASE WHEN event_id % 3 = 0 THEN 'Review' ELSE 'Other' END AS check_name, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS check_head,
  CASE event_id % 6 WHEN 0 THEN ' /Bot feedback ABCDEF012345 False-Positive ' WHEN 1 THEN '/bot feedback abc helpful' ELSE '/bot  feedback 0123456789abcdef helpful' END AS body FROM events), q AS (SELECT *, regexp_extract(trim(body), '(?i)^/bot\\s+feedback\\s+([a-f0-9]{12,64})\\s+(helpful|false-positive)$', ['f', 'v']) AS m FROM h),
z AS (SELECT *, CASE event WHEN 'pull_request' THEN CASE WHEN action NOT IN ('opened', 'synchronize') THEN 'ignored_action' WHEN installation_id < 1 THEN 'ignored' ELSE 'queued' END WHEN 'check_run' THEN CASE WHEN NOT (action = 'rerequested' AND check_name = 'Review') THEN 'ignored' WHEN check_head <> 'a' THEN 'ignored_stale_check' ELSE 'rerun_queued' END WHEN 'issue_comment' THEN CASE WHEN action = 'created' AND m.f <> '' THEN 'feedback' ELSE 'ignored_comment' END ELSE 'ignored' END AS route FROM q)"""


@query("routed_events", f"WITH {_HOOK} SELECT event_id, route, CASE WHEN route = 'feedback' THEN lower(m.f) END AS fingerprint, CASE WHEN route = 'feedback' THEN replace(lower(m.v), '-', '_') END AS verdict FROM z")
def routed_events(s, d):
    k = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + k % len(xs)).cast("int"))
    one = lambda x: F.lit(x)
    body = F.when(k % 6 == 0, " /Bot feedback ABCDEF012345 False-Positive ").when(k % 6 == 1, "/bot feedback abc helpful").otherwise("/bot  feedback 0123456789abcdef helpful")
    rows = table(s, d, "events").select("event_id", pick(("pull_request", "check_run", "issue_comment", "push")).alias("event"), pick(("opened", "created", "rerequested", "closed", "synchronize")).alias("action"), F.when(k % 7 == 0, 0).otherwise(5).alias("installation_id"), one(3).alias("repository_id"), one(9).alias("pull_number"), one("o").alias("owner"), one("r").alias("repo"), one("x").alias("base_sha"), one("a").alias("head_sha"), F.when(k % 3 == 0, "Review").otherwise("Other").alias("check_name"), one(None).cast("long").alias("check_app_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("check_head_sha"), one(True).alias("has_pull"), body.alias("body"))
    return jobs.routed(rows, "Review", "/bot").select("event_id", "route", "fingerprint", "verdict")


@query("created_runs", "SELECT l_orderkey, l_linenumber, row_number() OVER w = 1 AS created, first_value(l_orderkey) OVER w AS run_order FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber)")
def created_runs(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("repository_id"), F.col("l_suppkey").alias("pull_number"), F.col("l_returnflag").alias("base_sha"), F.col("l_linestatus").alias("head_sha"), F.lit("c").alias("config_hash"), F.lit(1).alias("pipeline_version"), F.lit("automatic").alias("request_key"))
    return jobs.created_runs(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "created", "run_order")


_PLANS = "pl AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_orderkey AS run_id, CAST(l_quantity * 10 AS BIGINT) AS request_bytes, CASE WHEN l_partkey % 50 = 0 THEN 3 ELSE 4 END AS max_calls FROM lineitem WHERE l_suppkey % 9 <> 0), ca AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id, CASE WHEN l_partkey % 40 = 0 THEN 'reserved' ELSE 'done' END AS status FROM lineitem WHERE l_suppkey % 7 <> 0)"


@query("reserved_admission", f"WITH {_PLANS}, sp AS (SELECT pl.run_id, count(*) AS calls, sum(request_bytes) AS bytes, count(*) FILTER (ca.id IS NULL OR status = 'reserved') AS pending, count(*) FILTER (max_calls <> 4) AS changed FROM pl LEFT JOIN ca ON ca.id = call_id GROUP BY 1), un AS (SELECT run_id, count(*) AS unplanned FROM ca WHERE id NOT IN (SELECT call_id FROM pl) GROUP BY 1) SELECT o_orderkey AS run_id, {_fail(('unplanned', 'coalesce(unplanned, 0) <> 0'), ('changed', 'coalesce(changed, 0) <> 0'), ('pending', 'coalesce(pending, 0) <> 0'), ('calls', 'coalesce(calls, 0) >= 4'), ('bytes', 'coalesce(bytes, 0) + 200 > 1000'))} AS refused FROM orders LEFT JOIN sp ON sp.run_id = o_orderkey LEFT JOIN un ON un.run_id = o_orderkey")
def reserved_admission(s, d):
    line = table(s, d, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    plans = line.filter("l_suppkey % 9 <> 0").select(key.alias("call_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_quantity") * 10).cast("long").alias("request_bytes"), F.when(F.col("l_partkey") % 50 == 0, 3).otherwise(4).alias("max_calls"), F.lit(1000).alias("max_input_bytes"))
    calls = line.filter("l_suppkey % 7 <> 0").select(key.alias("id"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_partkey") % 40 == 0, "reserved").otherwise("done").alias("status"))
    wanted = table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(200).alias("input_bytes"))
    return jobs.admit_reserved(wanted, plans, calls, 4, 1000).select("run_id", "refused")


_BIND = "k AS (SELECT o_orderkey AS id, o_custkey % 50 AS repository_id, o_custkey AS pull_number FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0)"


@query("recovery_bindings", f"WITH {_BIND} SELECT id AS review_run_id, 'p' || id AS payload_hash, 'check_start' || id AS start_hash, 'check_result' || id AS result_hash, 'summary_comment' || id AS summary_hash FROM k WHERE id % 5 <> 0 AND id % 4 <> 1 AND id % 11 <> 0 AND id % 13 <> 0")
def recovery_bindings(s, d):
    k = F.col("o_orderkey")
    runs = table(s, d, "orders").select(k.alias("id"), (F.col("o_custkey") % 50).alias("repository_id"), F.col("o_custkey").alias("pull_number"), F.lit("x").alias("head_sha"), F.when((F.col("o_orderstatus") == "F") & (k % 3 != 0), "failed").otherwise("completed").alias("status"), F.lit("PUBLICATION_UNCERTAIN").alias("error_code"))
    of = lambda *c: table(s, d, "orders").select(k.alias("review_run_id"), *c)
    job = of(F.lit("failed").alias("status"), F.lit(1).alias("installation_id"), F.when(k % 5 == 0, _ts(NOW)).alias("locked_at"), F.lit(None).cast("timestamp").alias("lease_expires_at"))
    outputs = of(F.lit(1).alias("schema_version"), F.when(k % 4 == 1, 2).otherwise(1).alias("installation_id"), F.concat(F.lit("p"), k.cast("string")).alias("payload_hash"))
    effect = lambda name, state, remote: of(F.lit(name).alias("operation"), F.concat(F.lit(name), k.cast("string")).alias("request_hash"), state.alias("state"), remote.cast("long").alias("remote_id"))
    effects = effect("check_start", F.when(k % 11 == 0, "sent").otherwise("confirmed"), k).unionByName(effect("check_result", F.lit("sent"), F.when(k % 13 == 0, k + 1))).unionByName(effect("summary_comment", F.lit("sent"), F.lit(None)))
    slots = runs.select(F.col("id").alias("active_run_id"), "repository_id", "pull_number", F.lit(1).alias("installation_id"))
    return jobs.recovery_bindings(runs, job, outputs, effects, slots, of(F.lit("x").alias("head_sha")).filter(F.col("review_run_id") % 2 == 0))


@query("preview_contexts", f"WITH {_PULLS}, n AS (SELECT r.*, row_number() OVER (PARTITION BY repository_id, pull_number ORDER BY created_at DESC, id DESC) AS n, o_orderstatus AS st FROM r JOIN orders ON o_orderkey = id) SELECT id AS run_id, 'b' || id AS base_sha, 'h' || id AS head_sha, 's' || id AS snapshot_id FROM n WHERE n = 1 AND st = 'F' AND repository_id % 4 <> 0 AND (repository_id // 10) <> 2 AND id % 6 <> 0")
def preview_contexts(s, d):
    runs = _pulls(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id").select("id", "repository_id", "pull_number", "created_at", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.concat(F.lit("b"), _text("id")).alias("base_sha"), F.concat(F.lit("h"), _text("id")).alias("head_sha"))
    repositories = s.range(50).select("id", F.floor(F.col("id") / 10).alias("installation_id"), (F.col("id") % 4 != 0).alias("selected"))
    installations = s.range(5).select("id", (F.col("id") != 2).alias("active"))
    analyses = runs.select(F.col("id").alias("review_run_id"), F.concat(F.lit("t"), _text("id")).alias("base_snapshot_id"), F.concat(F.lit("s"), _text("id")).alias("head_snapshot_id"))
    ready = F.when(F.col("id") % 6 == 0, "failed").otherwise("ready").alias("status")
    snapshots = runs.select(F.concat(F.lit("s"), _text("id")).alias("id"), "repository_id", ready).unionByName(runs.select(F.concat(F.lit("t"), _text("id")).alias("id"), "repository_id", F.lit("ready").alias("status")))
    return jobs.preview_contexts(runs, repositories, installations, analyses, snapshots)


@query("recovery_outcomes", "SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 5 = 0 THEN 'NOT_FOUND' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'O' THEN 'DENIED' WHEN o_orderkey % 2 = 0 THEN 'COMMITTED_MATCH' ELSE 'COMMITTED_CHANGED' END AS outcome FROM orders")
def recovery_outcomes(s, d):
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(k.alias("attempt_id"), k.alias("run_id"), F.when(k % 5 == 0, "other").otherwise("me").alias("actor_hash"), F.lit("e").alias("evidence_hash"), "o_orderstatus")
    audit = rows.withColumn("stage", F.lit("requested")).unionByName(rows.filter("o_orderstatus <> 'P'").withColumn("stage", F.when(F.col("o_orderstatus") == "O", "denied").otherwise("committed")))
    return jobs.recovery_outcomes(rows.select("attempt_id", F.lit("me").alias("actor_hash")), audit, rows.filter("run_id % 2 = 0").select("run_id"))


# --- packets, gates, decisions ---------------------------------------------------------------------------------------


@query("approved_cases", "SELECT doc_id AS case_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0")
def approved_cases(s, d):
    rows = table(s, d, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "approved").otherwise("candidate").alias("approval_status"), F.when(F.col("doc_id") % 3 == 0, "fixture").otherwise("historical_pr").alias("provenance_kind"))
    return packets.approved_cases(rows).select("case_id")


_TG = "e AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN upper(r) ELSE r END AS repository, count(*) AS expected, count(*) FILTER (l_discount > 0.01) AS actual, count(*) FILTER (l_discount > 0.01 AND l_quantity > 4) AS correct FROM (SELECT *, 'repo' || (l_partkey % 3) || l_returnflag AS r FROM lineitem) GROUP BY 1)"


@query("truth_gate", f"WITH {_TG}, g AS (SELECT lower(repository) AS k, count(*) AS n, count(*) FILTER (correct / CAST(actual AS DOUBLE) < 0.9) AS weak, sum(expected) AS expected, sum(actual) AS actual, sum(correct) AS correct FROM e GROUP BY 1), t AS (SELECT count(*) AS repositories, count(*) FILTER (n > 1) AS repeated, CAST(sum(weak) AS BIGINT) AS weak, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(correct) AS BIGINT) AS correct FROM g), u AS (SELECT *, round(correct / CAST(actual AS DOUBLE), 4) AS precision, round(correct / CAST(expected AS DOUBLE), 4) AS recall, {_fail(('repeated_repository', 'repeated > 0'), ('repository_precision', 'weak > 0'), ('repositories', 'repositories < 2'), ('pooled_precision', 'correct / CAST(actual AS DOUBLE) < 0.9'))} AS failures FROM t) SELECT *, failures = '' AS passed FROM u")
def truth_gate(s, d):
    r = F.concat(F.lit("repo"), (F.col("l_partkey") % 3).cast("string"), "l_returnflag")
    rows = table(s, d, "lineitem").withColumn("repository", F.when(F.col("l_suppkey") % 10 == 0, F.upper(r)).otherwise(r))
    return packets.truth_gate(rows.groupBy("repository").agg(F.count("*").alias("expected"), F.count_if(F.col("l_discount") > 0.01).alias("actual"), F.count_if((F.col("l_discount") > 0.01) & (F.col("l_quantity") > 4)).alias("correct")))


@query("scoped_calls", _EDG + " SELECT from_key, to_key FROM (SELECT *, 'p/' || (ord % 20) AS source_path FROM edges) WHERE type = 'CALLS' AND type_resolved AND source_path IN ('p/1', 'p/2', 'p/11') AND (to_key LIKE 'part:1%' OR to_key LIKE 'order:%')")
def scoped_calls(s, d):
    facts = A.edges(s, d).withColumn("source_path", F.concat(F.lit("p/"), (F.col("ord") % 20).cast("string")))
    return packets.scoped_calls(facts, s.createDataFrame([("p/1",), ("p/2",), ("p/11",)], "path string"), s.createDataFrame([("part:1",), ("order:",)], "prefix string")).select("from_key", "to_key")


@query("reviewer_agreement", "WITH f AS (SELECT l_orderkey, l_partkey, (['ann', 'bob', 'cy'])[1 + l_suppkey % 3] AS who FROM lineitem), g AS (SELECT l_orderkey % 100 AS a, l_partkey % 20 AS b, count(DISTINCT who) AS n FROM f WHERE who IN ('ann', 'bob') GROUP BY 1, 2) SELECT count(*) FILTER (n = 2) AS both, count(*) AS either, round(count(*) FILTER (n = 2) / CAST(count(*) AS DOUBLE), 4) AS agreement FROM g")
def reviewer_agreement(s, d):
    who = F.element_at(F.array(*[F.lit(x) for x in ("ann", "bob", "cy")]), (1 + F.col("l_suppkey") % 3).cast("int"))
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") % 100).alias("a"), (F.col("l_partkey") % 20).alias("b"), who.alias("who"))
    return packets.reviewer_agreement(rows, ["a", "b"], "who")


_PK = "ad AS (SELECT DISTINCT 'doc/' || l_partkey AS source_path, CAST(1 + l_orderkey % 6 AS INT) AS line, 'c' || (l_suppkey % 2) AS from_key, 't' || (l_linenumber % 3) AS to_key FROM lineitem WHERE l_quantity < 45), oc AS (SELECT DISTINCT 'doc/' || l_partkey AS source_path, CAST(1 + l_orderkey % 6 AS INT) AS line, 'c' || (l_suppkey % 2) AS from_key, 't' || (l_linenumber % 3) AS to_key FROM lineitem WHERE l_discount > 0.005), ln AS (SELECT 'doc/' || doc_id AS path, k AS line, string_split(text, chr(10))[k] AS content FROM documents, range(1, 9) AS r(k) WHERE k <= len(string_split(text, chr(10))))"


def _sets(name: str) -> str:
    return f"{name}s AS (SELECT source_path, line, string_agg(DISTINCT from_key, ',' ORDER BY from_key) AS f, string_agg(DISTINCT to_key, ',' ORDER BY to_key) AS t FROM {name} GROUP BY 1, 2)"


@query("packet_items", f"WITH {_PK}, {_sets('ad')}, {_sets('oc')}, pl AS (SELECT source_path, line FROM ad UNION SELECT source_path, line FROM oc), ex AS (SELECT pl.source_path, pl.line, string_agg(content, chr(10) ORDER BY ln.line) AS excerpt FROM pl JOIN ln ON ln.path = pl.source_path AND ln.line BETWEEN pl.line - 2 AND pl.line + 2 GROUP BY 1, 2), s AS (SELECT pl.source_path, pl.line, coalesce(ads.f, '') AS a, coalesce(ocs.f, '') AS b, coalesce(ads.t, '') AS c, coalesce(ocs.t, '') AS e, coalesce(excerpt, '') AS excerpt FROM pl LEFT JOIN ads USING (source_path, line) LEFT JOIN ocs USING (source_path, line) LEFT JOIN ex USING (source_path, line)) SELECT source_path, line, CASE WHEN a = b AND c = e THEN 'agreement_sample' ELSE 'tool_disagreement' END AS kind, excerpt, substr(sha256(source_path || chr(10) || line || chr(10) || a || chr(10) || b || chr(10) || c || chr(10) || e || chr(10) || sha256(excerpt)), 1, 20) AS item_id FROM s")
def packet_items(s, d):
    adapter, oracle = (F.coalesce(F.expr(c), F.lit(False)) for c in ("l_quantity < 45", "l_discount > 0.005"))
    facts = table(s, d, "lineitem").select(F.concat(F.lit("doc/"), _text("l_partkey")).alias("source_path"), (1 + F.col("l_orderkey") % 6).cast("int").alias("line"), F.concat(F.lit("c"), (F.col("l_suppkey") % 2).cast("string")).alias("from_key"), F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string")).alias("to_key"), adapter.alias("adapter"), oracle.alias("oracle"), (adapter | oracle).alias("queued")).filter("queued")
    lines = table(s, d, "documents").select(F.concat(F.lit("doc/"), _text("doc_id")).alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "content")).select("path", (F.col("n") + 1).alias("line"), "content")
    return packets.told_items(facts, lines).select("source_path", "line", "kind", "excerpt", "item_id")


_GATE = f"""WITH per AS (SELECT l_orderkey AS case_id, count(DISTINCT l_suppkey % 9) AS reviewers, bool_or(l_shipdate < o_orderdate OR l_shipdate >= o_orderdate + INTERVAL 900 DAY) AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
fd AS (SELECT l_orderkey AS case_id, count(*) AS causes, count(DISTINCT l_linenumber) AS kinds FROM lineitem WHERE l_discount > 0.08 GROUP BY 1),
c AS (SELECT o_orderkey AS case_id, coalesce(causes, 0) AS causes, coalesce(reviewers, 0) >= 2 AND NOT coalesce(bad, true) AND coalesce(causes, 0) = coalesce(kinds, 0) AS valid FROM orders LEFT JOIN per ON per.case_id = o_orderkey LEFT JOIN fd ON fd.case_id = o_orderkey),
ss AS (SELECT l_orderkey AS case_id, CASE WHEN l_partkey % 2 = 0 THEN 'assisted' ELSE 'control' END AS arm, l_quantity <= 40 AS timed FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT count(*) FILTER (NOT valid) AS invalid_cases, count(*) FILTER (valid) AS cases, count(*) FILTER (valid AND causes > 0) AS positive_cases, CAST(coalesce(sum(causes) FILTER (valid), 0) AS BIGINT) AS root_causes, count(*) FILTER (valid) AS dual_reviewed, count(*) FILTER (valid) AS adjudicated FROM c),
a AS (SELECT count(*) FILTER (timed) AS timed_sessions, count(*) FILTER (timed AND arm = 'assisted') AS assisted, count(*) FILTER (timed AND arm = 'control') AS control, count(*) FILTER (case_id NOT IN (SELECT case_id FROM c WHERE valid)) AS unknown_cases FROM ss),
g AS (SELECT count(*) FILTER (k > 1) AS repeated_sessions FROM (SELECT count(*) AS k FROM ss GROUP BY case_id, arm)),
z AS (SELECT *, 0::BIGINT AS repeated_cases FROM n, a, g),
f AS (SELECT *, {_fail(("invalid_case", "invalid_cases > 0"), ("unknown_case", "unknown_cases > 0"), ("repeated_session", "repeated_sessions > 0"), ("cases", f"cases < {packets.PHASE_CASES}"), ("root_causes", f"root_causes < {packets.PHASE_CAUSES}"), ("timed_sessions", f"timed_sessions < {packets.PHASE_SESSIONS}"), ("arms", "assisted = 0 OR control = 0"))} AS failures FROM z)
SELECT *, failures = '' AS passed FROM f"""


@query("phase_gate", _GATE)
def phase_gate(s, d):
    """Orders as cases, their lines as reviews."""
    orders, line = table(s, d, "orders"), table(s, d, "lineitem")
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.lit("p").alias("packet_id"), F.col("o_orderdate").alias("frozen_at"), F.lit("judge").alias("adjudicated_by"), F.expr("o_orderdate + INTERVAL 900 DAY").alias("adjudicated_at"), (F.col("o_orderkey") % 2).alias("conflict_count"))
    reviews = line.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("r"), (F.col("l_suppkey") % 9).cast("string")).alias("reviewer_id"), F.col("l_shipdate").alias("submitted_at"), F.lit("p").alias("packet_id"), F.expr("l_shipdate - INTERVAL 1 DAY").alias("calibrated_at"))
    causes = line.filter("l_discount > 0.08").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("root_cause_id"))
    sessions = line.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("case_id"), F.lit("r1").alias("reviewer_id"), F.when(F.col("l_partkey") % 2 == 0, "assisted").otherwise("control").alias("arm"), F.when(F.col("l_quantity") > 40, "late").alias("excluded_reason"))
    return packets.phase_gate(cases, reviews, causes, sessions)


@query("brief_evidence", "WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, coalesce(text, '') AS text, doc_id FROM documents) SELECT case_id, 'pr:title' AS evidence_id, 'pr_title' AS kind, 'Case ' || case_id AS label, CAST(NULL AS VARCHAR) AS path FROM t UNION ALL SELECT case_id, 'pr:body', 'pr_body', substr(trim(text), 1, 1000), NULL FROM t WHERE trim(text) <> '' UNION ALL SELECT case_id, CASE WHEN length(x) <= 300 THEN x ELSE 'evidence:sha256:' || sha256(x) END, 'diff', 'modified: +3 -1', p FROM (SELECT case_id, 'diff:' || p AS x, p FROM (SELECT case_id, 'f/' || case_id || '/' || repeat('n', 40 * CAST(doc_id % 10 AS INT)) AS p FROM t))")
def brief_evidence(s, d):
    cases = table(s, d, "documents").select(_text("doc_id").alias("case_id"), F.concat(F.lit("Case "), _text("doc_id")).alias("title"), F.col("text").alias("body"), "doc_id")
    files = cases.select("case_id", F.concat(F.lit("f/"), "case_id", F.lit("/"), F.expr("repeat('n', cast(40 * (doc_id % 10) as int))")).alias("path"), F.lit("modified").alias("status"), F.lit(3).alias("additions"), F.lit(1).alias("deletions"))
    none = lambda schema: s.createDataFrame([], schema)
    return packets.brief_evidence(cases, files, none("case_id string, id string, kind string, name string, path string"), none("case_id string, ordinal int, from_id string, type string, to_id string, evidence_path string"), none("case_id string, revision string, path string, role string"))


_CARDS = _GS + f""", gr AS (SELECT 'g' || (CAST(substr(path, 7) AS BIGINT) % 5) AS g, path FROM (SELECT DISTINCT path FROM gs WHERE path LIKE 'order/%')), uc AS ({ORACLES["unchanged_callers"]}),
fl AS (SELECT g, count(*) AS n_files FROM gr GROUP BY g), co AS (SELECT g, least(count(DISTINCT qualified_name), {packets.BRIEF_NAMES}) AS n FROM gr JOIN gs USING (path) WHERE in_head GROUP BY g),
ne AS (SELECT "group" AS g, least(count(DISTINCT name) FILTER (kind = 'caller'), {packets.BRIEF_NAMES}) AS callers, least(count(DISTINCT name) FILTER (kind = 'test'), {packets.BRIEF_NAMES}) AS tests FROM uc GROUP BY 1)
SELECT fl.g AS "group", n_files, 2 * n_files AS additions, n_files AS deletions, coalesce(n, 0) AS core, coalesce(callers, 0) AS callers, coalesce(tests, 0) AS tests, CASE WHEN n > 0 THEN 'semantic' ELSE 'diff_only' END AS level,
  array_to_string(list_slice(list_filter(['contract', 'reuse', CASE WHEN callers > 0 THEN 'callers' END, CASE WHEN tests > 0 THEN 'tests' ELSE 'missing_tests' END], lambda x: x IS NOT NULL), 1, {packets.BRIEF_QUESTIONS}), ',') AS questions FROM fl LEFT JOIN co USING (g) LEFT JOIN ne USING (g)"""


@query("behaviour_cards", _CARDS)
def behaviour_cards(s, d):
    """Cards of groups of files, with how many names each holds."""
    sy, ties, groups, files = _card_inputs(s, d)
    changed = groups.select("path", F.lit(2).alias("additions"), F.lit(1).alias("deletions"))
    out = packets.behaviour_cards(changed, groups, sy, graph.unchanged_callers(sy, ties, groups, files))
    return out.select("group", "n_files", "additions", "deletions", *[F.size(c).alias(c) for c in ("core", "callers", "tests")], "level", "questions")


@query("label_progress", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS frozen, count(*) FILTER (quality = 0) AS deferred, count(*) - count(*) FILTER (quality = 1) - count(*) FILTER (quality = 0) AS pending, count(*) FILTER (d.doc_id % 4 = 0) AS context_ready FROM documents d LEFT JOIN labels USING (doc_id)")
def label_progress(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("case_id"))
    decisions = table(s, d, "labels").filter("quality IS NOT NULL").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "frozen").otherwise("deferred").alias("status"))
    return packets.progress(docs, decisions, docs.filter("case_id % 4 = 0"))


@query("diff_evidence_problems", f"{_PAT}, ev AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'nowhere' ELSE path END AS path, CASE WHEN doc_id % 2 = 0 THEN 'RIGHT' ELSE 'LEFT' END AS side, CAST(2 AS INT) AS start_line, CAST(2 + doc_id % 2 AS INT) AS end_line FROM patches), w AS (SELECT id, path, side, unnest(range(start_line, end_line + 1)) AS line FROM ev), m AS (SELECT id, count(*) FILTER (l.path IS NULL) AS missing FROM w LEFT JOIN (SELECT DISTINCT path, CASE kind WHEN 'added' THEN 'RIGHT' ELSE 'LEFT' END AS side, CASE kind WHEN 'added' THEN right_line ELSE left_line END AS line FROM lines WHERE kind <> 'context') l ON l.path = w.path AND l.side = w.side AND l.line = w.line GROUP BY 1) SELECT ev.*, CASE WHEN ev.path = 'nowhere' THEN 'unknown_path' WHEN missing > 0 THEN 'line_not_in_diff' END AS problem FROM ev JOIN m USING (id)")
def diff_evidence_problems(s, d):
    files = A.patches(s, d)
    k = F.col("doc_id")
    evidence = files.select(k.alias("id"), F.when(k % 9 == 0, "nowhere").otherwise(F.col("path")).alias("path"), F.when(k % 2 == 0, "RIGHT").otherwise("LEFT").alias("side"), F.lit(2).alias("start_line"), (2 + k % 2).cast("int").alias("end_line"))
    return packets.diff_evidence_problems(evidence, files)


@query("context_evidence_problems", "WITH f AS (SELECT 'base' AS revision, 'd/' || doc_id AS path, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 UNION ALL SELECT 'head', 'd/' || doc_id, len(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL), ev AS (SELECT doc_id AS id, 'd/' || doc_id AS path, (['base', 'head', 'both'])[1 + doc_id % 3] AS revision, CAST(1 + doc_id % 5 AS INT) AS end_line, CASE WHEN doc_id % 2 = 0 THEN 'sym' || (doc_id % 4) END AS symbol FROM documents WHERE text IS NOT NULL), w AS (SELECT id, path, end_line, unnest(CASE revision WHEN 'both' THEN ['base', 'head'] ELSE [revision] END) AS revision FROM ev), c AS (SELECT id, count(*) FILTER (n IS NULL) AS gone, count(*) FILTER (end_line > n) AS short FROM w LEFT JOIN f USING (revision, path) GROUP BY 1) SELECT ev.*, CASE WHEN gone > 0 THEN 'file_not_in_packet' WHEN short > 0 THEN 'line_beyond_file' WHEN symbol IS NOT NULL AND symbol <> 'sym2' THEN 'symbol_not_in_packet' END AS problem FROM ev JOIN c USING (id)")
def context_evidence_problems(s, d):
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    k, path = F.col("doc_id"), F.concat(F.lit("d/"), _text("doc_id")).alias("path")
    bundle = docs.filter("doc_id % 3 <> 0").select(F.lit("base").alias("revision"), path, F.col("text").alias("content")).unionByName(docs.select(F.lit("head").alias("revision"), path, F.col("text").alias("content")))
    revision = F.element_at(F.array(F.lit("base"), F.lit("head"), F.lit("both")), (1 + k % 3).cast("int"))
    evidence = docs.select(k.alias("id"), path, revision.alias("revision"), (1 + k % 5).cast("int").alias("end_line"), F.when(k % 2 == 0, F.concat(F.lit("sym"), (k % 4).cast("string"))).alias("symbol"))
    known = bundle.select(F.lit("i").alias("id"), F.lit("sym2").alias("name"), "path", "revision")
    return packets.context_evidence_problems(evidence, bundle, known)


@query("recovery_assessments", f"SELECT o_orderkey AS run_id, blockers, CASE WHEN blockers = '' THEN 'candidate' ELSE 'blocked' END AS verdict FROM (SELECT o_orderkey, {_fail(('outside_scope', 'o_orderkey % 7 = 0'), ('remote_not_verified', 'o_orderkey % 5 = 0'), ('frozen_output_missing', 'o_orderkey % 3 = 0'), ('journal_conflict', 'o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0'))} AS blockers FROM orders)")
def recovery_assessments(s, d):
    k = F.col("o_orderkey")
    of = lambda *c: table(s, d, "orders").select(k.alias("run_id"), *c)
    journal = of(F.lit("check_start").alias("operation"), F.lit("a").alias("request_hash"), F.when(k % 4 == 0, "sent").otherwise("confirmed").alias("state")).unionByName(of(F.lit("check_result").alias("operation"), F.lit("b").alias("request_hash"), F.lit("sent").alias("state"))).unionByName(of(F.lit("summary_comment").alias("operation"), F.lit("c").alias("request_hash"), F.lit("sent").alias("state")))
    outputs = of(F.lit("a").alias("start_hash"), F.lit("b").alias("result_hash"), F.lit("c").alias("summary_hash")).filter("run_id % 3 <> 0")
    return packets.recovery_assessment(of((k % 7 != 0).alias("in_scope")), of(F.lit("check_start").alias("operation"), F.when(k % 5 == 0, "unknown").otherwise("verified_remote").alias("result")), outputs, journal)


_ELIGIBLE = "ch AS (SELECT o_orderkey AS change_id, o_orderstatus <> 'P' AS merged, o_orderkey % 8 = 0 AS bot, CASE WHEN o_orderkey % 6 = 0 THEN 'password: abcd' ELSE 'fix panic' END AS title FROM orders), fl AS (SELECT l_orderkey AS change_id, (['a.go', 'vendor/b.go', 'c.txt', 'd_test.go'])[1 + l_partkey % 4] AS path, repeat('x', CAST(l_quantity * CASE WHEN l_partkey % 20 = 0 THEN 3000 ELSE 10 END AS INT)) AS patch FROM lineitem)"


@query("eligible_changes", f"WITH {_ELIGIBLE}, g AS (SELECT change_id, count(*) AS n_files, CAST(coalesce(sum(length(patch)) FILTER (path IN ('a.go', 'd_test.go')), 0) AS BIGINT) AS patch_chars, count(*) FILTER (path IN ('a.go', 'd_test.go')) AS r FROM fl GROUP BY 1) SELECT change_id, n_files, patch_chars FROM g JOIN ch USING (change_id) WHERE merged AND NOT bot AND title = 'fix panic' AND n_files <= 25 AND r >= 1 AND patch_chars <= 120000")
def eligible_changes(s, d):
    k = F.col("o_orderkey")
    changes = table(s, d, "orders").select(k.alias("change_id"), (F.col("o_orderstatus") != "P").alias("merged"), (k % 8 == 0).alias("bot"), F.when(k % 6 == 0, "password: abcd").otherwise("fix panic").alias("title"), F.lit(None).cast("string").alias("body"))
    names = F.array(*[F.lit(x) for x in ("a.go", "vendor/b.go", "c.txt", "d_test.go")])
    files = table(s, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.element_at(names, (1 + F.col("l_partkey") % 4).cast("int")).alias("path"), F.expr("repeat('x', cast(l_quantity * CASE WHEN l_partkey % 20 = 0 THEN 3000 ELSE 10 END AS INT))").alias("patch"))
    return packets.eligible_changes(changes, files, (".go",))


@query("reverse_fixes", "SELECT o_orderkey AS change_id, 'a.go' AS path, 2 AS additions, 1 AS deletions, '@@ -1 +1,2 @@' || chr(10) || '-' || CASE WHEN o_orderkey % 4 = 1 THEN '}' ELSE 'return x' END || chr(10) || '+if x == nil {' || chr(10) || '+}' AS patch FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def reverse_fixes(s, d):
    k = F.col("o_orderkey")
    changes = table(s, d, "orders").select(k.alias("change_id"), F.lit(True).alias("merged"), F.lit(False).alias("bot"), F.when(k % 3 == 0, "fix docs").when(k % 5 == 0, "add thing").otherwise("fix nil pointer").alias("title"), F.lit("").alias("labels"))
    body = F.when(k % 4 == 1, "}").otherwise("return x")
    files = table(s, d, "orders").select(k.alias("change_id"), F.lit("a.go").alias("path"), F.lit("modified").alias("status"), F.lit(1).alias("additions"), F.lit(2).alias("deletions"), F.concat(F.lit("@@ -1,2 +1 @@\n+"), body, F.lit("\n-if x == nil {\n-}")).alias("patch"))
    return packets.reverse_fixes(changes, files)


@query("exported_labels", "SELECT doc_id AS case_id, 'frozen' AS status FROM labels WHERE quality = 1")
def exported_labels(s, d):
    cases = table(s, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("case_id"))
    return packets.exported_labels(cases, cases.withColumn("status", F.lit("frozen")))


@query("coverage_limits", "WITH x AS (SELECT p_brand, count(*) AS eligible, count(*) FILTER (p_size > 3) AS indexed, count(*) FILTER (p_size = 50) AS failed, count(*) FILTER (p_size = 2) AS skipped, count(*) FILTER (p_size = 49) AS unresolved FROM part GROUP BY 1), y AS (SELECT *, CASE WHEN failed + skipped > 0 THEN 'PARTIAL' ELSE 'SEMANTIC' END AS level FROM x) SELECT p_brand, l AS limitations, l = '' AS complete FROM (SELECT p_brand, " + _fail(("base_not_semantic", "level <> 'SEMANTIC'"), ("base_not_all_indexed", "indexed <> eligible"), ("base_failed", "failed > 0"), ("base_skipped", "skipped > 0"), ("base_unresolved", "unresolved > 0"), ("adapters_differ", "p_brand LIKE '%3'"), ("no_anchor", "p_brand LIKE '%1'")) + " AS l FROM y)")
def coverage_limits(s, d):
    n = F.count_if
    size = F.col("p_size")
    base = table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("eligible"), n(size > 3).alias("indexed"), n(size == 50).alias("failed"), n(size == 2).alias("skipped"), n(size == 49).alias("unresolved"))
    base = base.withColumn("level", F.when(F.col("failed") + F.col("skipped") > 0, "PARTIAL").otherwise("SEMANTIC")).withColumn("adapter", F.lit("v1"))
    head = base.select("p_brand", "eligible", F.col("eligible").alias("indexed"), *[F.lit(0).alias(c) for c in ("failed", "skipped", "unresolved")], F.lit("SEMANTIC").alias("level"), F.when(F.col("p_brand").endswith("3"), "v2").otherwise("v1").alias("adapter"))
    return packets.coverage_limits(base, head, "p_brand", base.filter("p_brand NOT LIKE '%1'"))


@query("decision_problems", "SELECT o_orderkey AS decision_id, " + _fail(("head_sha", "o_orderkey % 9 = 0"), ("goal", "o_orderkey % 10 = 0"), ("budget", "o_orderkey % 11 = 0"), ("incomplete_search", "o_orderkey % 2 = 0 AND o_orderkey % 7 = 0"), ("open_candidates", "o_orderkey % 2 = 0 AND o_orderkey % 3 = 0"), ("rejected_candidate", "o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0")) + " AS problems FROM orders")
def decision_problems(s, d):
    k = F.col("o_orderkey")
    of = lambda *c: table(s, d, "orders").select(*c)
    same = [F.lit("b").alias("base_sha"), F.lit("a").alias("adapter"), F.lit("m").alias("base_model"), F.lit("n").alias("head_model")]
    new = k % 2 == 0
    decisions = of(k.alias("decision_id"), k.alias("investigation_id"), *same, F.when(k % 9 == 0, "x").otherwise("h").alias("head_sha"), F.when(new, "new").otherwise("reuse").alias("strategy"), F.when(k % 10 == 0, "short").otherwise("a goal of enough letters").alias("goal"), F.lit("because it is needed here").alias("justification"), F.when(~new, F.concat(F.lit("c"), k.cast("string"))).alias("selected_id"), F.when(k % 11 == 0, 51).otherwise(3).alias("max_files"), F.lit(9).alias("max_symbols"), F.lit(0).alias("expected_revision"))
    investigations = of(k.alias("investigation_id"), *same, F.lit("h").alias("head_sha"), (k % 7 != 0).alias("complete"), F.lit(4).alias("searched"))
    candidates = of(k.alias("investigation_id"), F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"))
    return packets.decision_problems(decisions, investigations, candidates, of(k.alias("decision_id"), F.concat(F.lit("c"), k.cast("string")).alias("candidate_id")).filter("decision_id % 3 <> 0"))


@query("patch_problems", "SELECT o_orderkey AS proposal_id, " + _fail(("option", "o_orderkey % 8 = 0"), ("other_behavior", "o_orderkey % 8 <> 0 AND o_orderkey % 6 = 0"), ("files", "o_orderkey % 4 = 3"), ("contract", "o_orderkey % 5 = 0 AND o_orderkey % 2 = 0"), ("verification", "o_orderkey % 7 = 0")) + " AS problems FROM orders")
def patch_problems(s, d):
    k = F.col("o_orderkey")
    of = lambda *c: table(s, d, "orders").select(*c)
    some = lambda n: F.expr(f"transform(sequence(1, {n}), x -> cast(x as string))")
    proposals = of(k.alias("proposal_id"), k.alias("behavior_id"), k.alias("option_id"), F.expr("transform(sequence(1, cast(1 + o_orderkey % 4 as int)), x -> cast(x as string))").alias("files"), some(2).alias("symbols"), (k % 5 == 0).alias("changes_contract"), F.when(k % 7 != 0, some(1)).alias("verification"))
    decisions = of(k.alias("behavior_id"), F.lit(3).alias("max_files"), F.lit(2).alias("max_symbols"), (k % 2 == 1).alias("contract_allowed"))
    options = of(k.alias("option_id"), F.when(k % 6 == 0, k + 1).otherwise(k).alias("behavior_id")).filter("option_id % 8 <> 0")
    return packets.patch_problems(proposals, decisions, options)


@query("solution_options", "WITH o AS (SELECT o_orderkey AS behavior_id, (['reuse', 'extend', 'new'])[1 + o_orderkey % 3] AS strategy, CASE WHEN o_orderkey % 3 <> 2 THEN 'c' || o_orderkey END AS candidate_id, CASE WHEN o_orderkey % 3 <> 2 THEN 'lib/x,src/a' ELSE 'src/a,src/b' END AS expected_files, CASE WHEN o_orderkey % 3 <> 2 THEN 'X' ELSE '' END AS expected_symbols FROM orders) SELECT behavior_id, 'primary' AS option, strategy, candidate_id, expected_files, expected_symbols FROM o UNION ALL SELECT behavior_id, 'minimal-reuse', 'reuse', candidate_id, expected_files, expected_symbols FROM o WHERE strategy = 'extend'")
def solution_options(s, d):
    k = F.col("o_orderkey")
    decisions = table(s, d, "orders").select(k.alias("behavior_id"), F.element_at(F.array(F.lit("reuse"), F.lit("extend"), F.lit("new")), (1 + k % 3).cast("int")).alias("strategy"), F.when(k % 3 != 2, F.concat(F.lit("c"), k.cast("string"))).alias("selected_id"), F.array(F.lit("src/a"), F.lit("src/b")).alias("changed_files"), F.lit(2).alias("max_files"))
    candidates = table(s, d, "orders").select(F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), F.lit("X").alias("name"), F.lit("lib/x").alias("path"))
    out = packets.solution_options(decisions, candidates)
    return out.select("behavior_id", "option", "strategy", "candidate_id", F.array_join("expected_files", ",").alias("expected_files"), F.array_join("expected_symbols", ",").alias("expected_symbols"))


@query("next_revisions", "SELECT o_custkey, o_orderkey, o_orderkey % 4 = coalesce(n, 0) AS accepted, CASE WHEN o_orderkey % 4 = coalesce(n, 0) THEN coalesce(n, 0) + 1 END AS revision FROM orders LEFT JOIN (SELECT c_custkey, c_custkey % 4 AS n FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey")
def next_revisions(s, d):
    asked = table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("expected_revision"))
    history = table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 4).alias("revision"))
    return packets.next_revisions(asked, history, "o_custkey").select("o_custkey", "o_orderkey", "accepted", "revision")


# --- sources ---------------------------------------------------------------------------------------------------------

_REPO = "rf AS (SELECT doc_id, source AS repo, (['src/a.java', 'target/b.java', 'pom.xml', 'mod/build.gradle', 'mod/settings.gradle', 'img/c.png', 'node_modules/d.js', '../e.md', 'docs/f.md'])[1 + doc_id % 9] AS name, coalesce(text, '') AS content FROM documents), rp AS (SELECT *, CASE WHEN name LIKE '../%' THEN name ELSE doc_id || '/' || name END AS path FROM rf)"


def _repo_files(s, d):
    names = F.array(*[F.lit(x) for x in ("src/a.java", "target/b.java", "pom.xml", "mod/build.gradle", "mod/settings.gradle", "img/c.png", "node_modules/d.js", "../e.md", "docs/f.md")])
    name = F.element_at(names, (1 + F.col("doc_id") % 9).cast("int"))
    return table(s, d, "documents").select(F.col("source").alias("repo"), F.when(name.startswith("../"), name).otherwise(F.concat(_text("doc_id"), F.lit("/"), name)).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query("contents_at_ref", "SELECT o_orderkey, 'p/' || o_custkey AS path, 'r' || (o_orderkey % 2) AS ref, c_name AS content FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = o_orderkey % 2")
def contents_at_ref(s, d):
    wanted = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("p/"), _text("o_custkey")).alias("path"), F.concat(F.lit("r"), (F.col("o_orderkey") % 2).cast("string")).alias("ref"))
    files = table(s, d, "customer").select(F.concat(F.lit("p/"), _text("c_custkey")).alias("path"), F.concat(F.lit("r"), (F.col("c_custkey") % 2).cast("string")).alias("ref"), F.col("c_name").alias("content"))
    return context.contents_at(wanted, files).select("o_orderkey", "path", "ref", "content")


@query("safe_archive", f"WITH {_REPO} SELECT path, CAST(strlen(content) AS BIGINT) AS n_bytes, CASE WHEN path LIKE '../%' THEN 'unsafe_path' WHEN strlen(content) > 5000 THEN 'too_large' ELSE 'kept' END AS status FROM rp")
def safe_archive(s, d):
    return packets.safe_files(_repo_files(s, d), 1 << 40, 1 << 50, 5000)


@query("packet_files", f"WITH {_REPO} SELECT 'head' AS revision, path, CASE WHEN name LIKE '%pom.xml' OR name LIKE '%build.gradle' OR name LIKE '%settings.gradle' THEN 'build' WHEN name LIKE '%.md' THEN 'documentation' ELSE 'source' END AS role, CASE WHEN name LIKE '%.java' THEN 'java' END AS language, strlen(content) AS n_bytes FROM rp WHERE name NOT LIKE 'target/%' AND name NOT LIKE 'node_modules/%' AND name NOT LIKE '%.png' AND strlen(content) <= 5000")
def packet_files(s, d):
    return context.packet_files(_repo_files(s, d), "head", 1 << 40, 1 << 50, 5000).select("revision", "path", "role", "language", F.octet_length("content").cast("long").alias("n_bytes"))


@query("packet_relationships", _EDG + " SELECT 'head:' || from_key AS from_id, 'head:' || to_key AS to_id, CASE WHEN type = 'CALLS' THEN 'calls' ELSE 'references' END AS type, 'a/b' AS evidence_path, CAST(1 AS INT) AS evidence_line FROM edges WHERE to_key IN (SELECT 'part:' || p_partkey FROM part WHERE p_size > 10) AND from_key LIKE 'order:%'")
def packet_relationships(s, d):
    known = table(s, d, "part").filter("p_size > 10").select(F.concat(F.lit("part:"), _text("p_partkey")).alias("stable_key")).unionByName(table(s, d, "orders").select(F.concat(F.lit("order:"), _text("o_orderkey")).alias("stable_key")))
    return context.packet_relationships(known, A.edges(s, d).withColumn("source_path", F.lit("a\\b")).withColumn("source_line", F.lit(1)), "head")


@query("packet_identity", f"WITH {_REPO}, h AS (SELECT sha256('head' || chr(10) || path || chr(10) || 'source' || chr(10) || '' || chr(10) || sha256(content)) AS h FROM rp) SELECT d AS digest, 'review-context-' || substr(d, 1, 24) AS packet_id FROM (SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h)")
def packet_identity(s, d):
    return context.packet_identity(_repo_files(s, d).select(F.lit("head").alias("revision"), "path", F.lit("source").alias("role"), F.lit(None).cast("string").alias("language"), "content"))


@query("build_modules", f"WITH {_REPO}, de AS (SELECT *, name IN ('pom.xml', 'mod/build.gradle', 'mod/settings.gradle') AS isd FROM rp), m AS (SELECT repo, CASE WHEN bool_or(isd AND name = 'pom.xml') AND bool_or(isd AND name <> 'pom.xml') THEN 'MIXED' WHEN bool_or(isd AND name = 'pom.xml') THEN 'MAVEN' WHEN bool_or(isd) THEN 'GRADLE' ELSE 'UNKNOWN' END AS system, sha256(coalesce(string_agg(path || chr(10) || sha256(content), chr(10) ORDER BY path || chr(10) || sha256(content)) FILTER (isd), '')) AS model_hash, bool_or(isd AND name <> 'mod/settings.gradle') AS has FROM de GROUP BY 1), o AS (SELECT repo, regexp_replace(path, '/?[^/]*$', '') AS module, string_agg(path, ',' ORDER BY path) AS descriptors, bool_or(name <> 'mod/settings.gradle') AS b FROM de WHERE isd GROUP BY 1, 2) SELECT o.repo, module, descriptors, system, model_hash FROM o JOIN m USING (repo) WHERE b UNION ALL SELECT repo, '', '', system, model_hash FROM m WHERE NOT has")
def build_modules(s, d):
    return context.build_modules(_repo_files(s, d), "repo").select("repo", "module", "descriptors", "system", "model_hash")


@query("parsed_policies", "SELECT c_custkey, CASE WHEN ok AND c_custkey % 4 = 0 THEN 'zh' ELSE 'en' END AS language, ok AND c_custkey % 2 = 0 AS blocking, CAST(CASE WHEN ok THEN c_custkey % 60 ELSE 10 END AS INT) AS max_inline, CAST(NOT ok AS INT) AS warnings FROM (SELECT c_custkey, c_custkey % 4 <> 3 AND c_custkey % 60 <= 50 AS ok FROM customer)")
def parsed_policies(s, d):
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 4 == 3, "version: 9").otherwise("version: 1"), F.lit("\nreview:\n  language: "), F.when(k % 4 == 0, "zh").otherwise("en"), F.lit("\n  blocking: "), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("\n  maxInlineComments: "), (k % 60).cast("string"), F.lit("\nexclude:\n  - 'gen/**'\n"))
    out = policy.policies(table(s, d, "customer").select("c_custkey", text.alias("text")))
    return out.select("c_custkey", "language", "blocking", "max_inline", F.size("warnings").alias("warnings"))


# --- symbols ---------------------------------------------------------------------------------------------------------


def _sources(s, d):
    k = _text("p_partkey")
    body = F.concat(F.lit("public class P"), k, F.lit(" {\n  void run(int a, Map<String, Integer> b) {\n    helper(a); // other(a)\n    missing(b);\n  }\n  private void helper(int a) { count += a; }\n}\n"))
    return A.dealt(table(s, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("src/P"), k, F.lit(".java")).alias("path"), body.alias("content"))


@query("extracted_symbols", "WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'java:src/P' || k || '.java:' || x.t AS stable_key, x.kind, x.s AS start_line, x.e AS end_line, x.x AS exported FROM (SELECT k, unnest([{t: 'file:$module', kind: 'file', s: 1, e: 8, x: true}, {t: 'class:P' || k, kind: 'class', s: 1, e: 7, x: true}, {t: 'method:P' || k || '.run/2', kind: 'method', s: 2, e: 5, x: false}, {t: 'method:P' || k || '.helper/1', kind: 'method', s: 6, e: 6, x: false}]) AS x FROM p)")
def extracted_symbols(s, d):
    return symbols.extract_symbols(_sources(s, d)).select("stable_key", "kind", "start_line", "end_line", "exported")


@query("extracted_calls", "SELECT 'java:src/P' || p_partkey || '.java:method:P' || p_partkey || '.run/2' AS from_key, CASE k WHEN 0 THEN 'java:src/P' || p_partkey || '.java:method:P' || p_partkey || '.helper/1' ELSE 'unresolved:missing' END AS to_key, CASE k WHEN 0 THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence, CAST(3 + k AS INT) AS source_line FROM part, range(0, 2) AS r(k)")
def extracted_calls(s, d):
    return symbols.extract_calls(_sources(s, d)).filter("from_key LIKE '%.run/2'").select("from_key", "to_key", "confidence", "source_line")


@query("markdown_rules_quoted", "SELECT p_partkey, 'md-' || substr(sha256('\"' || p_name || '\"'), 1, 12) AS rule_key FROM part WHERE position('\"' IN p_name) = 0")
def markdown_rules_quoted(s, d):
    rows = table(s, d, "part").filter("instr(p_name, '\"') = 0").select(_text("p_partkey").alias("source"), F.concat(F.lit("- "), "p_name").alias("text"))
    return review.markdown_rules(rows, quoted=True).select(F.col("source").cast("long").alias("p_partkey"), "rule_key")


# --- state -----------------------------------------------------------------------------------------------------------


@query("index_coverage", "WITH f AS (SELECT doc_id // 50 AS g, doc_id, (['src/a.java', 'b.py', 'c.unknown', '../d.go', 'e.rb'])[1 + doc_id % 5] AS path, CASE WHEN doc_id % 7 <> 0 THEN text END AS content, doc_id % 11 = 0 AS bad FROM documents), p AS (SELECT *, path <> '../d.go' AND path <> 'c.unknown' AS use FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY g, use ORDER BY doc_id) AS n FROM p), s AS (SELECT g, CASE WHEN path = '../d.go' THEN 'skipped' WHEN path = 'c.unknown' THEN 'skipped' WHEN n > 20 THEN 'skipped' WHEN content IS NULL THEN 'absent' WHEN strlen(content) > 4000 THEN 'skipped' WHEN bad THEN 'failed' ELSE 'indexed' END AS status FROM r), c AS (SELECT g, count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'absent') AS absent, count(*) FILTER (status = 'failed') AS failed FROM s GROUP BY 1) SELECT *, CASE WHEN indexed = 0 THEN 'FAILED' WHEN failed > 0 OR skipped > 0 OR g % 2 = 0 THEN 'PARTIAL' ELSE 'SEMANTIC' END AS level FROM c")
def index_coverage(s, d):
    k = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in ("src/a.java", "b.py", "c.unknown", "../d.go", "e.rb")])
    files = table(s, d, "documents").select(F.floor(k / 50).alias("g"), "doc_id", F.element_at(names, (1 + k % 5).cast("int")).alias("path"), F.when(k % 7 != 0, F.col("text")).alias("content"), (k % 11 == 0).alias("parse_error"))
    status = review.index_status(files, "g", "doc_id", 20, 4000)
    return review.coverage_level(status, "g", status.filter("g % 2 = 0"))


@query("distinct_edges", "WITH e AS (SELECT 'o' || l_orderkey AS from_key, 'p' || (l_partkey % 20) AS to_key, l_returnflag AS type, l_linenumber AS source_line, 's' || (l_suppkey % 2) AS source_path, " + _LINE + " AS k FROM lineitem) SELECT 'typed_first' AS variant, from_key, to_key, k FROM (SELECT *, row_number() OVER (PARTITION BY from_key, to_key, type, source_line ORDER BY k) AS n FROM e) WHERE n = 1 UNION ALL SELECT 'typed_last', from_key, to_key, k FROM (SELECT *, row_number() OVER (PARTITION BY from_key, to_key, type, source_line ORDER BY k DESC) AS n FROM e) WHERE n = 1 UNION ALL SELECT 'placed_first', from_key, to_key, k FROM (SELECT *, row_number() OVER (PARTITION BY from_key, to_key, source_path, source_line ORDER BY k) AS n FROM e) WHERE n = 1")
def distinct_edges(s, d):
    edges = table(s, d, "lineitem").select(F.concat(F.lit("o"), _text("l_orderkey")).alias("from_key"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("to_key"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("source_line"), F.concat(F.lit("s"), (F.col("l_suppkey") % 2).cast("string")).alias("source_path"), F.expr(_LINE).alias("k"))
    one = lambda name, **how: state.distinct_edges(edges, ["k"], **how).select(F.lit(name).alias("variant"), "from_key", "to_key", "k")
    return one("typed_first").unionByName(one("typed_last", last=True)).unionByName(one("placed_first", typed=False))


@query("replaced_children", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS side FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber <= 2")
def replaced_children(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    new = line.filter("l_orderkey % 3 = 0 AND l_linenumber <= 2")
    kept = state.replace_children(line.withColumn("side", F.lit("old")), new.withColumn("side", F.lit("new")), ["l_orderkey"])
    none = line.filter("l_orderkey % 3 = 0").select("l_orderkey").distinct().join(new.select("l_orderkey").distinct(), "l_orderkey", "left_anti")
    return kept.join(none, "l_orderkey", "left_anti")


@query("status_counts", f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 700 DAY GROUP BY 1")
def status_counts(s, d):
    return state.status_counts(table(s, d, "orders"), "o_orderstatus", "o_orderdate", _ts(NOW) - F.expr("INTERVAL 700 DAY"))


@query("deletion_receipts", "SELECT sha256(o_custkey || ':receipt') AS receipt, count(*) AS runs FROM orders GROUP BY o_custkey")
def deletion_receipts(s, d):
    return state.deletion_receipts(table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("runs")), "o_custkey", ["runs"])


@query("budget_states", f"WITH {_PLANS}, sp AS (SELECT pl.run_id, count(*) AS calls, CAST(sum(request_bytes) AS BIGINT) AS bytes, count(*) FILTER (ca.id IS NULL OR status = 'reserved') AS pending, count(*) FILTER (max_calls <> 4) AS changed FROM pl LEFT JOIN ca ON ca.id = call_id GROUP BY 1), un AS (SELECT run_id, count(*) AS unplanned FROM ca WHERE id NOT IN (SELECT call_id FROM pl) GROUP BY 1) SELECT coalesce(sp.run_id, un.run_id) AS run_id, coalesce(calls, 0) AS calls, coalesce(bytes, 0) AS bytes, coalesce(pending, 0) AS pending, coalesce(unplanned, 0) AS unplanned, coalesce(changed, 0) AS changed FROM sp FULL JOIN un ON sp.run_id = un.run_id")
def budget_states(s, d):
    line = table(s, d, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    plans = line.filter("l_suppkey % 9 <> 0").select(key.alias("call_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_quantity") * 10).cast("long").alias("request_bytes"), F.when(F.col("l_partkey") % 50 == 0, 3).otherwise(4).alias("max_calls"), F.lit(1000).alias("max_input_bytes"))
    calls = line.filter("l_suppkey % 7 <> 0").select(key.alias("id"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_partkey") % 40 == 0, "reserved").otherwise("done").alias("status"))
    return jobs.budget_state(plans, calls, 4, 1000)


@query("unified_edits", "SELECT p_partkey AS change_id, 'f' AS path, 1::BIGINT AS removed, 2::BIGINT AS added, CASE WHEN p_partkey % 5 = 0 THEN 'invalid_range' END AS refused, CASE WHEN p_partkey % 5 <> 0 THEN '--- a/f' || chr(10) || '+++ b/f' || chr(10) || '@@ -2,1 +2,2 @@' || chr(10) || '-' || p_type || chr(10) || '+x' || chr(10) || '+' || p_brand END AS diff FROM part")
def unified_edits(s, d):
    part = table(s, d, "part")
    files = part.select(F.col("p_partkey").alias("change_id"), F.lit("f").alias("path"), F.concat_ws("\n", "p_name", "p_type", F.lit("end")).alias("content"))
    at = F.when(F.col("p_partkey") % 5 == 0, 9).otherwise(2)
    edits = part.select(F.col("p_partkey").alias("change_id"), F.lit("f").alias("path"), at.alias("start_line"), at.alias("end_line"), F.array(F.lit("x"), F.col("p_brand")).alias("replacement"))
    return diff.unified_edits(files, edits)


@query("holdout_files", "SELECT 'r' AS repository, 'c' AS commit_sha, 'd/' || doc_id AS path, CAST(n_lines AS INT) AS n_lines, CAST(0 AS INT) AS n_calls, sha256('v1' || chr(10) || 'r' || chr(10) || 'c' || chr(10) || 'd/' || doc_id) AS sample_rank FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[A-Za-z_$][A-Za-z0-9_$]*\\s*\\(')) WHERE n_lines BETWEEN 2 AND 240 ORDER BY sample_rank LIMIT 10")
def holdout_files(s, d):
    from patchloom.operators import evaluation

    docs = table(s, d, "documents").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[A-Za-z_$][A-Za-z0-9_$]*\s*\("))
    return evaluation.holdout(docs.select(F.lit("r").alias("repository"), F.lit("c").alias("commit_sha"), F.concat(F.lit("d/"), _text("doc_id")).alias("path"), F.col("text").alias("content")), "v1", 10, least=2, calls=0)


@query("unique_name_links_distinct", "WITH names AS (SELECT p_name AS name, count(*) AS n, 'part:' || min(p_partkey) AS k FROM part WHERE p_size % 10 <> 0 GROUP BY p_name), e AS (SELECT 'order:' || l_orderkey AS from_key, p_name AS name, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT from_key, CASE WHEN n = 1 THEN k ELSE 'unresolved:' || e.name END AS to_key, max(CASE WHEN n = 1 THEN 0.75 ELSE 0.4 END)::DOUBLE AS confidence FROM e LEFT JOIN names ON names.name = e.name GROUP BY 1, 2")
def unique_name_links_distinct(s, d):
    """The variant without file symbols, of equal edges one."""
    part, line = table(s, d, "part"), table(s, d, "lineitem")
    known = part.select(F.concat(F.lit("part:"), _text("p_partkey")).alias("stable_key"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 10 == 0, "file").otherwise("part").alias("kind"))
    used = line.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select(F.concat(F.lit("order:"), _text("l_orderkey")).alias("from_key"), F.concat(F.lit("unresolved:"), "p_name").alias("to_key"), F.lit(0.4).alias("confidence"))
    return graph.link_unique_names(used, known, 0.75, files=False, again=True)
