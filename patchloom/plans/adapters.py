"""The star-schema tables seen as code relations, so that every operator runs on real rows at every scale.

The data is synthetic and stands in for symbols, edges, patches and logs. Each derivation is also given in SQL, for the
oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.sources.tables import table

_KEY = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over four tasks a core: a small file, which a scan gives to a task or two, may hold much work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def symbols(spark: SparkSession, d: str, head: bool) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.filter(F.col("p_partkey") % 10 != (1 if head else 0))
    changed = F.when(F.col("p_partkey") % 7 == 0, "!").otherwise("") if head else F.lit("")
    return rows.select(_KEY("part", "p_partkey").alias("stable_key"), F.col("p_brand").alias("kind"), F.col("p_name").alias("qualified_name"), F.col("p_type").alias("signature"), F.sha2(F.concat("p_type", "p_name", changed), 256).alias("content_hash"), (F.col("p_size") % 2 == 0).alias("exported"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey % 50 = 0").select(_KEY("part", "p_partkey").alias("stable_key"), F.col("p_brand").alias("kind"), F.col("p_name").alias("qualified_name"), (F.col("p_size") % 2 == 0).alias("exported"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders call the parts of their lines (or import them, where returned), customers call their orders."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    confidence = F.round(1 - F.col("l_discount"), 3)
    lines = line.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_discount")).alias("first")).select("l_orderkey", "l_partkey", "first.*")
    used = lines.select(_KEY("order", "l_orderkey").alias("from_key"), _KEY("part", "l_partkey").alias("to_key"), F.when(F.col("l_returnflag") == "R", "IMPORTS").otherwise("CALLS").alias("type"), confidence.alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_linestatus") == "F").alias("type_resolved"))
    placed = orders.select(_KEY("customer", "o_custkey").alias("from_key"), _KEY("order", "o_orderkey").alias("to_key"), F.lit("CALLS").alias("type"), F.lit(1.0).alias("confidence"), (F.col("o_orderkey") * 10).alias("ord"), (F.col("o_orderstatus") != "P").alias("type_resolved"))
    return used.unionByName(placed)


def patches(spark: SparkSession, d: str) -> DataFrame:
    """documents as changed files, twenty to a change: every third line is context, added or deleted."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    lines = F.split("text", "\n")
    signed = F.transform(lines, lambda x, k: F.concat(F.when(k % 3 == 0, " ").when(k % 3 == 1, "+").otherwise("-"), x))
    n = F.size(lines).cast("string")
    patch = F.concat(F.lit("@@ -1,"), n, F.lit(" +1,"), n, F.lit(" @@\n"), F.array_join(signed, "\n"))
    size = F.size(lines)
    return docs.select("doc_id", F.floor(F.col("doc_id") / 20).alias("change_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), patch.alias("patch"), F.floor((size + 1) / 3).cast("long").alias("additions"), F.floor(size / 3).cast("long").alias("deletions"))


def graph_symbols(spark: SparkSession, d: str, head: bool) -> DataFrame:
    """Parts of one side, orders and customers as symbols with paths; orders of the first priority stand for tests."""
    part = symbols(spark, d, head).join(table(spark, d, "part").select(_KEY("part", "p_partkey").alias("stable_key"), F.concat(F.lit("part/"), (F.col("p_partkey") % 50).cast("string")).alias("path")), "stable_key")
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    rows = part.select("stable_key", "kind", "qualified_name", "path", F.lit(False).alias("test_source"))
    rows = rows.unionByName(orders.select(_KEY("order", "o_orderkey").alias("stable_key"), F.lit("order").alias("kind"), F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("qualified_name"), F.concat(F.lit("order/"), (F.col("o_orderkey") % 100).cast("string")).alias("path"), F.col("o_orderpriority").startswith("1").alias("test_source")))
    return rows.unionByName(customer.select(_KEY("customer", "c_custkey").alias("stable_key"), F.lit("customer").alias("kind"), F.col("c_name").alias("qualified_name"), F.concat(F.lit("customer/"), (F.col("c_custkey") % 10).cast("string")).alias("path"), F.lit(False).alias("test_source")))


GRAPH_SYMBOLS_SQL = """
gs AS (SELECT 'part:' || p_partkey AS stable_key, p_brand AS kind, p_name AS qualified_name, 'part/' || (p_partkey % 50) AS path, false AS test_source, p_partkey % 10 <> 0 AS in_base, p_partkey % 10 <> 1 AS in_head FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'order.' || o_orderkey, 'order/' || (o_orderkey % 100), o_orderpriority LIKE '1%', true, true FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'customer/' || (c_custkey % 10), false, true, true FROM customer)"""
SYMBOLS_SQL = """
base AS (SELECT 'part:' || p_partkey AS stable_key, p_brand AS kind, p_name AS qualified_name, p_type AS signature,
  sha256(p_type || p_name) AS content_hash, p_size % 2 = 0 AS exported FROM part WHERE p_partkey % 10 <> 0),
head AS (SELECT 'part:' || p_partkey AS stable_key, p_brand AS kind, p_name AS qualified_name, p_type AS signature,
  sha256(p_type || p_name || CASE WHEN p_partkey % 7 = 0 THEN '!' ELSE '' END) AS content_hash, p_size % 2 = 0 AS exported FROM part WHERE p_partkey % 10 <> 1)"""
EDGES_SQL = """
lines AS (SELECT l_orderkey, l_partkey, unnest(min({l_linenumber: l_linenumber, l_returnflag: l_returnflag, l_linestatus: l_linestatus, l_discount: l_discount})) FROM lineitem GROUP BY l_orderkey, l_partkey),
edges AS (SELECT 'order:' || l_orderkey AS from_key, 'part:' || l_partkey AS to_key, CASE WHEN l_returnflag = 'R' THEN 'IMPORTS' ELSE 'CALLS' END AS type,
  round(1 - l_discount, 3) AS confidence, l_orderkey * 10 + l_linenumber AS ord, l_linestatus = 'F' AS type_resolved FROM lines
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CALLS', 1.0, o_orderkey * 10, o_orderstatus <> 'P' FROM orders),
changes AS (SELECT 'part:' || p_partkey AS stable_key, p_brand AS kind, p_name AS qualified_name, p_size % 2 = 0 AS exported FROM part WHERE p_partkey % 50 = 0)"""
PATCHES_SQL = """
raw AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
patches AS (SELECT doc_id, doc_id // 20 AS change_id, source || '/' || doc_id || '.' || lang AS path,
  '@@ -1,' || len(ls) || ' +1,' || len(ls) || ' @@' || chr(10) || array_to_string([CASE (k - 1) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END || ls[k] FOR k IN range(1, len(ls) + 1)], chr(10)) AS patch,
  CAST((len(ls) + 1) // 3 AS BIGINT) AS additions, CAST(len(ls) // 3 AS BIGINT) AS deletions FROM raw),
lines AS (SELECT path, doc_id, source, k AS pos, CASE (k - 1) % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'added' ELSE 'deleted' END AS kind, ls[k] AS content,
  CASE WHEN (k - 1) % 3 = 1 THEN NULL ELSE k - (k + 1) // 3 + CASE WHEN (k - 1) % 3 = 1 THEN 1 ELSE 0 END END AS left_line,
  CASE WHEN (k - 1) % 3 = 2 THEN NULL ELSE k - (k - 1) // 3 END AS right_line
  FROM (SELECT r.*, source || '/' || doc_id || '.' || lang AS path, unnest(range(1, len(ls) + 1)) AS k FROM raw r))"""
