"""Review relations: truth sets, decision gates, quotas and queues, manifests, change groups, policy text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import is_safe_path, language_of_path
from patchloom.operators.components import components
from patchloom.operators.evaluation import SHARES, two_sets
from patchloom.operators.ranks import numbered


def truth_set(expected: DataFrame, actual: DataFrame, key: list[str], by: str) -> DataFrame:
    """By repository and pooled (``by`` null): true and false positives, false negatives, precision (0 without any)."""
    both = two_sets(actual, expected, [by, *key], "a", "e")
    counts = [F.count_if(F.col("a") & F.col("e")).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn")]
    rows = both.groupBy(by).agg(*counts)
    pooled = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit(None).cast(rows.schema[by].dataType).alias(by), "tp", "fp", "fn")
    precision = F.coalesce(F.round(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), 4), F.lit(0.0))
    return rows.unionByName(pooled).withColumn("precision", precision)


#: How many files and bytes of a file an index takes.
INDEX_FILES, INDEX_FILE_BYTES = 100, 500_000


def index_status(files: DataFrame, group: str, order: str, most_files: int = INDEX_FILES, most_bytes: int = INDEX_FILE_BYTES) -> DataFrame:
    """``group``, path, status, reason of files that an index is asked for, the first reason that fits.

    skipped: unsafe_path, unsupported (no language), budget (beyond the first ``most_files`` supported ones), too_large; absent:
    not_found (no content at that revision); failed: parse_error; else indexed. ``files`` (``group``, path, content, parse_error).
    """
    safe, known = is_safe_path(F.col("path")), language_of_path(F.col("path")).isNotNull()
    rows = files.withColumn("__use", safe & known)
    place = F.row_number().over(Window.partitionBy(group, "__use").orderBy(order))
    reason = (
        F.when(~safe, "unsafe_path").when(~known, "unsupported").when(place > most_files, "budget").when(F.col("content").isNull(), "not_found")
        .when(F.octet_length("content") > most_bytes, "too_large").when(F.coalesce("parse_error", F.lit(False)), "parse_error")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "indexed").when(F.col("reason") == "not_found", "absent").when(F.col("reason") == "parse_error", "failed").otherwise("skipped")
    return rows.select(group, "path", status.alias("status"), "reason")


def coverage_level(files: DataFrame, by: str, degraded: DataFrame | None = None) -> DataFrame:
    """Counts by status and the level: FAILED without an indexed file, PARTIAL with any failed or skipped or a ``degraded`` build (``by``), else SEMANTIC."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = files.groupBy(by).agg(F.count("*").alias("total"), n("indexed"), n("skipped"), n("absent"), n("failed"))
    worse = (F.col("failed") > 0) | (F.col("skipped") > 0)
    if degraded is not None:
        out = out.join(degraded.select(by, F.lit(True).alias("__degraded")).distinct(), by, "left")
        worse = worse | F.col("__degraded").isNotNull()
    out = out.withColumn("level", F.when(F.col("indexed") == 0, "FAILED").when(worse, "PARTIAL").otherwise("SEMANTIC"))
    return out.drop("__degraded")


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Names of the conditions that don't hold, joined by commas; empty if all do."""
    return F.array_join(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull()), ",")


def decision_history(events: DataFrame, key: str, order: str) -> DataFrame:
    """Decisions with their revision, counted from 1, and whether a later one replaced them."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("revision", F.row_number().over(w)).withColumn("superseded", F.lead(order).over(w).isNotNull())


def quota_sample(rows: DataFrame, stratum: str, order: str, target: int) -> DataFrame:
    """``target`` rows from strata in order, each with its share rounded up; what one can't fill passes to the next.

    The fold is over strata and their sizes, not rows. Of each stratum a task sends on its first ``target`` rows at most.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    strata = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(stratum).alias("s"), F.col("size")))).alias("all"))
    kind = rows.schema[stratum].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        room = F.least(acc["quota"] + acc["carried"], F.lit(target) - acc["taken"])
        take = F.least(room, x["size"])
        one = F.array(F.struct(x["s"].alias("s"), take.cast("long").alias("take")))
        return F.struct(acc["quota"].alias("quota"), (acc["quota"] + acc["carried"] - take).cast("long").alias("carried"), (acc["taken"] + take).cast("long").alias("taken"), F.concat(acc["out"], one).alias("out"))

    quota = F.ceil(F.lit(target) / F.greatest(F.size("all"), F.lit(1))).cast("long")
    empty = F.struct(quota.alias("quota"), F.lit(0).cast("long").alias("carried"), F.lit(0).cast("long").alias("taken"), F.array().cast(f"array<struct<s:{kind},take:bigint>>").alias("out"))
    takes = strata.select(F.explode(F.aggregate("all", empty, step, lambda acc: acc["out"])).alias("o")).select(F.col("o.s").alias(stratum), "o.take")
    first = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    placed = rows.withColumn("__place", first).filter(F.col("__place") <= target).join(F.broadcast(takes), stratum)
    return placed.filter(F.col("__place") <= F.col("take")).drop("__place", "take")


def interleaved(rows: DataFrame, positive: str, order: str) -> DataFrame:
    """Rows with ``place``: one positive, then as many others as there are for each; what is left comes last.

    """
    n = numbered(rows, [positive], [order], "__k")
    totals = rows.agg(F.count_if(positive).alias("__p"), F.count_if(~F.col(positive)).alias("__n"))
    share = F.greatest(F.lit(1), F.floor(F.try_divide(F.col("__n").cast("double"), F.col("__p").cast("double"))))
    n = n.withColumn("__one", F.lit(1)).join(F.broadcast(totals.select(F.lit(1).alias("__one"), "__p", share.alias("__each"))), "__one")
    k, each, p = F.col("__k"), F.col("__each"), F.col("__p")
    place = F.when(F.col(positive), k * (each + 1)).otherwise(F.when(F.floor(k / each) < p, F.floor(k / each) * (each + 1) + 1 + k % each).otherwise(k + p))
    return n.withColumn("place", place.cast("long")).drop("__k", "__one", "__p", "__each")


def manifest_check(applied: DataFrame, expected: DataFrame) -> DataFrame:
    """name and what is wrong with it: unknown, missing or mismatch."""
    both = applied.select("name", F.col("checksum").alias("a")).join(expected.select("name", F.col("checksum").alias("e")), "name", "full_outer")
    return both.withColumn("problem", F.when(F.col("e").isNull(), "unknown").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("e"), "mismatch")).filter("problem IS NOT NULL").select("name", "problem")


def change_groups(files: DataFrame, ties: DataFrame) -> DataFrame:
    """path, group of changed files: connected by ties (a, b) between changed files, named by the smallest path; a file without ties is its own."""
    known = files.filter("path IS NOT NULL").select("path").distinct()
    near = ties.join(known.withColumnRenamed("path", "a"), "a", "left_semi").join(known.withColumnRenamed("path", "b"), "b", "left_semi")
    found = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return known.join(found.withColumnRenamed("node", "path"), "path", "left").select("path", F.coalesce("component", "path").alias("group"))


def tied_groups(files: DataFrame, members: DataFrame, tie: str, by: str) -> DataFrame:
    """``change_groups`` where changed files with the same ``tie`` belong together: each tie's files are tied to its smallest one.

    ``files`` (path, ``by``) and ``members`` (``tie``, ``by``) name a file by ``by``, which may be shorter than its path; groups are named
    by their smallest path. Members are dealt twice, by ``by`` and by ``tie``, the latter in tasks whose number grows with the scan's.
    """
    known = files.filter(F.col("path").isNotNull() & F.col(by).isNotNull()).select("path", by).distinct()
    near = members.filter(F.col(tie).isNotNull()).join(known.select(by).hint("shuffle_hash"), by, "left_semi")
    near = near.select(tie, by).repartition(SHARES * max(1, members.rdd.getNumPartitions()), tie)
    first = near.groupBy(tie).agg(F.min(by).alias("v"))
    found = components(near.join(first.hint("shuffle_hash"), tie).select(F.col(by).alias("u"), "v"))
    of = known.join(found.withColumnRenamed("node", by), by, "left")
    names = of.filter("component IS NOT NULL").groupBy("component").agg(F.min("path").alias("group"))
    return of.join(names, "component", "left").select("path", F.coalesce("group", "path").alias("group"))


def markdown_rules(texts: DataFrame, most: int = 100, size: int = 20_000, quoted: bool = False) -> DataFrame:
    """Bullets of each document's first ``size`` characters as rules, ``most`` at most: source, ordinal, rule_key, rule.

    The key is a hash of the rule, or, ``quoted``, of the rule as a JSON string.
    """
    lines = texts.select("source", F.posexplode(F.split(F.substring("text", 1, size), "\n")).alias("pos", "line"))
    rules = lines.select("source", "pos", F.trim(F.regexp_extract("line", r"^\s*[-*]\s+(.+)$", 1)).alias("rule")).filter("rule <> ''")
    rules = rules.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).filter(F.col("ordinal") <= most)
    return rules.select("source", "ordinal", F.concat(F.lit("md-"), F.substring(F.sha2(F.regexp_replace(F.to_json(F.struct("rule")), r"^\{\"rule\":(.*)\}$", "$1") if quoted else F.col("rule"), 256), 1, 12)).alias("rule_key"), "rule")


def unreferenced(snapshots: DataFrame, analyses: DataFrame) -> DataFrame:
    """Snapshots that no analysis names as base or head."""
    return snapshots.join(analyses.select(F.col("base_id").alias("id")), "id", "left_anti").join(analyses.select(F.col("head_id").alias("id")), "id", "left_anti")


def audit_outcome(requested: DataFrame, ended: DataFrame, key: list[str]) -> DataFrame:
    """Each request with what became of it: PENDING, or how it ended."""
    return requested.join(ended.select(*key, "stage"), key, "left").withColumn("outcome", F.coalesce(F.upper("stage"), F.lit("PENDING"))).drop("stage")
