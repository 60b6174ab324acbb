"""Evidence checks on rule candidates, publication, and the roll-up of risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import is_safe_path, severity_rank

#: Confidence that a finding needs to be published, by severity.
STRICT = {"critical": 0.85, "high": 0.85, "medium": 0.80, "low": 1.01}
PLAIN = {"critical": 0.90, "high": 0.85, "medium": 0.80, "low": 0.80}


def threshold(severity: Column, table: dict[str, float]) -> Column:
    out = F.lit(1.01)
    for name, value in table.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def fingerprint(path: Column, line: Column, category: Column, identity: Column) -> Column:
    """One hash for one place, category and rule (or title in lower case with dashes)."""
    return F.sha2(F.concat_ws(":", path, line.cast("string"), category, identity), 256)


def fingerprint_plain(rule_id: Column, path: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws("\n", rule_id, path, line.cast("string")), 256)


def verify(candidates: DataFrame, right: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """Adds fingerprint, status and the first reason that rejects: duplicate, unsafe path, line not in the diff, line not
    added, another excerpt, too little confidence.

    ``candidates`` have ordinal, rule_id, category, severity, confidence, path, line, excerpt; ``right`` is what
    ``diff.right_lines`` gives. A later candidate with a fingerprint is a duplicate even if the first was rejected.
    """
    rows = candidates.withColumn("fingerprint", fingerprint(F.col("path"), F.col("line"), F.col("category"), F.col("rule_id")))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("fingerprint").orderBy("ordinal")) > 1)
    lines = right.select("path", F.col("right_line").alias("line"), F.col("kind").alias("line_kind"), F.col("content").alias("line_content"))
    rows = rows.join(lines, ["path", "line"], "left")
    reason = (
        F.when(F.col("again"), "duplicate")
        .when(~is_safe_path(F.col("path")), "unsafe_path")
        .when(F.col("line_kind").isNull(), "line_not_in_diff")
        .when(F.col("line_kind") != "added", "evidence_not_added_line")
        .when(F.trim("line_content") != F.trim("excerpt"), "excerpt_mismatch")
        .when(F.col("confidence") < threshold(F.col("severity"), table or STRICT), "below_publish_threshold")
    )
    rows = rows.withColumn("rejection_reason", reason)
    return rows.withColumn("status", F.when(F.col("rejection_reason").isNull(), "verified").otherwise("rejected")).drop("again", "line_kind", "line_content")


def publish_strict(verified: DataFrame, group: str, cap: int) -> DataFrame:
    """Verified findings of each group by severity and confidence; beyond ``cap`` they stay verified, but unpublished, with the reason publication_limit."""
    order = Window.partitionBy(group).orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), "ordinal")
    return verified.filter("status = 'verified'").withColumn("publishable", F.row_number().over(order) <= cap).withColumn("rejection_reason", F.when(~F.col("publishable"), "publication_limit"))


def publish_plain(candidates: DataFrame, group: str, cap: int, table: dict[str, float] | None = None) -> DataFrame:
    """One finding for each fingerprint, by severity; published if among the first ``cap`` and confident enough."""
    rows = candidates.withColumn("fingerprint", fingerprint_plain(F.col("rule_id"), F.col("path"), F.col("line"))).withColumn("rank", severity_rank(F.col("severity")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(group, "fingerprint").orderBy(F.col("rank").desc(), "ordinal"))).filter("n = 1")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("rank").desc(), "ordinal"))
    out = first.withColumn("publishable", (place <= cap) & (F.col("confidence") >= threshold(F.col("severity"), table or PLAIN)))
    return out.withColumn("status", F.when(F.col("publishable"), "verified").otherwise("rejected")).drop("n", "rank")


def risk_rollup(findings: DataFrame, group: str) -> DataFrame:
    """Counts of a group, its risk by published findings, and the conclusion drawn from it."""
    published = F.col("status").eqNullSafe("verified")
    top = F.max(F.when(published, severity_rank(F.col("severity"))).otherwise(0))
    risk = F.when(top >= 3, "high").when(top == 2, "medium").otherwise("low")
    out = findings.groupBy(group).agg(F.count("*").alias("candidates"), F.count_if(published).alias("verified"), F.count_if(~published).alias("rejected"), risk.alias("risk"))
    return out.withColumn("conclusion", F.when(F.col("risk") == "high", "neutral").otherwise("success"))
