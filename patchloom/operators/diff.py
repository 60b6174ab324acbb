"""Unified diffs as rows: line maps, reversal, and budgets on patch text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import redact

#: Fixed value: the head of a hunk.
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def parse_patch(files: DataFrame, loose: bool = False, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keys``, pos, kind, content, left_line, right_line of every line of each row's ``patch``.

    Lines before the first hunk head don't count. ``+`` (not ``+++``) is added, ``-`` (not ``---``) deleted, a space
    context; other lines are left out and advance nothing, or with ``loose`` are context and advance both sides. Every row is a
    patch of its own, also where rows share their keys or have null ones; a null or empty patch has no lines.
    """
    lines = files.select(*keys, "patch", F.monotonically_increasing_id().alias("__row")).select(*keys, "__row", F.posexplode(F.split("patch", "\n")).alias("pos", "line"))
    head = F.col("line").rlike(HUNK)
    by_file = Window.partitionBy("__row").orderBy("pos")
    lines = lines.withColumn("__hunk", F.sum(head.cast("int")).over(by_file)).filter("__hunk > 0")
    line = F.col("line")
    kind = (
        F.when(head, "head").when(line.startswith("+") & ~line.startswith("+++"), "added").when(line.startswith("-") & ~line.startswith("---"), "deleted").when(line.startswith(" "), "context")
    ).otherwise(F.when(line.startswith("+++") | line.startswith("---"), "name").otherwise("other"))
    lines = lines.withColumn("kind", kind)
    before = Window.partitionBy("__row", "__hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__row", "__hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda group: F.first(F.when(head, F.regexp_extract("line", HUNK, group).cast("int")), ignorenulls=True).over(whole)
    both = ["context", "other"] if loose else ["context"]
    left = start(1) + F.coalesce(F.sum(F.col("kind").isin("deleted", *both).cast("int")).over(before), F.lit(0))
    right = start(2) + F.coalesce(F.sum(F.col("kind").isin("added", *both).cast("int")).over(before), F.lit(0))
    lines = lines.withColumn("left_line", left.cast("int")).withColumn("right_line", right.cast("int")).filter(F.col("kind").isin("added", "deleted", *both))
    return lines.select(*keys, "pos", F.when(F.col("kind") == "other", "context").otherwise(F.col("kind")).alias("kind"), F.substring("line", 2, 1 << 30).alias("content"), F.when(F.col("kind") != "added", F.col("left_line")).alias("left_line"), F.when(F.col("kind") != "deleted", F.col("right_line")).alias("right_line"))


def changed_line_sets(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keys``, side (LEFT, RIGHT), line: numbers of deleted lines on the left and of added lines on the right, by the loose count."""
    lines = parse_patch(files, True, keys)
    return lines.filter("kind = 'deleted'").select(*keys, F.lit("LEFT").alias("side"), F.col("left_line").alias("line")).unionByName(lines.filter("kind = 'added'").select(*keys, F.lit("RIGHT").alias("side"), F.col("right_line").alias("line"))).distinct()


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'added'")


def right_lines(lines: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row for each of (``keys``, right_line): a later line replaces an earlier one."""
    return lines.filter("right_line IS NOT NULL").groupBy(*keys, "right_line").agg(F.max_by(F.struct("kind", "content"), "pos").alias("last")).select(*keys, "right_line", "last.kind", "last.content")


def reversed_patch(patch: Column) -> Column:
    """The patch that undoes a patch: hunk ranges and signs change places."""
    head = r"^@@ -([0-9,]+) \+([0-9,]+) @@"

    def turned(line: Column) -> Column:
        return (
            F.when(line.rlike(head), F.regexp_replace(line, head, r"@@ -$2 +$1 @@"))
            .when(line.startswith("+++") | line.startswith("---"), line)
            .when(line.startswith("+"), F.concat(F.lit("-"), F.substring(line, 2, 1 << 30)))
            .when(line.startswith("-"), F.concat(F.lit("+"), F.substring(line, 2, 1 << 30)))
            .otherwise(line)
        )

    return F.array_join(F.transform(F.split(patch, "\n"), turned), "\n")


def patch_budget(files: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Files of each group in order while characters are left, each with what it may keep of its patch."""
    before = F.coalesce(F.sum(F.length("patch")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("room", F.lit(limit) - before).filter("room > 0")
    return rows.withColumn("kept_chars", F.least(F.length("patch"), F.col("room")).cast("long")).drop("room")


def patch_budget_by_line(files: DataFrame, group: str, order: str, limit: int, most_files: int = 100) -> DataFrame:
    """What each group's files, in order, may show of their patches: whole lines, and only what is kept is charged.

    ``group``, path, omission (file_limit, patch_budget, patch_truncated, patch_unavailable or null), patch_chars,
    kept_chars, patch_hash, kept_hash. Secrets go before anything is cut, so that no cut shows part of one. A fold over the
    first ``most_files`` files, of which no more than ``limit`` characters each are held; hashes of whole patches are taken before.
    """
    clean = files.select(group, order, "path", redact(F.col("patch")).alias("patch"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    sized = clean.withColumn("__n", place).withColumn("chars", F.length("patch").cast("long")).withColumn("hash", F.sha2("patch", 256))
    cut = F.when(F.col("__n") <= most_files, F.substring("patch", 1, limit)).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("__n", "path", "chars", "hash", cut.alias("text"))))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(limit) - acc["used"]
        part = F.substring(x["text"], F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
        whole = x["chars"] <= room
        text = F.when(whole, x["text"]).otherwise(F.regexp_extract(part, r"^([\s\S]*\n)", 1))
        outside = (x["__n"] > most_files) | (room <= 0)
        why = F.when(x["__n"] > most_files, "file_limit").when(room <= 0, "patch_budget").when(~whole, "patch_truncated").when(x["chars"] == 0, "patch_unavailable")
        kept = F.when(outside, F.lit("")).otherwise(text)
        one = F.struct(x["path"].alias("path"), why.alias("omission"), x["chars"].alias("patch_chars"), F.length(kept).cast("long").alias("kept_chars"), x["hash"].alias("patch_hash"), F.when(~outside, F.sha2(kept, 256)).alias("kept_hash"))
        return F.struct((acc["used"] + F.length(kept)).cast("long").alias("used"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<path:string,omission:string,patch_chars:bigint,kept_chars:bigint,patch_hash:string,kept_hash:string>>").alias("out"))
    return sized.groupBy(group).agg(F.aggregate(ordered, empty, step, lambda acc: acc["out"]).alias("out")).select(group, F.explode("out").alias("o")).select(group, "o.*")


def unified_edits(files: DataFrame, edits: DataFrame, most_files: int = 3, most_edits: int = 10, churn: int = 120) -> DataFrame:
    """change_id, path, removed, added, diff: files (change_id, path, content) with edits (change_id, path, start_line, end_line, replacement) as hunks.

    Edits are ranges of lines (from 1, both ends included) and the lines that replace them. A file with overlapping ranges,
    ranges beyond its end, or too many edits, and a change with too many files or lines has ``refused`` instead of a diff.
    """
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    one = edits.withColumn("removed", F.col("end_line") - F.col("start_line") + 1).withColumn("added", F.size("replacement"))
    w = Window.partitionBy("change_id", "path").orderBy("start_line")
    one = one.withColumn("previous", F.coalesce(F.lag("end_line").over(w), F.lit(0))).withColumn("shift", F.coalesce(F.sum(F.col("added") - F.col("removed")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = one.join(files.select("change_id", "path", lines.alias("lines")), ["change_id", "path"])
    wrong = (F.col("start_line") <= F.col("previous")) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.size("lines"))
    head = F.concat(F.lit("@@ -"), F.col("start_line").cast("string"), F.lit(","), F.col("removed").cast("string"), F.lit(" +"), (F.col("start_line") + F.col("shift")).cast("string"), F.lit(","), F.col("added").cast("string"), F.lit(" @@"))
    signed = lambda c, sign: F.transform(c, lambda x: F.concat(F.lit(sign), x))
    old = F.slice("lines", F.greatest("start_line", F.lit(1)), F.greatest("removed", F.lit(0)))
    hunk = F.array_join(F.concat(F.array(head), signed(old, "-"), signed(F.col("replacement"), "+")), "\n")
    rows = both.withColumn("wrong", wrong).withColumn("hunk", F.when(~wrong, hunk))
    out = rows.groupBy("change_id", "path").agg(F.max("wrong").alias("wrong"), F.count("*").alias("edits"), F.sum("removed").alias("removed"), F.sum("added").alias("added"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "hunk"))), lambda x: x["hunk"]), "\n").alias("hunks"))
    total = out.groupBy("change_id").agg(F.count("*").alias("n_files"), F.sum(F.col("removed") + F.col("added")).alias("churn"))
    out = out.join(total, "change_id")
    refused = F.when(F.col("n_files") > most_files, "file_budget").when(F.col("edits") > most_edits, "edit_limit").when(F.col("wrong"), "invalid_range").when(F.col("churn") > churn, "line_budget")
    diff = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), "hunks")
    return out.withColumn("refused", refused).select("change_id", "path", F.col("removed").cast("long").alias("removed"), F.col("added").cast("long").alias("added"), "refused", F.when(F.col("refused").isNull(), diff).alias("diff"))


def change_totals(files: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Added and deleted lines of the first ``limit`` files of a group, and whether there are more."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = files.withColumn("n", n)
    use = F.col("n") <= limit
    return rows.groupBy(group).agg(F.sum(F.when(use, F.col("additions")).otherwise(0)).cast("long").alias("additions"), F.sum(F.when(use, F.col("deletions")).otherwise(0)).cast("long").alias("deletions"), (F.count("*") > limit).alias("truncated"))
