"""Operational state from event logs: deduplication, rate limits, leases, budgets, retention, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators import folds
from patchloom.operators.folds import TERMINAL


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).filter("_n = 1").drop("_n")


def distinct_edges(edges: DataFrame, order: list[str], typed: bool = True, last: bool = False) -> DataFrame:
    """Edges once by source, target and place: with their type and line, or, not ``typed``, with path and line; the first counts, or the ``last``."""
    key = ["from_key", "to_key", "type", "source_line"] if typed else ["from_key", "to_key", "source_path", "source_line"]
    return (last_of_key if last else first_of_key)(edges, key, order)


def replace_children(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows of any key that ``new`` has, and all rows of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def status_counts(runs: DataFrame, status: str, ts: str, cutoff: Column) -> DataFrame:
    """Runs by status from ``cutoff`` on."""
    return runs.filter(F.col(ts) >= cutoff).groupBy(status).agg(F.count("*").alias("n"))


def deletion_receipts(deleted: DataFrame, repository: str, counts: list[str]) -> DataFrame:
    """What was deleted of each repository, under a hash that doesn't name it: receipt, ``counts``."""
    return deleted.select(F.sha2(F.concat(F.col(repository).cast("string"), F.lit(":receipt")), 256).alias("receipt"), *counts)


def deliveries(rows: DataFrame, key: str, payload: list[str], order: list[str]) -> DataFrame:
    """Each delivery's outcome: the first of its key is accepted; later ones are duplicates, or conflicts if they differ."""
    w = Window.partitionBy(key).orderBy(*order)
    hashed = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload]), 256)
    rows = rows.withColumn("_h", hashed).withColumn("_n", F.row_number().over(w)).withColumn("_f", F.first("_h").over(w))
    return rows.withColumn("outcome", F.when(F.col("_n") == 1, "accepted").when(F.col("_h") == F.col("_f"), "duplicate").otherwise("conflict")).drop("_h", "_n", "_f")


def rate_limited(rows: DataFrame, client: str, ts: str, order: list[str], limit: int, seconds: int = 60) -> DataFrame:
    """Requests with the fixed window they fall in, and whether they are among its first ``limit``."""
    rows = rows.withColumn("window_start", F.floor(F.unix_timestamp(ts) / seconds) * seconds)
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(client, "window_start").orderBy(*order)) <= limit)


def expire_leases(jobs: DataFrame, now: Column, most: int = 3, batch: int | None = None, key: str = "id") -> DataFrame:
    """Jobs in work whose lease is over: one attempt more, then failed at ``most`` attempts, else to be tried again.

    With ``batch`` the first so many by (lease_expires_at, ``key``), which is what one round takes.
    """
    rows = jobs.filter((F.col("status") == "processing") & (F.col("lease_expires_at") <= now)).withColumn("attempts", F.col("attempts") + 1)
    if batch:
        rows = rows.orderBy("lease_expires_at", key).limit(batch)
    return rows.withColumn("status", F.when(F.col("attempts") >= most, "failed").otherwise("retry"))


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next attempt: 2 * 2 ** attempts."""
    return (F.lit(2) * F.pow(F.lit(2.0), attempts)).cast("long")


def admit_by_budget(calls: DataFrame, group: str, order: str, size: str, most_calls: int, most_size: int) -> DataFrame:
    """Calls of a group in order, admitted while number and total size stay in the budget; refused calls charge nothing.

    A fold over a group's calls in the order of ``order``, with one state at a time.
    """
    rows = calls.select(F.col(group).alias("__group"), F.col(order).alias("seq"), F.col(size).alias("size"))
    found = folds.in_order(rows, ["__group"], ["seq"], folds.Budget(most_calls, most_size))
    return found.select(F.col("__group").alias(group), F.col("seq").cast(calls.schema[order].dataType).alias(order), F.col("size").alias(size), "admitted")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).filter("_n = 1").drop("_n")


def superseded(rows: DataFrame, key: list[str], order: list[str], done: str) -> DataFrame:
    """Rows with ``stale``: a newer row of the key began before this one was done."""
    following = F.lead(F.col(order[0])).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("stale", F.coalesce(following < F.col(done), F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``; a null in ``new`` leaves the old value. One row a key on either side."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in rest])
    b = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return a.join(b, key, "full_outer").select(*key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest])


def retained(rows: DataFrame, ts: str, now: Column, days: int, status: str | None = None) -> DataFrame:
    """Rows that are ``days`` old at most; with ``status`` only those in a terminal state can be too old. A null time is never too old."""
    if not isinstance(days, int) or days < 1:
        raise ValueError("days must be a positive whole number")
    old = F.coalesce(F.col(ts) < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return rows.filter(~(old & F.coalesce(F.col(status).isin(*TERMINAL), F.lit(False)) if status else old))


def feedback_matches(feedback: DataFrame, findings: DataFrame, place: list[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Each comment's newest verified finding of its ``place`` (repository, pull) whose fingerprint begins as the comment says.

    Prefixes are 12 characters and more. Findings without a ``status`` column count as verified. Comments of ``seen``
    (comment_id) have been taken before and give nothing.
    """
    short = lambda c: F.substring(c, 1, 12)
    if "status" in findings.columns:
        findings = findings.filter("status = 'verified'")
    if seen is not None:
        feedback = feedback.join(seen.select("comment_id"), "comment_id", "left_anti")
    rows = feedback.withColumn("p", short("prefix")).join(findings.withColumn("p", short("fingerprint")), ["p", *(place or [])]).filter(F.col("fingerprint").startswith(F.col("prefix")))
    return latest(rows, ["comment_id"], ["created_at", "fingerprint"]).select("comment_id", "fingerprint")
