"""The job queue, publication journal and intake as replays of event logs, and the joins that recovery reads.

A replay folds the events of one key in their order, one state at a time. Time is
a column of the events or a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators import folds
from patchloom.operators.folds import LEASE_SECONDS, MOST_ATTEMPTS

#: Actions of a pull request that ask for a review.
REVIEW_ACTIONS = ("opened", "reopened", "synchronize", "ready_for_review")


def claimable(jobs: DataFrame, now: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Jobs that may be claimed: queued or to be tried again, due, and not tried too often."""
    return jobs.filter(F.col("status").isin("queued", "retry") & (F.col("available_at") <= now) & (F.col("attempts") < most))


def claim(jobs: DataFrame, now: Column, n: int = 1, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The ``n`` oldest claimable jobs as they are after the claim: processing, a generation further, leased from ``now`` on."""
    first = claimable(jobs, now, most).orderBy("created_at", "id").limit(n)
    return first.withColumn("status", F.lit("processing")).withColumn("lease_generation", F.col("lease_generation") + 1).withColumn("lease_expires_at", now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS)))


def fenced(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """``events`` (id, run_id, generation, ts, ...) with ``valid``: the job is in work for this run and generation, and its lease isn't over."""
    held = jobs.select("id", F.col("review_run_id").alias("__run"), F.col("lease_generation").alias("__generation"), F.col("status").alias("__status"), F.col("lease_expires_at").alias("__until"))
    ok = (F.col("run_id") == F.col("__run")) & (F.col("generation") == F.col("__generation")) & (F.col("__status") == "processing") & (F.col("__until") > F.col("ts"))
    return events.join(held, "id", "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__run", "__generation", "__status", "__until")


def replay_leases(events: DataFrame) -> DataFrame:
    """id, seq, kind, ok, status, attempts, generation after each event of a job: claim, renew, complete or expire, at ``ts`` seconds.

    A claim needs a queued or retried job with attempts left, and takes the next generation. Renewals and completions carry
    the generation they hold, and need it to be the current one, in work and not over. ``expire`` is a look at the lease: if it is
    over, an attempt is counted, and the job fails with the third. ``events`` (id, seq, kind, generation, ts).
    """
    found = folds.in_order(events, ["id"], ["seq"], folds.Leases(timed=False, lease_ms=LEASE_SECONDS), "ts")
    return found.withColumn("seq", F.col("seq").cast(events.schema["seq"].dataType))


def run_times(events: DataFrame, order: list[str]) -> DataFrame:
    """id, status, started_at, completed_at of runs from their status events: the first start stays, the last end counts."""
    ended = F.col("status").isin("completed", "failed", "stale", "skipped")
    last = F.max_by("status", F.struct(*order)).alias("status")
    return events.groupBy("id").agg(last, F.min(F.when(F.col("status") == "in_progress", F.col("ts"))).alias("started_at"), F.max_by(F.when(ended, F.col("ts")), F.when(ended, F.struct(*order))).alias("completed_at"))


def replay_journal(events: DataFrame) -> DataFrame:
    """run_id, operation, seq, kind, ok, state, remote_id after each event of a publication: ``sent`` (with its hash) or ``confirmed``.

    The intent is written once; a confirmation needs its hash, and the first remote id stays. ``events`` (run_id,
    operation, seq, kind, hash, remote_id).
    """
    found = folds.in_order(events, ["run_id", "operation"], ["seq"], folds.Journal())
    return found.withColumn("seq", F.col("seq").cast(events.schema["seq"].dataType))


def slot_claims(claims: DataFrame, runs: DataFrame, slots: DataFrame) -> DataFrame:
    """``claims`` (run_id) with ``acquired``: the run is its pull's latest, by (created_at, id), and nobody else holds the pull's slot."""
    latest = runs.withColumn("__n", F.row_number().over(Window.partitionBy("repository_id", "pull_number").orderBy(F.col("created_at").desc(), F.col("id").desc())))
    one = claims.join(latest.select(F.col("id").alias("run_id"), "repository_id", "pull_number", "__n"), "run_id", "left")
    owned = one.join(slots.select("repository_id", "pull_number", "active_run_id"), ["repository_id", "pull_number"], "left")
    free = F.col("active_run_id").isNull() | (F.col("active_run_id") == F.col("run_id"))
    return owned.select("run_id", F.coalesce((F.col("__n") == 1) & free, F.lit(False)).alias("acquired"))


def routed(events: DataFrame, check_name: str, command: str, app_id: str = "") -> DataFrame:
    """``events`` with ``route``, and for comments ``fingerprint`` and ``verdict``.

    ``events`` (event, action, installation_id, repository_id, pull_number, owner, repo, base_sha, head_sha, check_name,
    check_app_id, check_head_sha, has_pull, body). A pull request's known actions are queued if all of its identity is there; a check
    asked for again is queued if it is ours and about the head; a comment on a pull counts if it is ``command`` with a
    fingerprint and a verdict.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) >= 1
    whole = number("installation_id") & number("repository_id") & number("pull_number") & text("owner") & text("repo") & text("base_sha") & text("head_sha")
    pull = F.when(~F.coalesce(F.col("action").isin(*REVIEW_ACTIONS), F.lit(False)), "ignored_action").when(~whole, "ignored").otherwise("queued")
    ours = F.col("action").eqNullSafe("rerequested") & F.col("check_name").eqNullSafe(check_name) & F.coalesce("has_pull", F.lit(False))
    foreign = F.lit(app_id != "") & (F.coalesce("check_app_id", F.lit(0)) > 0) & (F.coalesce("check_app_id", F.lit(0)).cast("string") != app_id)
    check = F.when(~ours, "ignored").when(foreign, "ignored_foreign_check").when(~F.col("head_sha").eqNullSafe(F.col("check_head_sha")), "ignored_stale_check").otherwise("rerun_queued")
    pattern = rf"(?i)^{command}\s+feedback\s+([a-f0-9]{{12,64}})\s+(helpful|false-positive)$"
    body = F.trim(F.coalesce("body", F.lit("")))
    said = F.col("action").eqNullSafe("created") & F.coalesce("has_pull", F.lit(False)) & body.rlike(pattern)
    route = F.when(F.col("event") == "pull_request", pull).when(F.col("event") == "check_run", check).when(F.col("event") == "issue_comment", F.when(said, "feedback").otherwise("ignored_comment")).otherwise("ignored")
    feedback = F.col("route") == "feedback"
    out = events.withColumn("route", route)
    return out.withColumn("fingerprint", F.when(feedback, F.lower(F.regexp_extract(body, pattern, 1)))).withColumn("verdict", F.when(feedback, F.replace(F.lower(F.regexp_extract(body, pattern, 2)), F.lit("-"), F.lit("_"))))


def created_runs(requests: DataFrame, order: list[str]) -> DataFrame:
    """Requests for runs with ``created``: the first of the seven columns that identify a run; ``run_order`` is the first one's number."""
    identity = ["repository_id", "pull_number", "base_sha", "head_sha", "config_hash", "pipeline_version", "request_key"]
    w = Window.partitionBy(*identity).orderBy(*order)
    return requests.withColumn("created", F.row_number().over(w) == 1).withColumn("run_order", F.first(order[0]).over(w))


def http_retry_delay(attempt: Column, hint_ms: Column, jitter: Column, base_ms: int = 250, most_ms: int = 10_000) -> Column:
    """Milliseconds before the next attempt: the larger of the server's hint and base * 2 ** (attempt - 1), times the jitter (0.8 to 1.2), at most ``most_ms``."""
    wanted = F.greatest(F.coalesce(hint_ms.cast("double"), F.lit(0.0)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt - 1)) * jitter
    return F.floor(F.least(F.lit(float(most_ms)), wanted) + 0.5).cast("long")


def budget_state(plans: DataFrame, calls: DataFrame, max_calls: int, max_bytes: int) -> DataFrame:
    """run_id, calls, bytes, pending, unplanned, changed: what a run has spent, and what stands in the way of more.

    ``plans`` (call_id, run_id, request_bytes, max_calls, max_input_bytes), ``calls`` (id, run_id, status).
    """
    of = plans.join(calls.select(F.col("id").alias("call_id"), F.col("status").alias("__status")), "call_id", "left")
    pending = F.col("__status").isNull() | (F.col("__status") == "reserved")
    spent = of.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("request_bytes").cast("long").alias("bytes"), F.count_if(pending).alias("pending"), F.count_if((F.col("max_calls") != max_calls) | (F.col("max_input_bytes") != max_bytes)).alias("changed"))
    bare = calls.join(plans.select(F.col("call_id").alias("id")), "id", "left_anti").groupBy("run_id").agg(F.count("*").alias("unplanned"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return spent.join(bare, "run_id", "full_outer").select("run_id", *[zero(c) for c in ("calls", "bytes", "pending", "unplanned", "changed")])


def admit_reserved(requests: DataFrame, plans: DataFrame, calls: DataFrame, max_calls: int, max_bytes: int) -> DataFrame:
    """``requests`` (run_id, input_bytes) with ``refused``: the reasons against one more call of the run, joined; empty if it may be made."""
    state = requests.join(budget_state(plans, calls, max_calls, max_bytes), "run_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = [("unplanned", n("unplanned") != 0), ("changed", n("changed") != 0), ("pending", n("pending") != 0), ("calls", n("calls") >= max_calls), ("bytes", n("bytes") + F.col("input_bytes") > max_bytes)]
    return state.select(*requests.columns, F.array_join(F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull()), ",").alias("refused"))


def recovery_bindings(runs: DataFrame, jobs: DataFrame, outputs: DataFrame, effects: DataFrame, slots: DataFrame, publications: DataFrame) -> DataFrame:
    """run_id and the three journal hashes of failed, uncertain runs whose job, frozen output, journal and slot belong together.

    The journal is read once, by operation; a confirmed start binds the remote id that the other effects, if known, share.
    """
    each = effects.groupBy("review_run_id").agg(*[F.max(F.when(F.col("operation") == name, F.struct("request_hash", "state", "remote_id"))).alias(short) for name, short in (("check_start", "a"), ("check_result", "b"), ("summary_comment", "c"))])
    rows = runs.filter("status = 'failed' AND error_code = 'PUBLICATION_UNCERTAIN'").select(F.col("id").alias("review_run_id"), "repository_id", "pull_number", "head_sha")
    rows = rows.join(jobs.filter("status = 'failed' AND locked_at IS NULL AND lease_expires_at IS NULL").select("review_run_id", "installation_id"), "review_run_id")
    rows = rows.join(outputs.filter("schema_version = 1").select("review_run_id", "installation_id", "payload_hash"), ["review_run_id", "installation_id"])
    rows = rows.join(each, "review_run_id").filter("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND a.state = 'confirmed' AND a.remote_id IS NOT NULL AND (b.remote_id IS NULL OR b.remote_id = a.remote_id)")
    rows = rows.join(slots.select(F.col("active_run_id").alias("review_run_id"), "repository_id", "pull_number", "installation_id"), ["review_run_id", "repository_id", "pull_number", "installation_id"])
    rows = rows.join(publications.select("review_run_id", F.col("head_sha").alias("__head")), "review_run_id", "left").filter("__head IS NULL OR __head = head_sha")
    return rows.select("review_run_id", "payload_hash", F.col("a.request_hash").alias("start_hash"), F.col("b.request_hash").alias("result_hash"), F.col("c.request_hash").alias("summary_hash"))


def preview_contexts(runs: DataFrame, repositories: DataFrame, installations: DataFrame, analyses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """run_id, base_sha, head_sha, snapshot_id of completed runs, the latest of their pull, whose repository is selected, its installation active, and both snapshots ready."""
    newest = runs.withColumn("__n", F.row_number().over(Window.partitionBy("repository_id", "pull_number").orderBy(F.col("created_at").desc(), F.col("id").desc()))).filter("__n = 1 AND status = 'completed'")
    rows = newest.select(F.col("id").alias("run_id"), "repository_id", "base_sha", "head_sha")
    rows = rows.join(repositories.filter("selected").select(F.col("id").alias("repository_id"), "installation_id"), "repository_id").join(installations.filter("active").select(F.col("id").alias("installation_id")), "installation_id", "left_semi")
    rows = rows.join(analyses.select(F.col("review_run_id").alias("run_id"), "base_snapshot_id", "head_snapshot_id"), "run_id")
    ready = snapshots.filter("status = 'ready'")
    for side in ("base", "head"):
        rows = rows.join(ready.select(F.col("id").alias(f"{side}_snapshot_id"), "repository_id"), [f"{side}_snapshot_id", "repository_id"], "left_semi")
    return rows.select("run_id", "base_sha", "head_sha", F.col("head_snapshot_id").alias("snapshot_id"))


def recovery_outcomes(attempts: DataFrame, audit: DataFrame, complete: DataFrame) -> DataFrame:
    """attempt_id, outcome of each attempt asked about: NOT_FOUND, PENDING, DENIED, COMMITTED_MATCH or COMMITTED_CHANGED.

    A request and its end share attempt, run, actor and evidence; ``complete`` (run_id) are runs whose local records are whole.
    """
    key = ["attempt_id", "run_id", "actor_hash", "evidence_hash"]
    ended = audit.filter("stage IN ('denied', 'committed')").select(*key, F.col("stage").alias("__end"))
    rows = audit.filter("stage = 'requested'").select(*key).join(ended, key, "left").join(complete.select("run_id", F.lit(True).alias("__whole")).distinct(), "run_id", "left")
    outcome = F.when(F.col("__end").isNull(), "PENDING").when(F.col("__end") == "denied", "DENIED").when(F.col("__whole").isNotNull(), "COMMITTED_MATCH").otherwise("COMMITTED_CHANGED")
    found = rows.select("attempt_id", "actor_hash", outcome.alias("outcome"))
    return attempts.join(found, ["attempt_id", "actor_hash"], "left").select("attempt_id", F.coalesce("outcome", F.lit("NOT_FOUND")).alias("outcome"))
