"""Review evidence: cases and their gates, packets, briefs, reuse decisions, and what may be released or exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import ascii_bounds, evidence_id, is_clean, is_safe_path, redact
from patchloom.operators.diff import HUNK, changed_line_sets, reversed_patch
from patchloom.operators.evaluation import SHARES, share
from patchloom.operators.intervals import holding, runs

#: What titles, labels and paths say of a fix, and which lines say nothing.
FIX_TITLE = r"(?i)\b(fix(?:es|ed)?|bug|panic|race|deadlock|leak|security|vulnerab\w*|timeout|crash|nil pointer|incorrect|corrupt\w*|data loss|hang|regression)\b"
FIX_LABEL = r"(?i)\b(bug|security|vulnerability|regression|kind/bug|type/bug)\b"
LOW_VALUE_TITLE = r"(?i)\b(docs?|documentation|typos?|comments?|readme|release|chore|lint|format(?:ting)?)\b"
UNREVIEWED_PATH = r"(?i)(?:^|/)(?:vendor|fixtures?|generated|third_party)(?:/|$)"
BUILT_PATH = r"(?i)(?:^|/)(?:dist|vendor|fixtures?|generated|third_party)(?:/|$)"
GO_TEST_PATH = r"(?i)(?:^|/)(?:test|tests)(?:/|$)|_test\.go$"
MOST_FILES, MOST_PATCH_CHARS = 25, 120_000
#: The least a phase of evidence and a truth set need; limits of a change budget and of a brief.
PHASE_CASES, PHASE_CAUSES, PHASE_SESSIONS = 50, 20, 20
LEAST_REPOSITORIES, LEAST_PRECISION = 2, 0.90
BUDGET_FILES, BUDGET_SYMBOLS = 50, 200
BRIEF_EVIDENCE, BRIEF_NAMES, BRIEF_QUESTIONS = 100, 500, 5
STRATEGIES = ("reuse", "extend", "extract", "new")


def _named(checks: list[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, joined by commas; a null condition doesn't hold."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull()), ",")


def approved_cases(cases: DataFrame) -> DataFrame:
    """Cases that a person has approved and that come from a merged change."""
    return cases.filter((F.col("approval_status") == "approved") & (F.col("provenance_kind") == "historical_pr"))


def truth_gate(evaluations: DataFrame, repositories: int = LEAST_REPOSITORIES, precision: float = LEAST_PRECISION) -> DataFrame:
    """One row: repositories (whatever their case), pooled counts, precision and recall, and the failures joined by commas.

    ``evaluations`` (repository, expected, actual, correct). Each repository's precision counts as well as the pooled one; a
    repository that stands twice fails.
    """
    if repositories < 2 or not 0 < precision <= 1:
        raise ValueError("a gate needs two repositories and a precision in (0, 1]")
    own = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("actual").cast("double")), F.lit(0.0))
    rows = evaluations.withColumn("__name", F.lower("repository")).withColumn("__weak", own < precision)
    again = rows.groupBy("__name").agg(F.count("*").alias("__n"), F.count_if("__weak").alias("__weak"), *[F.sum(c).cast("long").alias(c) for c in ("expected", "actual", "correct")])
    sums = again.agg(F.count("*").alias("repositories"), F.count_if(F.col("__n") > 1).alias("repeated"), F.coalesce(F.sum("__weak"), F.lit(0)).cast("long").alias("weak"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("expected", "actual", "correct")])
    out = sums.withColumn("precision", F.coalesce(share(F.col("correct"), F.col("actual")), F.lit(0.0))).withColumn("recall", F.coalesce(share(F.col("correct"), F.col("expected")), F.lit(0.0)))
    pooled = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("actual").cast("double")), F.lit(0.0)) < precision
    failures = _named([("repeated_repository", F.col("repeated") > 0), ("repository_precision", F.col("weak") > 0), ("repositories", F.col("repositories") < repositories), ("pooled_precision", pooled)])
    return out.withColumn("failures", failures).withColumn("passed", F.col("failures") == "")


def scoped_calls(facts: DataFrame, paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Resolved call facts whose source path is in scope and whose target begins with a prefix in scope.

    A target meets prefixes by its beginnings of the lengths that prefixes have, so the join is by key. The lengths are one small array.
    """
    near = facts.filter("type = 'CALLS' AND type_resolved").join(paths.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    use = prefixes.filter("prefix IS NOT NULL").select("prefix").distinct()
    sizes = use.agg(F.collect_set(F.length("prefix")).alias("__sizes"), F.lit(1).alias("__k"))
    names = near.select("to_key").distinct().withColumn("__k", F.lit(1)).join(F.broadcast(sizes), "__k")
    begun = names.select("to_key", F.explode(F.filter("__sizes", lambda n: n <= F.length("to_key"))).alias("n")).select("to_key", F.substring(F.col("to_key"), F.lit(1), F.col("n")).alias("prefix"))
    return near.join(begun.join(use, "prefix", "left_semi").select("to_key").distinct(), "to_key", "left_semi").select(*near.columns)


def reviewer_agreement(facts: DataFrame, key: list[str], reviewer: str) -> DataFrame:
    """One row: facts of both of the first two reviewers by name, of either, and their share (1 if there are none)."""
    first = facts.select(reviewer).distinct().orderBy(reviewer).limit(2)
    each = facts.join(F.broadcast(first), reviewer, "left_semi").groupBy(*key).agg(F.countDistinct(reviewer).alias("n"))
    counts = each.agg(F.count_if(F.col("n") == 2).alias("both"), F.count("*").alias("either"))
    return counts.withColumn("agreement", F.coalesce(share(F.col("both"), F.col("either")), F.lit(1.0)))


def packet_items(queue: DataFrame, adapter: DataFrame, oracle: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """source_path, line, kind, the two tools' callers and targets, excerpt, item_id: one row for each place in ``queue``.

    Facts (source_path, line, from_key, to_key). Tools agree where both sets are the same. ``lines`` (path, line, content) gives
    the lines around a place; the id is a hash of all of it.
    """
    told = lambda facts, a, b: facts.select("source_path", "line", "from_key", "to_key", F.lit(a).alias("adapter"), F.lit(b).alias("oracle"), F.lit(False).alias("queued"))
    places = queue.select("source_path", "line", F.lit(None).cast("string").alias("from_key"), F.lit(None).cast("string").alias("to_key"), F.lit(False).alias("adapter"), F.lit(False).alias("oracle"), F.lit(True).alias("queued"))
    return told_items(told(adapter, True, False).unionByName(told(oracle, False, True)).unionByName(places), lines, around)


def told_items(facts: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """``packet_items`` of one relation: facts (source_path, line, from_key, to_key), which of the two tools tells each (adapter, oracle), and whether its place is ``queued``.

    Facts are dealt by their place once, and all sets come from one grouping. Only places in files that have lines look for those around them.
    """
    whole = F.col("source_path").isNotNull() & F.col("line").isNotNull()  # a place that isn't known has no facts
    names = {"adapter_callers": ("adapter", "from_key"), "oracle_callers": ("oracle", "from_key"), "adapter_targets": ("adapter", "to_key"), "oracle_targets": ("oracle", "to_key")}
    sets = [F.array_sort(F.collect_set(F.when(F.col(tool) & whole, F.col(c)))).alias(name) for name, (tool, c) in names.items()]
    rows = facts.repartition("source_path", "line").groupBy("source_path", "line").agg(*sets, F.max("queued").alias("__queued")).filter("__queued").drop("__queued")
    paths = lines.select(F.col("path").alias("source_path")).distinct()
    places = facts.filter("queued").select("source_path", "line").join(paths, "source_path", "left_semi").distinct()
    shown = places.withColumn("__at", F.explode(F.sequence(F.col("line") - around, F.col("line") + around))).join(lines.select(F.col("path").alias("source_path"), F.col("line").alias("__at"), "content"), ["source_path", "__at"])
    excerpt = shown.groupBy("source_path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "content"))), lambda x: x["content"]), "\n").alias("excerpt"))
    out = rows.join(excerpt, ["source_path", "line"], "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    agree = (F.col("adapter_callers") == F.col("oracle_callers")) & (F.col("adapter_targets") == F.col("oracle_targets"))
    material = F.concat_ws("\n", "source_path", F.col("line").cast("string"), *[F.array_join(c, ",") for c in names], F.sha2("excerpt", 256))
    return out.withColumn("kind", F.when(agree, "agreement_sample").otherwise("tool_disagreement")).withColumn("item_id", F.substring(F.sha2(material, 256), 1, 20))


def phase_gate(cases: DataFrame, reviews: DataFrame, causes: DataFrame, sessions: DataFrame, least_cases: int = PHASE_CASES, least_causes: int = PHASE_CAUSES, least_sessions: int = PHASE_SESSIONS) -> DataFrame:
    """One row: counts of cases, root causes, reviews and timed sessions, and the failures joined by commas.

    ``cases`` (case_id, packet_id, frozen_at, adjudicated_by, adjudicated_at, conflict_count), ``reviews`` (case_id, reviewer_id,
    submitted_at, packet_id, calibrated_at), ``causes`` (case_id, root_cause_id), ``sessions`` (case_id, reviewer_id, arm,
    excluded_reason). A case is valid with two reviewers, reviews of the frozen packet after its freezing and after their
    calibration, adjudication after all reviews and, where there were conflicts, by a third person, and no root cause twice.
    Invalid cases fail the gate and don't count.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    tasks = SHARES * max(1, *[x.rdd.getNumPartitions() for x in (cases, reviews, causes, sessions)])
    timed = F.col("excluded_reason").isNull()
    calm, judged = n("conflict_count") <= 0, F.coalesce("adjudicated_by", F.lit("")) != ""
    # a case is sound if every review fits every one of its rows, which the least and the largest values tell
    facts = [
        cases.select("case_id", F.lit(1).alias("case"), calm.cast("int").alias("calm"), judged.cast("int").alias("judged"), (calm & judged).cast("int").alias("calm_judged"), "packet_id", F.col("adjudicated_by").alias("judge"), "frozen_at", "adjudicated_at", (F.col("packet_id").isNotNull() & F.col("frozen_at").isNotNull() & F.col("adjudicated_at").isNotNull()).alias("sound")),
        reviews.filter("case_id IS NOT NULL").select("case_id", "packet_id", F.col("reviewer_id").alias("reviewer"), "submitted_at", F.coalesce(F.col("packet_id").isNotNull() & (F.col("calibrated_at") <= F.col("submitted_at")), F.lit(False)).alias("sound")),
        causes.filter("case_id IS NOT NULL").select("case_id", F.lit(1).alias("cause"), F.col("root_cause_id").alias("root")),
        sessions.select("case_id", F.lit(1).alias("session"), timed.cast("int").alias("timed"), (timed & (F.col("arm") == "assisted")).cast("int").alias("assisted"), (timed & (F.col("arm") == "control")).cast("int").alias("control")),
    ]
    told = facts[0]
    for x in facts[1:]:
        told = told.unionByName(x, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sets = [F.collect_set(F.when(F.col("case_id").isNotNull(), F.col(c))).alias(f"{c}s") for c in ("reviewer", "judge", "root")]
    ends = [F.min("packet_id").alias("p0"), F.max("packet_id").alias("p1"), F.max("frozen_at").alias("frozen"), F.min("submitted_at").alias("s0"), F.max("submitted_at").alias("s1"), F.min("adjudicated_at").alias("ended"), F.min("sound").alias("sound")]
    # dealt by case once, in tasks whose number grows with the scans'
    per = told.repartition(tasks, "case_id").groupBy("case_id").agg(*sets, *ends, *[total(c) for c in ("case", "calm", "judged", "calm_judged", "cause", "session", "timed", "assisted", "control")])
    fits = F.col("sound") & (F.col("p0") == F.col("p1")) & (F.col("s0") >= F.col("frozen")) & (F.col("s1") < F.col("ended")) & (F.size("reviewers") >= 2) & (F.col("cause") == F.size("roots"))
    own = F.arrays_overlap("reviewers", "judges")
    of = lambda all_, some: F.when(F.coalesce(fits, F.lit(False)), F.when(own, F.col(some)).otherwise(F.col(all_))).otherwise(0)
    per = per.withColumn("valid", of("case", "calm")).withColumn("of_judges", of("judged", "calm_judged"))
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    valid = F.col("valid")
    counted = per.agg(
        count(F.col("case") - valid, "invalid_cases"), count(valid, "cases"), count(F.when(F.col("cause") > 0, valid), "positive_cases"), count(valid * F.col("cause"), "root_causes"), count(valid, "dual_reviewed"), count("of_judges", "adjudicated"),
        count("timed", "timed_sessions"), count("assisted", "assisted"), count("control", "control"), count(F.when(valid == 0, F.col("session")), "unknown_cases"), F.count_if(valid > 1).alias("repeated_cases"),
    )
    keys = sessions.repartition(tasks, "case_id", "reviewer_id", "arm").groupBy("case_id", "reviewer_id", "arm").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_sessions"))
    one = lambda x: x.withColumn("__k", F.lit(1))
    out = one(counted).join(one(keys), "__k").select(*[c for c in counted.columns if c != "repeated_cases"], "repeated_sessions", "repeated_cases")
    failures = _named([
        ("invalid_case", F.col("invalid_cases") > 0), ("repeated_case", F.col("repeated_cases") > 0), ("unknown_case", F.col("unknown_cases") > 0), ("repeated_session", F.col("repeated_sessions") > 0), ("cases", F.col("cases") < least_cases), ("root_causes", F.col("root_causes") < least_causes),
        ("dual_reviewed", F.col("dual_reviewed") != F.col("cases")), ("adjudicated", F.col("adjudicated") != F.col("cases")), ("timed_sessions", F.col("timed_sessions") < least_sessions), ("arms", (F.col("assisted") == 0) | (F.col("control") == 0)),
    ])
    return out.withColumn("failures", failures).withColumn("passed", F.col("failures") == "")


def brief_evidence(cases: DataFrame, files: DataFrame, symbols: DataFrame, relationships: DataFrame, bundle: DataFrame) -> DataFrame:
    """case_id, evidence_id, kind, label, path: all evidence of each case, long ids hashed."""
    title = cases.select("case_id", F.lit("pr:title").alias("id"), F.lit("pr_title").alias("kind"), F.substring("title", 1, 1000).alias("label"), F.lit(None).cast("string").alias("path"))
    body = cases.filter(F.trim(F.coalesce("body", F.lit(""))) != "").select("case_id", F.lit("pr:body").alias("id"), F.lit("pr_body").alias("kind"), F.substring(F.trim("body"), 1, 1000).alias("label"), F.lit(None).cast("string").alias("path"))
    diff = files.select("case_id", F.concat(F.lit("diff:"), "path").alias("id"), F.lit("diff").alias("kind"), F.concat("status", F.lit(": +"), F.col("additions").cast("string"), F.lit(" -"), F.col("deletions").cast("string")).alias("label"), "path")
    symbol = symbols.select("case_id", F.concat(F.lit("symbol:"), "id").alias("id"), F.lit("symbol").alias("kind"), F.substring(F.concat_ws(" ", "kind", "name"), 1, 1000).alias("label"), "path")
    tie = relationships.select("case_id", F.concat(F.lit("relationship:"), F.col("ordinal").cast("string")).alias("id"), F.lit("relationship").alias("kind"), F.substring(F.concat_ws(" ", "from_id", "type", "to_id"), 1, 1000).alias("label"), F.col("evidence_path").alias("path"))
    test = bundle.filter("role = 'test'").select("case_id", F.concat_ws(":", F.lit("test"), "revision", "path").alias("id"), F.lit("test").alias("kind"), F.concat("revision", F.lit(" test file")).alias("label"), "path")
    out = title.unionByName(body).unionByName(diff).unionByName(symbol).unionByName(tie).unionByName(test)
    return out.select("case_id", evidence_id(F.col("id")).alias("evidence_id"), "kind", "label", "path").distinct()


def behaviour_cards(files: DataFrame, groups: DataFrame, symbols: DataFrame, callers: DataFrame) -> DataFrame:
    """group, n_files, additions, deletions, core symbols, unchanged callers and tests (names, ``BRIEF_NAMES`` at most), level, questions.

    ``files`` (path, additions, deletions), ``groups`` (group, path), ``symbols`` (id, name, path), ``callers`` as ``graph.unchanged_callers``
    gives them. Every card asks for the contract and for reuse; for callers where there are some; and for the tests, or for missing ones.
    """
    of_files = groups.join(files, "path").groupBy("group").agg(F.count("*").alias("n_files"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"))
    names = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, BRIEF_NAMES)
    core = groups.join(symbols, "path").groupBy("group").agg(names("name").alias("core"))
    near = callers.groupBy("group").agg(names(F.when(F.col("kind") == "caller", F.col("name"))).alias("callers"), names(F.when(F.col("kind") == "test", F.col("name"))).alias("tests"))
    none = F.array().cast("array<string>")
    rows = of_files.join(core, "group", "left").join(near, "group", "left").select("group", "n_files", "additions", "deletions", *[F.coalesce(c, none).alias(c) for c in ("core", "callers", "tests")])
    questions = F.array_compact(F.array(F.lit("contract"), F.lit("reuse"), F.when(F.size("callers") > 0, "callers"), F.when(F.size("tests") > 0, "tests").otherwise("missing_tests")))
    return rows.withColumn("level", F.when(F.size("core") > 0, "semantic").otherwise("diff_only")).withColumn("questions", F.array_join(F.slice(questions, 1, BRIEF_QUESTIONS), ","))


def progress(cases: DataFrame, decisions: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row: all cases, those with a frozen and with a deferred decision, those pending, and those whose context is ready."""
    rows = cases.select("case_id").join(decisions.select("case_id", "status"), "case_id", "left").join(contexts.select("case_id", F.lit(True).alias("ready")).distinct(), "case_id", "left")
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("total"), n("frozen").alias("frozen"), n("deferred").alias("deferred"), (F.count("*") - n("frozen") - n("deferred")).alias("pending"), F.count_if("ready").alias("context_ready"))


def diff_evidence_problems(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """``evidence`` (id, path, side, start_line, end_line) with ``problem``: a path that isn't changed, or a line that its side of the diff doesn't have; else null.

    A span is there if the run of changed lines that holds its first line holds its last one too; a span without a line lacks none.
    """
    there = runs(changed_line_sets(files), ["path", "side"], "line")
    asked = evidence.filter("start_line <= end_line").select("id", "path", "side", "start_line", "end_line")
    whole = holding(asked, "start_line", there, ["path", "side"], "first_line", "last_line").filter("end_line <= last_line").select("id").distinct()
    known = evidence.join(files.select("path", F.lit(True).alias("__known")).distinct(), "path", "left").join(whole.withColumn("__whole", F.lit(True)), "id", "left")
    lacks = F.col("__whole").isNull() & (F.col("start_line") <= F.col("end_line"))
    return known.select(*evidence.columns, F.when(F.col("__known").isNull(), "unknown_path").when(lacks, "line_not_in_diff").alias("problem"))


def context_evidence_problems(evidence: DataFrame, bundle: DataFrame, symbols: DataFrame) -> DataFrame:
    """``evidence`` (id, path, revision, end_line, symbol) with ``problem``: a revision's file or the symbol isn't in the packet, or the file is shorter; else null.

    A revision of ``both`` asks for the base and the head. ``bundle`` (revision, path, content), ``symbols`` (id, name, path, revision).
    """
    revisions = F.when(F.col("revision") == "both", F.array(F.lit("base"), F.lit("head"))).otherwise(F.array("revision"))
    each = evidence.withColumn("__r", F.explode(revisions)).join(bundle.select(F.col("revision").alias("__r"), "path", F.size(F.split("content", r"\r?\n")).alias("__n")), ["__r", "path"], "left")
    checked = each.groupBy("id").agg(F.count_if(F.col("__n").isNull()).alias("__gone"), F.count_if(F.col("end_line") > F.col("__n")).alias("__short"))
    names = symbols.select("path", F.col("revision").alias("__r"), F.explode(F.array("id", "name")).alias("symbol")).distinct()
    hit = evidence.filter("symbol IS NOT NULL").join(names, ["path", "symbol"]).filter("revision = 'both' OR revision = __r").select("id", F.lit(True).alias("__hit")).distinct()
    rows = evidence.join(checked, "id", "left").join(hit, "id", "left")
    return rows.select(*evidence.columns, F.when(F.col("__gone") > 0, "file_not_in_packet").when(F.col("__short") > 0, "line_beyond_file").when(F.col("symbol").isNotNull() & F.col("__hit").isNull(), "symbol_not_in_packet").alias("problem"))


def recovery_assessment(runs: DataFrame, observations: DataFrame, outputs: DataFrame, journal: DataFrame) -> DataFrame:
    """run_id, blockers (joined by commas), verdict: candidate only if nothing stands against it.

    ``runs`` (run_id, in_scope), ``observations`` (run_id, operation, result), ``outputs`` (run_id, start_hash, result_hash, summary_hash),
    ``journal`` (run_id, operation, request_hash, state).
    """
    seen = observations.groupBy("run_id").agg(F.count_if(~F.col("result").eqNullSafe("verified_remote")).alias("unverified"))
    at = lambda op, c: F.max(F.when(F.col("operation") == op, F.col(c)))
    each = journal.groupBy("run_id").agg(at("check_start", "request_hash").alias("a"), at("check_start", "state").alias("a_state"), at("check_result", "request_hash").alias("b"), at("summary_comment", "request_hash").alias("c"))
    rows = runs.join(seen, "run_id", "left").join(outputs, "run_id", "left").join(each, "run_id", "left")
    matches = F.col("a_state").eqNullSafe("confirmed") & F.col("a").eqNullSafe(F.col("start_hash")) & F.col("b").eqNullSafe(F.col("result_hash")) & F.col("c").eqNullSafe(F.col("summary_hash"))
    blockers = _named([("outside_scope", ~F.col("in_scope")), ("remote_not_verified", F.coalesce("unverified", F.lit(0)) > 0), ("frozen_output_missing", F.col("start_hash").isNull()), ("journal_conflict", F.col("start_hash").isNotNull() & ~matches)])
    return rows.select("run_id", blockers.alias("blockers")).withColumn("verdict", F.when(F.col("blockers") == "", "candidate").otherwise("blocked"))


def eligible_changes(changes: DataFrame, files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Changes that may become cases: merged, by a person, of 1 to 25 files, with reviewable patches of 120,000 characters at most and no secret anywhere.

    ``changes`` (change_id, merged, bot, title, body), ``files`` (change_id, path, patch). change_id, n_files, patch_chars.
    A patch that is too long alone isn't searched for secrets, as its change falls out by its length.
    """
    ends = F.lit(False)
    for x in extensions:
        ends = ends | F.lower("path").endswith(x)
    reviewable = ends & ~F.col("path").rlike(BUILT_PATH) & (F.octet_length(F.coalesce("patch", F.lit(""))) > 0)
    sized = files.select("change_id", "patch", F.when(reviewable, F.length("patch")).alias("chars"))  # each patch is measured once
    per = sized.groupBy("change_id").agg(F.count("*").alias("n_files"), F.count("chars").alias("reviewable"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("patch_chars"), F.count_if((F.col("chars") <= MOST_PATCH_CHARS) & ~is_clean(F.col("patch"))).alias("secret"))
    use = changes.filter(F.col("merged") & ~F.col("bot") & is_clean(F.col("title")) & is_clean(F.col("body"))).select("change_id")
    return per.filter((F.col("n_files") <= MOST_FILES) & (F.col("reviewable") >= 1) & (F.col("patch_chars") <= MOST_PATCH_CHARS) & (F.col("secret") == 0)).join(use, "change_id", "left_semi").select("change_id", "n_files", "patch_chars")


def reverse_fixes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """change_id, path, additions, deletions, patch: the reversed Go files of changes that say they fix something.

    Fix-like title or labels and no title of little value; 1 to 25 files; modified Go files outside vendored and generated
    folders, without secrets, of 120,000 characters at most in all; and one line that means something is added outside tests.
    """
    said = ~F.col("title").rlike(ascii_bounds(LOW_VALUE_TITLE)) & (F.col("title").rlike(ascii_bounds(FIX_TITLE)) | F.coalesce("labels", F.lit("")).rlike(ascii_bounds(FIX_LABEL)))
    fixes = changes.filter(F.col("merged") & ~F.col("bot") & said).select("change_id")
    use = (F.col("status") == "modified") & F.lower("path").endswith(".go") & ~F.col("path").rlike(UNREVIEWED_PATH) & (F.length(F.coalesce("patch", F.lit(""))) > 0) & is_clean(F.col("patch"))

    def says(line: Column) -> Column:
        text = F.trim(F.substring(line, 2, 1 << 30))
        return line.startswith("+") & ~line.startswith("+++") & (text != "") & ~text.startswith("//") & ~text.startswith("/*") & ~text.startswith("*") & ~text.rlike(r"^[{}(),;]+$")

    # what a patch adds is seen in its own lines, so changes are judged by one grouping; a file's row meets their keys by hash and is never sorted
    lines = F.split(reversed_patch(F.col("patch")), "\n")
    head = F.array_position(F.transform(lines, lambda x: x.rlike(HUNK)), True).cast("int")
    adds = ~F.col("path").rlike(GO_TEST_PATH) & (head > 0) & F.exists(F.slice(lines, F.greatest(head, F.lit(1)), F.size(lines)), says)
    marked = files.select("change_id", F.when(use, F.length("patch")).alias("chars"), (use & adds).alias("adds"))  # a reversed patch is as long
    per = marked.groupBy("change_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("adds").alias("adds"))
    fit = per.filter((F.col("n") <= MOST_FILES) & (F.col("chars") <= MOST_PATCH_CHARS) & F.col("adds")).join(fixes, "change_id", "left_semi").select("change_id")
    turned = files.filter(use).select("change_id", "path", F.col("deletions").alias("additions"), F.col("additions").alias("deletions"), reversed_patch(F.col("patch")).alias("patch"))
    return turned.join(fit.hint("shuffle_hash"), "change_id", "left_semi")


def exported_labels(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases with their decisions. While any case isn't frozen, the query fails when it runs."""
    rows = cases.join(decisions, "case_id", "left")
    missing = rows.agg(F.count_if(~F.col("status").eqNullSafe("frozen")).alias("n"))
    checked = missing.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" cases still need a frozen decision")))).alias("__error"))
    return rows.join(F.broadcast(checked), F.col("__error").isNull()).drop("__error")


def coverage_limits(base: DataFrame, head: DataFrame, key: str, anchors: DataFrame | None = None) -> DataFrame:
    """``key``, limitations (joined by commas), complete: what keeps two indexes from showing that something doesn't exist.

    Each side (``key``, level, eligible, indexed, failed, skipped, unresolved, adapter). With ``anchors`` (``key``) a key that isn't
    among them has no changed symbol to start from. A missing side is one that was never indexed.
    """
    side = lambda x, n: x.select(key, *[F.col(c).alias(f"{n}_{c}") for c in ("level", "eligible", "indexed", "failed", "skipped", "unresolved", "adapter")])
    rows = side(base, "base").join(side(head, "head"), key, "full_outer")
    checks: list[tuple[str, Column]] = []
    for n in ("base", "head"):
        checks += [(f"{n}_not_semantic", ~F.col(f"{n}_level").eqNullSafe("SEMANTIC")), (f"{n}_not_all_indexed", ~F.col(f"{n}_indexed").eqNullSafe(F.col(f"{n}_eligible"))), (f"{n}_failed", F.col(f"{n}_failed") > 0), (f"{n}_skipped", F.col(f"{n}_skipped") > 0), (f"{n}_unresolved", F.col(f"{n}_unresolved") > 0)]
    checks.append(("adapters_differ", ~F.col("base_adapter").eqNullSafe(F.col("head_adapter"))))
    if anchors is not None:
        rows = rows.join(anchors.select(key, F.lit(True).alias("__anchor")).distinct(), key, "left")
        checks.append(("no_anchor", F.col("__anchor").isNull()))
    return rows.select(key, _named(checks).alias("limitations")).withColumn("complete", F.col("limitations") == "")


def decision_problems(decisions: DataFrame, investigations: DataFrame, candidates: DataFrame, rejections: DataFrame) -> DataFrame:
    """decision_id, problems (joined by commas) of reuse decisions against the investigation they are about.

    Six fields must be the investigation's; texts have their lengths; a budget of 1 to 50 files and 1 to 200 symbols. ``new`` selects
    nothing, needs a complete and non-empty search and a rejection of every candidate; the others select a candidate that
    isn't rejected. ``decisions`` (decision_id, investigation_id, base_sha, head_sha, adapter, base_model, head_model, strategy, goal,
    justification, selected_id, max_files, max_symbols, expected_revision), ``investigations`` (investigation_id, the same five, complete, searched).
    """
    same = ("base_sha", "head_sha", "adapter", "base_model", "head_model")
    about = investigations.select("investigation_id", *[F.col(c).alias(f"__{c}") for c in same], "complete", "searched")
    given = candidates.join(decisions.select("decision_id", "investigation_id"), "investigation_id").select("decision_id", "candidate_id")
    refused = rejections.select("decision_id", "candidate_id", F.lit(True).alias("__no")).distinct()
    open_ = given.join(refused, ["decision_id", "candidate_id"], "left").groupBy("decision_id").agg(F.count_if(F.col("__no").isNull()).alias("open"))
    chosen = decisions.select("decision_id", F.col("selected_id").alias("candidate_id")).join(given, ["decision_id", "candidate_id"]).join(refused, ["decision_id", "candidate_id"], "left").select("decision_id", F.lit(True).alias("__chosen"), F.coalesce("__no", F.lit(False)).alias("__refused"))
    rows = decisions.join(about, "investigation_id", "left").join(open_, "decision_id", "left").join(chosen, "decision_id", "left")
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    new, none = F.col("strategy") == "new", size("selected_id") == 0
    checks = [("investigation", F.col("complete").isNull()), *[(c, ~F.col(c).eqNullSafe(F.col(f"__{c}"))) for c in same]]
    checks += [("revision", F.col("expected_revision") < 0), ("goal", ~size("goal").between(8, 1000)), ("justification", ~size("justification").between(12, 4000)), ("strategy", ~F.coalesce(F.col("strategy").isin(*STRATEGIES), F.lit(False)))]
    checks += [("budget", ~F.coalesce(F.col("max_files").between(1, BUDGET_FILES) & F.col("max_symbols").between(1, BUDGET_SYMBOLS), F.lit(False)))]
    checks += [("selected", new & ~none), ("incomplete_search", new & ~(F.coalesce("complete", F.lit(False)) & (F.coalesce("searched", F.lit(0)) > 0))), ("open_candidates", new & (F.coalesce("open", F.lit(0)) > 0)), ("no_candidate", ~new & F.col("__chosen").isNull()), ("rejected_candidate", ~new & F.coalesce("__refused", F.lit(False)))]
    return rows.select("decision_id", _named(checks).alias("problems"))


def patch_problems(proposals: DataFrame, decisions: DataFrame, options: DataFrame) -> DataFrame:
    """proposal_id, problems (joined by commas) of patches against the decision and the option they belong to.

    ``proposals`` (proposal_id, behavior_id, option_id, files, symbols, changes_contract, verification), ``decisions`` (behavior_id,
    max_files, max_symbols, contract_allowed), ``options`` (option_id, behavior_id).
    """
    rows = proposals.join(decisions.select("behavior_id", "max_files", "max_symbols", "contract_allowed"), "behavior_id", "left").join(options.select("option_id", F.col("behavior_id").alias("__b")), "option_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = [("decision", F.col("max_files").isNull()), ("option", F.col("__b").isNull()), ("other_behavior", F.col("__b") != F.col("behavior_id")), ("files", n("files") > F.col("max_files")), ("symbols", n("symbols") > F.col("max_symbols"))]
    checks += [("contract", F.col("changes_contract") & ~F.col("contract_allowed")), ("verification", n("verification") == 0)]
    return rows.select("proposal_id", _named(checks).alias("problems"))


def solution_options(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """behavior_id, option, strategy, candidate_id, expected_files, expected_symbols: the decided way, and plain reuse where that is smaller.

    ``decisions`` (behavior_id, strategy, selected_id, changed_files, max_files), ``candidates`` (candidate_id, name, path).
    """
    chosen = candidates.select(F.col("candidate_id").alias("selected_id"), F.col("name").alias("__name"), F.col("path").alias("__path"))
    rows = decisions.join(chosen, "selected_id", "left")
    has = F.col("__path").isNotNull()
    files = F.slice(F.array_distinct(F.concat(F.when(has, F.array("__path")).otherwise(F.array().cast("array<string>")), "changed_files")), F.lit(1), F.col("max_files"))
    symbols = F.when(has, F.array("__name")).otherwise(F.array().cast("array<string>"))
    one = lambda name, strategy: rows.select("behavior_id", F.lit(name).alias("option"), strategy.alias("strategy"), F.when(has, F.col("selected_id")).alias("candidate_id"), files.alias("expected_files"), symbols.alias("expected_symbols"))
    smaller = rows.filter(has & (F.col("strategy") != "reuse"))
    return one("primary", F.col("strategy")).unionByName(one("minimal-reuse", F.lit("reuse")).join(smaller.select("behavior_id"), "behavior_id", "left_semi"))


def next_revisions(submissions: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """``submissions`` (key, expected_revision, ...) with ``accepted`` and ``revision``: taken only if the expected revision is the latest; the next one is one more."""
    latest = history.groupBy(key).agg(F.max("revision").alias("__latest"))
    rows = submissions.join(latest, key, "left").withColumn("__latest", F.coalesce("__latest", F.lit(0)))
    ok = F.col("expected_revision") == F.col("__latest")
    return rows.withColumn("accepted", ok).withColumn("revision", F.when(ok, F.col("__latest") + 1)).drop("__latest")


def safe_files(files: DataFrame, most_files: int, most_bytes: int, most_file_bytes: int) -> DataFrame:
    """path, n_bytes, status of a repository's entries: unsafe_path, too_large, or kept. More kept files or bytes than allowed are an error."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    rows = files.select("path", size.alias("n_bytes"), F.when(~is_safe_path(F.col("path")), "unsafe_path").when(size > most_file_bytes, "too_large").otherwise("kept").alias("status"))
    kept = F.col("status") == "kept"
    sums = rows.agg(F.count_if(kept).alias("n"), F.coalesce(F.sum(F.when(kept, F.col("n_bytes"))), F.lit(0)).alias("b"))
    over = sums.select(F.when((F.col("n") > most_files) | (F.col("b") > most_bytes), F.raise_error(F.lit("the repository exceeds its limits"))).alias("__error"))
    return rows.join(F.broadcast(over), F.col("__error").isNull()).drop("__error")
