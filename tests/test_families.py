"""Operators without SQL against plain versions, and the defined results for nulls, ties, repeated rows, empty tables and clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import diff, evaluation, graph, jobs, packets, policy, review, state
from patchloom.operators.ranks import numbered
from patchloom.sources import context
from patchloom.sources.tables import SCHEMAS, conforming, load_ready, load_snapshot, relation, replay_cases, save_index, save_snapshot
from patchloom.streaming import intake

SYMBOL = "stable_key string, kind string, qualified_name string, signature string, content_hash string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_places_in_a_total_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(1000), k) for k in range(500)] + [(None, 3, 500), ("a", None, 501)]
    got = numbered(frame(spark, rows, "g string, x int, k int"), ["g"], ["x", "k"], ranges=7).collect()
    for group in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r.k for r in sorted((r for r in got if r.g == group), key=lambda r: r.place)] == [r[2] for r in own]
    assert numbered(frame(spark, [], "g string, x int"), [], ["x"]).count() == 0


def test_percentiles_are_nearest_ranks(spark):
    rnd = random.Random(2)
    rows = [(g, float(rnd.choice((1, 2, 3, rnd.randrange(10_000))))) for g in "abc" for _ in range(rnd.choice((1, 7, 900)))] + [("a", None)]
    got = evaluation.nearest_rank(frame(spark, rows, "g string, v double"), "v", {"p50": 0.5, "p95": 0.95, "all": 1.0}, ["g"]).collect()
    assert len(got) == 3
    for r in got:
        own = sorted(v for g, v in rows if g == r.g and v is not None)
        assert (r.n, r.p50, r.p95, r["all"]) == (len(own), own[math.ceil(len(own) * 0.5) - 1], own[math.ceil(len(own) * 0.95) - 1], own[-1])


def test_runs_without_an_end_stay(spark):
    rows = frame(spark, [(1, "1990-01-01", "completed"), (2, None, "queued"), (3, "1990-01-01", "in_progress"), (4, "1999-01-01", "failed")], "id int, t string, status string").withColumn("ts", F.col("t").cast("timestamp"))
    now = F.lit("1999-02-01").cast("timestamp")
    assert sorted(r.id for r in state.retained(rows, "ts", now, 90, "status").collect()) == [2, 3, 4]
    assert sorted(r.id for r in state.retained(rows, "ts", now, 90).collect()) == [2, 4]
    for days in (0, -1, 1.5):
        with pytest.raises(ValueError):
            state.retained(rows, "ts", now, days)


def test_rows_that_share_a_path_are_patches_of_their_own(spark):
    files = frame(spark, [("1", "p", "@@ -1 +1,2 @@\n+a\n+c"), ("2", "p", "@@ -5 +5 @@\n+b"), (None, "q", None), ("3", "r", "")], "change string, path string, patch string")
    got = diff.parse_patch(files, keys=("change", "path")).collect()
    assert sorted((r.change, r.content, r.right_line) for r in got) == [("1", "a", 1), ("1", "c", 2), ("2", "b", 5)]
    assert sorted((r.content, r.right_line) for r in diff.parse_patch(files).collect()) == [("a", 1), ("b", 5), ("c", 2)]
    clash = frame(spark, [("x", "@@ -1 +1 @@\n+a", 7)], "hunk string, patch string, pos int")
    assert [(r.hunk, r.content) for r in diff.parse_patch(clash, keys=("hunk",)).collect()] == [("x", "a")]


def test_loose_lines_and_sides(spark):
    patch = "@@ -3,3 +3,3 @@\n ctx\nodd\n-old\n+new\n--- name\n+++ name\n+last"
    got = diff.changed_line_sets(frame(spark, [("p", patch)], "path string, patch string")).collect()
    assert {(r.side, r.line) for r in got} == {("LEFT", 5), ("RIGHT", 5), ("RIGHT", 6)}


def test_budget_reasons(spark):
    rows = [(1, k, f"f{k}", p) for k, p in enumerate(("a" * 10 + "\n" + "b" * 10, "", "token: abcdefgh\n" * 3, "x" * 50, "y"))]
    got = {r.path: r for r in diff.patch_budget_by_line(frame(spark, rows, "g int, k int, path string, patch string"), "g", "k", 60, 4).collect()}
    assert [got[f"f{k}"].omission for k in range(5)] == [None, "patch_unavailable", "patch_truncated", "patch_truncated", "file_limit"]
    assert (got["f0"].kept_chars, got["f2"].patch_chars, got["f3"].kept_chars, got["f4"].kept_hash) == (21, 54, 0, None)


def test_edits_as_hunks(spark):
    files = frame(spark, [("c", "p", "1\n2\n3\n4\n5\n"), ("d", "p", "1\n2\n")], "change_id string, path string, content string")
    edits = frame(spark, [("c", "p", 2, 2, ["x", "y"]), ("c", "p", 4, 5, ["z"]), ("d", "p", 2, 9, ["q"])], "change_id string, path string, start_line int, end_line int, replacement array<string>")
    got = {r.change_id: r for r in diff.unified_edits(files, edits).collect()}
    assert got["c"].diff == "--- a/p\n+++ b/p\n@@ -2,1 +2,2 @@\n-2\n+x\n+y\n@@ -4,2 +5,1 @@\n-4\n-5\n+z" and (got["c"].removed, got["c"].added) == (3, 3)
    assert got["d"].refused == "invalid_range" and got["d"].diff is None


def test_only_new_symbols_need_be_alone(spark):
    base = frame(spark, [("a", "f", "n", "s", "1"), ("b", "f", "n", "s", "2"), ("k", "f", "m", "s", "1")], SYMBOL)
    head = frame(spark, [("c", "f", "n", "s", "2"), ("x", "f", "m", "s", "8"), ("y", "f", "m", "s", "1"), ("z", "f", "m", "s", "1")], SYMBOL)
    # the first lost one takes the only new one; two of the same content are nobody's
    assert [(r.from_key, r.to_key, r.tier) for r in graph.moved_symbols(base, head).collect()] == [("a", "c", 2)]
    exact = frame(spark, [("c", "f", "n", "s", "2"), ("d", "f", "n", "s", "1")], SYMBOL)
    assert sorted((r.from_key, r.to_key, r.tier) for r in graph.moved_symbols(base, exact).collect()) == [("a", "d", 1), ("b", "c", 1)]


def test_semantic_impact_skips_changed_files(spark):
    schema = "stable_key string, qualified_name string, path string"
    base = frame(spark, [("t", "T", "changed"), ("u", "U", "other")], schema)
    head = frame(spark, [("t", "T2", "changed"), ("n", "N", "changed"), ("u", "U", "other"), ("v", "V", "other")], schema)
    edge = "from_key string, to_key string, type string, confidence double, ord long, type_resolved boolean"
    edges = frame(spark, [("u", "t", "CALLS", 0.5, 2, True), ("u", "t", "TESTS", 0.1, 1, True), ("v", "t", "THROWS", 0.9, 3, True), ("n", "t", "CALLS", 0.9, 4, True), ("v", "n", "READS", 0.7, 5, True), ("gone", "t", "CALLS", 1.0, 6, True), ("v", "t", "CALLS", 1.0, 7, False)], edge)
    got = graph.semantic_impact(base, head, edges, frame(spark, [("changed",)], "path string")).collect()
    assert [(r.changed_name, r.impacted_name, r.score, r.place) for r in got] == [("T2", "U", 1.0, 1), ("N", "V", 0.7, 2)]


def test_reuse_tiers(spark):
    schema = "stable_key string, kind string, qualified_name string, test_source boolean"
    changed = frame(spark, [("q", "METHOD", "x.Q"), ("r", "CLASS", "x.ReadFile")], "stable_key string, kind string, qualified_name string")
    symbols = frame(spark, [("q", "METHOD", "x.Q", False), ("same", "METHOD", "y.Q", False), ("sub", "CLASS", "y.Sub", False), ("test", "METHOD", "y.T", True), ("tok", "CLASS", "y.FileWriter", False), ("no", "FIELD", "y.file", False)], schema)
    edges = frame(spark, [("sub", "r", "EXTENDS", 1.0, 1, True), ("test", "q", "CALLS", 1.0, 2, True)], "from_key string, to_key string, type string, confidence double, ord long, type_resolved boolean")
    got = {r.stable_key: (r.tier, r.score) for r in graph.reuse_candidates(symbols, changed, edges).collect()}
    assert got == {"same": ("same_contract", 0.95), "sub": ("same_contract", 0.96), "test": ("test_fixture", 0.9), "tok": ("similar_logic", 0.58)}
    assert "sub" not in {r.stable_key for r in graph.reuse_candidates(symbols, changed, edges, inheritance=False).collect()}


def test_impact_with_evidence(spark):
    edges = frame(spark, [("a", "t", "CALLS", 0.5, 1), ("b", "a", "CALLS", 1.0, 2), ("c", "t", "IMPORTS", 1.0, 3)], "from_key string, to_key string, type string, confidence double, ord long")
    changes = frame(spark, [("t",)], "stable_key string")
    got = graph.impact_paths(changes, edges, None, types=("CALLS",), evidence=True).collect()
    assert sorted((r.impacted_key, r.depth, r.score, r.path, r.edge_ords) for r in got) == [("a", 1, 0.5, ["a", "t"], [1]), ("b", 2, 0.275, ["b", "a", "t"], [2, 1])]
    assert [r.impacted_key for r in graph.impact_paths(changes, edges, graph.WEIGHTS, cap=1, trim=True).collect()] == ["c"]


def test_paths_without_dots(spark):
    rows = frame(spark, [("a/./b/../c",), ("../x//y",), ("",), ("a/..",), (None,)], "p string")
    assert [r.n for r in rows.select(graph.normal_path(F.col("p")).alias("n")).collect()] == ["a/c", "../x/y", "", "", None]


def test_incremental_index(spark):
    sym = "stable_key string, kind string, qualified_name string, path string"
    edge = "from_key string, to_key string, type string, source_path string"
    base = frame(spark, [("A#a()", "METHOD", "A.a", "A"), ("B#b()", "METHOD", "B.b", "B"), ("C#c()", "METHOD", "C.c", "C"), ("D#d()", "METHOD", "D.d", "D")], sym)
    edges = frame(spark, [("B#b()", "A#a()", "CALLS", "B"), ("C#c()", "unresolved:method:fresh/1", "CALLS", "C"), ("D#d()", "C#c()", "CALLS", "D"), ("D#d()", "A#gone()", "CALLS", "D")], edge)
    changed = frame(spark, [("A",)], "path string")
    assert sorted(r.path for r in graph.affected_paths(base, edges, changed).collect()) == ["A", "B"]
    parsed = frame(spark, [("A#fresh(int)", "METHOD", "A.fresh", "A")], sym)
    affected = graph.affected_paths(base, edges, changed, parsed)
    assert sorted(r.path for r in affected.collect()) == ["A", "B", "C"]
    new = frame(spark, [("A#fresh(int)", "METHOD", "A.fresh", "A"), ("B#b()", "METHOD", "B.b", "B"), ("C#c()", "METHOD", "C.c", "C")], sym)
    again = frame(spark, [("C#c()", "A#fresh(int)", "CALLS", "C")], edge)
    symbols, kept = graph.incremental_index(base, edges, new, again, changed, affected)
    assert sorted(r.stable_key for r in symbols.collect()) == ["A#fresh(int)", "B#b()", "C#c()", "D#d()"]
    assert sorted((r.from_key, r.to_key) for r in kept.collect()) == [("C#c()", "A#fresh(int)"), ("D#d()", "A#gone()"), ("D#d()", "C#c()")]
    made = graph.unresolved_names(frame(spark, [("x.A#<init>(int,int)", "CONSTRUCTOR", "x.A.<init>", "A"), ("x.A#m()", "METHOD", "x.A.m", "A"), ("x.A", "CLASS", "x.A", "A")], sym))
    assert {r.to_key for r in made.collect()} == {"unresolved:constructor:x.A/2", "unresolved:method:m/0"}


def plain_leases(events):
    status, attempts, generation, until, out = "queued", 0, 0, 0, []
    for seq, kind, held, ts in sorted(events):
        mine = status == "processing" and generation == held and until > ts
        ok = False
        if kind == "claim" and status in ("queued", "retry") and attempts < 3:
            ok, status, generation, until = True, "processing", generation + 1, ts + 120
        elif kind == "renew" and mine:
            ok, until = True, ts + 120
        elif kind == "complete" and mine:
            ok, status = True, "completed"
        elif kind == "expire" and status == "processing" and until <= ts:
            ok, attempts = True, attempts + 1
            status = "failed" if attempts >= 3 else "retry"
        out.append((seq, kind, ok, status, attempts, generation))
    return out


def test_lease_replay_equals_a_loop(spark):
    rnd = random.Random(5)
    events = [(j, k, rnd.choice(("claim", "claim", "renew", "expire", "complete")), rnd.randrange(1, 4), k * rnd.choice((10, 100))) for j in range(20) for k in range(25)]
    got = jobs.replay_leases(frame(spark, events, "id int, seq int, kind string, generation int, ts long")).collect()
    for j in range(20):
        assert sorted((r.seq, r.kind, r.ok, r.status, r.attempts, r.generation) for r in got if r.id == j) == plain_leases([e[1:] for e in events if e[0] == j])


def test_journal_replay_equals_a_loop(spark):
    rnd = random.Random(6)
    events = [(r, "op", k, rnd.choice(("sent", "confirmed")), rnd.choice("xy"), rnd.choice((None, 1, 2))) for r in range(20) for k in range(8)]
    got = jobs.replay_journal(frame(spark, events, "run_id int, operation string, seq int, kind string, hash string, remote_id int")).collect()
    for run in range(20):
        kept, known, remote, want = "none", None, None, []
        for _, _, seq, kind, sha, rid in (e for e in events if e[0] == run):
            ok = (kind == "sent" and known is None) or (kind == "confirmed" and known == sha and rid is not None and remote in (None, rid))
            if ok:
                known, kept, remote = (sha if kind == "sent" else known), ("sent" if kind == "sent" else "confirmed"), rid if rid is not None else remote
            want.append((seq, kind, ok, kept, remote))
        assert sorted((r.seq, r.kind, r.ok, r.state, r.remote_id) for r in got if r.run_id == run) == want


def test_policies():
    text = "version: 1\nreview:\n  language: zh\n  blocking: true # yes\n  maxInlineComments: 5\n  minimumConfidence:\n    high: 0.9\ninclude:\n  - 'src/**'\nexclude: [a/**, \"b/*\"]\nrules:\n  - id: x\n    description: no prints\n    enabled: false\n  - key: y\n    content: z\n"
    got = policy.parse_policy(text)
    assert (got.language, got.blocking, got.max_inline, got.minimum_confidence, got.include, got.exclude, got.warnings) == ("zh", True, 5, {"high": 0.9}, ("src/**",), ("a/**", "b/*"), ())
    assert got.rules == (("x", "", "", "no prints", False), ("y", "", "", "z", True))
    plain = policy.Policy()
    assert policy.parse_policy(None) == policy.parse_policy("") == policy.parse_policy("# nothing") == plain
    for bad in ("version: 2", "review:\n  language: fr", "review:\n  maxInlineComments: 51", "review:\n  maxInlineComments: true", "review:\n  minimumConfidence:\n    high: 2", "review:\n  minimumConfidence:\n    urgent: 1", "rules:\n  - id: x", "a\nb", "x" * 100_001):
        found = policy.parse_policy(bad)
        assert found.warnings and policy.policy_hash(found) == policy.policy_hash(plain)
    assert policy.policy_hash(got) != policy.policy_hash(plain)


def test_phase_gate_rules(spark):
    case = "case_id int, packet_id string, frozen_at int, adjudicated_by string, adjudicated_at int, conflict_count int"
    review_ = "case_id int, reviewer_id string, submitted_at int, packet_id string, calibrated_at int"

    def gate(cases, reviews, causes=((1, "a"),), sessions=((1, "r", "assisted", None), (1, "r", "control", None))):
        return packets.phase_gate(frame(spark, cases, case), frame(spark, reviews, review_), frame(spark, list(causes), "case_id int, root_cause_id string"), frame(spark, list(sessions), "case_id int, reviewer_id string, arm string, excluded_reason string"), 1, 1, 2).first()

    good, two = (1, "p", 1, "judge", 9, 1), [(1, "r", 5, "p", 2), (1, "s", 6, "p", 2)]
    row = gate([good], two)
    assert row.passed and (row.cases, row.positive_cases, row.root_causes, row.timed_sessions, row.assisted, row.control) == (1, 1, 1, 2, 1, 1)
    bad = [([good], two[:1]), ([good], [two[0], (1, "s", 6, "other", 2)]), ([good], [two[0], (1, "s", 0, "p", 0)]), ([good], [two[0], (1, "s", 6, "p", 7)]), ([(1, "p", 1, "judge", 6, 1)], two), ([(1, "p", 1, "s", 9, 1)], two)]
    assert all("invalid_case" in gate(*x).failures for x in bad)
    assert gate([(1, "p", 1, "s", 9, 0)], two).passed  # without conflicts a reviewer may decide
    assert "invalid_case" in gate([good], two, [(1, "a"), (1, "a")]).failures
    assert gate([good], two, sessions=((1, "r", "assisted", None), (2, "r", "assisted", None))).failures == "unknown_case,arms"
    assert "repeated_session" in gate([good], two, sessions=((1, "r", "control", None),) * 2).failures
    assert gate([], []).failures == "unknown_case,cases,root_causes"


def test_behaviour_cards(spark):
    files = frame(spark, [("a", 3, 1), ("b", 2, 0)], "path string, additions int, deletions int")
    groups = frame(spark, [("g1", "a"), ("g2", "b")], "group string, path string")
    symbols = frame(spark, [("1", "f", "a"), ("2", "caller", "x"), ("3", "testit", "t")], "id string, name string, path string")
    ties = frame(spark, [("2", "1", "calls"), ("3", "1", "calls")], "from_id string, to_id string, type string")
    roles = frame(spark, [("a", "source"), ("x", "source"), ("t", "test")], "path string, role string")
    near = graph.unchanged_callers(symbols, ties, groups, roles)
    assert {tuple(r) for r in near.collect()} == {("g1", "caller", "caller"), ("g1", "test", "t")}
    got = {r.group: r for r in packets.behaviour_cards(files, groups, symbols, near).collect()}
    assert (got["g1"].core, got["g1"].callers, got["g1"].tests, got["g1"].level, got["g1"].questions) == (["f"], ["caller"], ["t"], "semantic", "contract,reuse,callers,tests")
    assert (got["g2"].level, got["g2"].questions, got["g2"].additions) == ("diff_only", "contract,reuse,missing_tests", 2)


def test_exports_need_frozen_cases(spark):
    cases = frame(spark, [(1,), (2,)], "case_id int")
    with pytest.raises(Exception, match="1 cases still need"):
        packets.exported_labels(cases, frame(spark, [(1, "frozen"), (2, "deferred")], "case_id int, status string")).collect()
    assert packets.exported_labels(cases, frame(spark, [(1, "frozen"), (2, "frozen")], "case_id int, status string")).count() == 2


def test_limits_of_archives_and_packets(spark):
    files = frame(spark, [("a", "xx"), ("/b", "x"), ("c", "x" * 50), ("", "x"), (None, None)], "path string, content string")
    assert sorted((r.path or "", r.status) for r in packets.safe_files(files, 5, 100, 10).collect()) == [("", "unsafe_path"), ("", "unsafe_path"), ("/b", "unsafe_path"), ("a", "kept"), ("c", "too_large")]
    for bad in ((0, 100), (5, 1)):
        with pytest.raises(Exception, match="exceeds its limits"):
            packets.safe_files(files, *bad, 10).collect()
    with pytest.raises(Exception, match="exceeds its limits"):
        context.packet_files(files, "head", most_files=1).collect()


def test_repositories_and_cases_on_disk(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "repo" / "pom.xml").write_text("<p/>")
    rows = context.repository_files(spark, str(tmp_path / "repo"))
    assert sorted(r.path for r in rows.collect()) == ["pom.xml", "src/a.py"]
    assert sorted((r.path, r.status) for r in context.archive(spark, str(tmp_path / "repo")).collect()) == [("pom.xml", "kept"), ("src/a.py", "kept")]
    built = context.build_modules(rows.withColumn("repo", F.lit("r")), "repo").first()
    assert (built.system, built.module, built.descriptors) == ("MAVEN", "", "pom.xml")
    cases = frame(spark, [("a", "x"), ("b", "x"), ("c", "y")], "id string, source string")
    out = str(tmp_path / "cases")
    assert sorted(map(tuple, context.write_cases(cases, out, "source").collect())) == [("x", 2), ("y", 1)]
    with pytest.raises(FileExistsError):
        context.write_cases(cases, out, "source")
    assert replay_cases(spark, out, "id string, source string", "id").count() == 3
    with pytest.raises(ValueError, match="more than once"):
        replay_cases(spark, out, "id string, source string", "source")
    for key in ("k1", "k2"):
        save_snapshot(cases.filter(F.col("source") == ("x" if key == "k1" else "y")), str(tmp_path / "snap"), key)
    save_snapshot(cases.limit(1), str(tmp_path / "snap"), "k2")
    assert (load_snapshot(spark, str(tmp_path / "snap"), "k1").count(), load_snapshot(spark, str(tmp_path / "snap"), "k2").count()) == (2, 1)


def test_holdouts_fail_if_short(spark):
    body = "\n".join(f"call{k}();" for k in range(70))
    files = frame(spark, [("r", "c", f"p{k}", body) for k in range(3)] + [("r", "c", "short", "x();")], "repository string, commit_sha string, path string, content string")
    assert evaluation.holdout(files, "v1", 2).count() == 2
    with pytest.raises(Exception, match="eligible holdout files 3 < requested 4"):
        evaluation.holdout(files, "v1", 4).collect()


def test_calls_without_type_arguments(spark):
    rows = frame(spark, [("a.B<T>#<init>(T,int)",), ("a.M#put(java.util.Map<K,java.util.List<V>>,V)",), ("a.B#get()",), ("plain",), (None,)], "k string")
    assert [r.c for r in rows.select(evaluation.canonical_call(F.col("k")).alias("c")).collect()] == ["a.B#<init>(java.lang.Object,int)", "a.M#put(java.util.Map,java.lang.Object)", "a.B#get()", "plain", None]


def test_empty_tables(spark):
    none = lambda schema: frame(spark, [], schema)
    assert packets.truth_gate(none("repository string, expected long, actual long, correct long")).first().failures == "repositories,pooled_precision"
    assert evaluation.review_queue(none("a int"), none("a int"), ["a"], 2).count() == 0
    assert review.interleaved(none("k int, p boolean"), "p", "k").count() == 0
    assert review.quota_sample(none("s string, k int"), "s", "k", 5).count() == 0
    assert evaluation.fingerprint_of(none("a int")).first().n_rows == 0
    assert jobs.replay_leases(none("id int, seq int, kind string, generation int, ts long")).count() == 0
    assert policy.change_summary(none("g int, k int, path string, additions int, deletions int"), "g", "k").count() == 0


def test_fingerprints_of_tables(spark):
    rows = frame(spark, [(1, "a"), (2, None), (1, "a")], "k int, v string")
    one = evaluation.fingerprint_of(rows).first()
    assert one.n_rows == 3 and evaluation.fingerprint_of(rows.orderBy(F.desc("k")).repartition(3)).first() == one
    assert evaluation.fingerprint_of(rows.distinct()).first().fingerprint != one.fingerprint
    assert evaluation.fingerprint_of(rows.fillna("")).first().fingerprint != one.fingerprint


def test_scalars(spark):
    row = frame(spark, [("x/.env", "a/b.TAR.GZ", "```\n{}\n```", "z" * 301)], "p string, q string, j string, e string").select(T.extension_of(F.col("p")), T.extension_of(F.col("q")), T.folder_of(F.col("q")), T.base_name(F.col("q")), T.embedded_json(F.col("j")), F.length(T.evidence_id(F.col("e")))).first()
    assert tuple(row) == ("", ".gz", "a", "b.TAR.GZ", "{}", 80)


def test_relations_from_outside_are_checked(spark, tmp_path):
    edge = SCHEMAS["code_edges"]
    good = frame(spark, [("s", "a", "b", "CALLS", 0.5, "p", 3)], edge)
    assert conforming(good.withColumn("extra", F.lit(1)), "code_edges").columns == good.columns and conforming(good, "code_edges").count() == 1
    with pytest.raises(ValueError, match="needs confidence as double"):
        conforming(good.withColumn("confidence", F.lit("x")), "code_edges")
    with pytest.raises(ValueError, match="needs to_key"):
        conforming(good.drop("to_key"), "code_edges")
    for bad in (("s", None, "b", "CALLS", 0.5, "p", 3), ("s", "a", "b", "CALLS", 1.5, "p", 3), ("s", "a", "b", "CALLS", None, "p", 3)):
        with pytest.raises(Exception, match="breaks its rule"):
            conforming(frame(spark, [bad], edge), "code_edges").collect()
    (tmp_path / "f.json").write_text('{"path": "a", "status": "added", "additions": 1, "deletions": 0, "patch": "x"}\n\n{"path": "b"}\n')
    assert sorted(r.path for r in relation(spark, str(tmp_path / "f.json"), "changed_files").collect()) == ["a", "b"]
    (tmp_path / "g.json").write_text('{"path": "a", "additions": "many"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        relation(spark, str(tmp_path / "g.json"), "changed_files").collect()


def test_only_ready_indexes_are_read(spark, tmp_path):
    children = frame(spark, [("a",), ("b",)], "stable_key string")
    for key, status in (("k1", "ready"), ("k2", "running")):
        save_index(spark, frame(spark, [(status,)], "status string"), children, str(tmp_path), key)
    save_index(spark, frame(spark, [("ready",)], "status string"), children.limit(1), str(tmp_path), "k1")
    assert (load_ready(spark, str(tmp_path), "k1").count(), load_ready(spark, str(tmp_path), "k2").count()) == (1, 0)


def test_status_counts_on_a_stream(spark, tmp_path):
    spark.range(40).selectExpr("if(id % 4 = 0, 'failed', 'completed') AS status", "timestamp_seconds(id * 3600) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("status string, ts timestamp").parquet(str(tmp_path / "in"))
    query = intake.status_counts(stream, "status", "ts").writeStream.outputMode("complete").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.window_start.day, r.status): r.n for r in spark.table("statuses").collect()} == {(1, "failed"): 6, (1, "completed"): 18, (2, "failed"): 4, (2, "completed"): 12}


def test_comments_and_quotes_of_a_policy():
    text = "rules:\n  - id: a\n    description: don't do # x\n  - id: 'b # c' # note\n    description: \"it's # fine\" # more\ninclude: ['x # y', z] # z\n"
    assert policy.read_yaml(text) == {"rules": [{"id": "a", "description": "don't do"}, {"id": "b # c", "description": "it's # fine"}], "include": ["x # y", "z"]}
