"""Tests of the third round's findings; each fails on the code before its finding was mended."""

import random

from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import evaluation, graph, impact, packets, review, rules, symbols
from patchloom.plans import catalog


def test_nearby_lines_are_never_broadcast(spark):
    # lines come out of a small table by explosion, so its size says nothing of theirs
    lines = spark.range(50).select(F.concat("id", F.lit("/m.go")).alias("path"), F.explode(F.array(*[F.struct(F.lit(n).alias("right_line"), F.lit(c).alias("content")) for n, c in ((10, "resp, err := get()"), (14, "defer resp.Body.Close()"))])).alias("l")).select("path", "l.*", F.lit("added").alias("kind"))
    found = rules.unguarded_close(lines, True)
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_module_links_hold_for_rows_in_any_order(spark):
    # each reading of the edges gives them in another order, as fetched shuffle blocks do
    def mixed(batches):
        for batch in batches:
            yield batch.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 30))

    rows = [(str(k), f"external:./f{k}#fn", 0.5, "src/user.ts") for k in range(300)] + [(f"null{k}", f"external:./src/f{k}#fn", 0.5, None) for k in range(5)]
    edges = spark.createDataFrame(rows, "id string, to_key string, confidence double, source_path string").coalesce(1).mapInPandas(mixed, "id string, to_key string, confidence double, source_path string")
    files = [(f"file:{k}", "file", f"src/f{k}.ts", "$module", True, False) for k in range(300)] + [(f"sym:{k}", "function", f"src/f{k}.ts", "fn", True, False) for k in range(0, 300, 2)]
    symbols = spark.createDataFrame(files, "stable_key string, kind string, path string, name string, exported boolean, is_default boolean")
    found = {r["id"]: (r["to_key"], r["confidence"]) for r in graph.link_modules(edges, symbols).collect()}
    at = lambda i: int(i.removeprefix("null"))
    assert found == {i: (f"sym:{at(i)}", 0.9) if at(i) % 2 == 0 else (t, 0.5) for i, t, _, _ in rows}


def test_word_boundaries_are_ascii(spark):
    # as in RE2, Go and JavaScript, a letter such as é ends a word
    lines = spark.createDataFrame([("a.fr", 1, "laéi 123"), ("b.fr", 1, "lat 123"), ("c.fr", 1, "éla 123"), ("d.fr", 1, "la 123")], "path string, right_line int, content string")
    assert {r["path"] for r in rules.remote_in_transaction(lines, "[0-9]{3}", r"\b(the|der|la)\b").collect()} == {"a.fr", "c.fr", "d.fr"}
    added = spark.createDataFrame([("a.ts", 1, "éeval(x)"), ("b.ts", 1, "xeval(x)")], "path string, right_line int, content string")
    assert [r["path"] for r in rules.rule_candidates(added).collect()] == ["a.ts"]


def test_clean_texts_are_those_that_redaction_leaves(spark):
    # the signs that stand before the patterns lose no secret
    bits = ["password", "token", "Bearer ", "bearer\t", "BEARER", ":", "=", " ", "[REDACTED]", "abcdefgh12", "-----BEGIN X-----", "-----END X-----", "\n", ";", "é", "API_KEY", "x" * 30]
    draw = random.Random(4)
    texts = [None, "", *["".join(draw.choices(bits, k=draw.randint(1, 7))) for _ in range(3000)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_clean(F.col("t")).alias("a"), (T.redact(F.col("t")) == F.coalesce("t", F.lit(""))).alias("b"))
    assert rows.filter("NOT (a <=> b)").count() == 0 and rows.filter("a").count() not in (0, 3002)


def test_parsed_files_are_dealt_over_all_cores(spark, tmp_path):
    # A small table of parts is one split, so one task would parse all files
    spark.range(200).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for files in (catalog.families._sources(spark, str(tmp_path)), catalog.languages._files(spark, str(tmp_path))):
        assert symbols.extract_symbols(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_conflicts_are_counted_in_one_exchange_of_many_tasks(spark):
    # one exchange by the facts' key, of a number of tasks that grows with the scan's
    facts = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (None, 1), (None, 2)], "k int, r int").repartition(3)
    found = evaluation.conflicts(facts, ["k"], "r", 2)
    assert tuple(found.first()) == (3, 1)
    assert f"hashpartitioning(k#{_plan(found).split('hashpartitioning(k#')[1].split(',')[0]}, {3 * evaluation.SHARES})" in _plan(found) and _plan(found).count("hashpartitioning(k") == 1


def test_reversed_fixes_neither_sort_nor_window(spark):
    # F8: files' rows are never sorted; lines before a hunk, names, comments, brackets and test files say nothing
    body = {"says": "@@ -1 +1 @@\n-x", "bracket": "@@ -1 +1 @@\n-}", "before": "-x\n@@ -1 +1 @@\n ", "name": "@@ -1 +1 @@\n---x", "comment": "@@ -1 +1 @@\n-  // x", "nohunk": "-x", "null": None}
    files = spark.createDataFrame([(k, "a_test.go" if k == "test" else "a.go", "modified", 1, 2, p) for k, p in {**body, "test": body["says"]}.items()], "change_id string, path string, status string, additions int, deletions int, patch string")
    changes = spark.createDataFrame([(k, True, False, "fix bug", "") for k in [*body, "test"]], "change_id string, merged boolean, bot boolean, title string, labels string")
    found = packets.reverse_fixes(changes, files)
    assert [tuple(r) for r in found.collect()] == [("says", "a.go", 2, 1, "@@ -1 +1 @@\n+x")]
    assert "Window" not in _plan(found) and "ShuffledHashJoin" in _plan(found)


def test_two_sets_meet_by_grouping(spark):
    # no join, and null keys equal none of the other set, as in a join
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    a, b = rows(("x", 1), ("x", 1), (None, 1), ("y", 2), ("z", None)), rows(("x", 1), (None, 1), ("w", 3), ("z", None))
    both = evaluation.two_sets(a, b, ["k", "v"], "a", "b")
    assert "Join" not in _plan(evaluation.agreement(a, b, ["k", "v"])) and "Join" not in _plan(review.truth_set(a, b, ["v"], "k"))
    want = a.distinct().withColumn("a", F.lit(True)).join(b.distinct().withColumn("b", F.lit(True)), ["k", "v"], "full_outer")
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))
    assert tuple(evaluation.agreement(a, b, ["k", "v"]).first())[:3] == (1, 3, 3)


def test_few_buckets_are_written_by_many_tasks(spark, tmp_path):
    # a bucket's rows are shared out, and each file still holds rows of one bucket
    from patchloom.sources import graphs

    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("stable_key"))
    graphs.publish(spark, str(tmp_path), "g", {"symbols": rows}, 8)
    found = graphs.opened(spark, str(tmp_path), "g", "symbols")
    assert found.count() == 5000
    at = found.select(F.input_file_name().alias("f"), F.pmod(F.hash("stable_key"), F.lit(8)).alias("b")).groupBy("f").agg(F.countDistinct("b").alias("n")).agg(F.count("*"), F.max("n")).first()
    assert at[0] == graphs.LEAST_TASKS and at[1] == 1


def test_search_moves_symbols_not_edges(spark, monkeypatch):
    # edges are dealt by their target once, not at each level again
    plans, own = [], impact.saved

    def saved(frame, name):
        plans.extend([frame._jdf.queryExecution().executedPlan().toString()] if name == "level" else [])
        return own(frame, name)

    monkeypatch.setattr(impact, "saved", saved)
    edges = spark.createDataFrame([(f"s{k + 1}", f"s{k}", "CALLS", 1.0, k) for k in range(5)], "from_key string, to_key string, type string, confidence double, ord long")
    found = impact.search(spark.createDataFrame([("s0",)], "stable_key string"), edges, 3)
    assert {(r.impacted_key, r.depth) for r in found.collect()} == {("s1", 1), ("s2", 2), ("s3", 3)}
    assert len(plans) == 3 and all("Bucketed: true" in p and p.count("hashpartitioning(at#") == 1 for p in plans)


def test_packet_facts_are_dealt_once(spark):
    # one exchange of the facts for all sets of both tools; places without any name have no facts
    facts = spark.createDataFrame([("a", 1, "c", "t"), ("a", 1, "c", "u"), ("b", 1, "c", "t"), (None, 1, "c", "t")], "source_path string, line int, from_key string, to_key string")
    lines = spark.createDataFrame([("a", k, f"l{k}") for k in range(1, 5)], "path string, line int, content string")
    queue = facts.select("source_path", "line").unionByName(spark.createDataFrame([("z", 9)], "source_path string, line int"))
    rows = packets.packet_items(queue, facts, facts.filter("to_key = 't'"), lines)
    got = {r.source_path: (r.line, r.kind, r.adapter_targets, r.oracle_targets, r.excerpt) for r in rows.collect()}
    assert got == {"a": (1, "tool_disagreement", ["t", "u"], ["t"], "l1\nl2\nl3"), "b": (1, "agreement_sample", ["t"], ["t"], ""), None: (1, "agreement_sample", [], [], ""), "z": (9, "agreement_sample", [], [], "")}
    sets = facts.select("*", F.lit(True).alias("adapter"), F.lit(True).alias("oracle"), F.lit(True).alias("queued"))
    plan = packets.told_items(sets, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("collect_set") == 4


def test_incremental_edges_stay_in_their_buckets(spark, tmp_path):
    # both sides' symbols come to the stored edges; only the last distinct moves edges
    for name in ("customer", "orders", "part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(500).write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = catalog.QUERIES["incremental_edges"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and "SortMergeJoin" not in plan
    assert [x for x in plan.split("\n") if "Exchange hashpartitioning(to_key" in x] == []


def test_stale_runs_of_one_stream_hold_one_state(spark, tmp_path):
    # no join of two streams; same rows as the join, and as a plain reading, in any order and with rows delivered again
    from patchloom.plans.streams import replayed
    from patchloom.streaming import machines

    draw = random.Random(10)
    rows = [(k, draw.choice([1, 2, 3, None]), draw.randint(0, 400), draw.randint(0, 30)) for k in range(150)] + [(200, 9, 0, 30), (201, 9, 30, 30), (202, 9, 59, 30), (203, 9, 59, 30), (204, 9, 60, 0), (205, 9, 95, 90), (206, 9, 126, 30)]
    runs = spark.createDataFrame([*rows, *rows[:40]], "id long, pull long, d int, days int").select("id", "pull", F.expr("timestamp_seconds(86400 * d)").alias("ts"), F.expr("timestamp_seconds(86400 * (d + days))").alias("done"))
    want = {}
    for i, pull, d, days in rows:
        later = [e for j, other, e, _ in rows if pull is not None and other == pull and (e, j) > (d, i)]
        want[i] = bool(later) and min(later) < d + days and min(later) <= d + 30
    for periods in (1, 3):
        run = lambda session, stream, late: machines.stale_runs(stream, None, ["pull"], "30 days", late, periods)  # noqa: B023, E731
        one = replayed(runs, "ts", run).filter("id IS NOT NULL").collect()
        assert {r.id: r.stale for r in one} == want and len(one) == len(want) and 0 < sum(want.values()) < len(want)
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path))
    plan = machines.stale_runs(stream, None, ["pull"], "30 days")._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "Deduplicate" not in plan and plan.count("Aggregate") == 1


def test_phase_gate_deals_cases_once(spark):
    # one grouping by case, and no join but of single rows; held against a plain reading, with repeated cases and nulls
    draw = random.Random(14)
    some = lambda *x: draw.choice(x)
    cases = [(some(*range(40), None), some(*["p"] * 20, "q"), some(1, *[2] * 20, None), some("r0", "judge", "judge", "", None), some(*[9] * 20, 5, None), some(0, 0, 1, None)) for _ in range(60)]
    reviews = [(some(*range(44), None), some("r0", "r1", "r2", None), some(*[5] * 30, 1, 9, None), some(*["p"] * 30, "q", None), some(*[2] * 30, 7, None)) for _ in range(160)]
    causes = [(some(*range(44), None), some("a", "b", "c", "d", None)) for _ in range(30)]
    sessions = [(some(*range(44), None), some("r0", None), some("assisted", "control", None), some(None, "late")) for _ in range(90)]

    def bad(r, c):  # null is bad, unless another reason is known
        fits = [(a, b, ok) for a, b, ok in ((r[3], c[1], lambda x, y: x == y), (r[2], c[2], lambda x, y: x >= y), (r[4], r[2], lambda x, y: x <= y), (c[4], r[2], lambda x, y: x > y))]
        return not all(a is not None and b is not None and ok(a, b) for a, b, ok in fits)

    valid = []
    for c in cases:
        same, of = [x for x in cases if x[0] == c[0] is not None], [r for r in reviews if r[0] == c[0] is not None]
        mine = [x[1] for x in causes if x[0] == c[0] is not None]
        own = any(r[1] == x[3] is not None for r in of for x in same)
        valid.append(len({r[1] for r in of} - {None}) >= 2 and not any(bad(r, x) for r in of for x in same) and not ((c[5] or 0) > 0 and own) and len(mine) == len(set(mine) - {None}))
    ids = [c[0] for c, ok in zip(cases, valid, strict=True) if ok]
    n = [sum(x[0] == k is not None for x in causes) for k in ids]
    timed = [x[2] for x in sessions if x[3] is None]
    keys = [x[:3] for x in sessions]
    want = (len(cases) - len(ids), len(ids), sum(k > 0 for k in n), sum(n), len(ids), sum(bool(c[3]) for c, ok in zip(cases, valid, strict=True) if ok), len(timed), timed.count("assisted"), timed.count("control"), sum(x[0] not in ids for x in sessions), sum(keys.count(k) > 1 for k in set(keys)), sum(ids.count(k) > 1 for k in set(ids)))
    frames = [spark.createDataFrame(x, s) for x, s in ((cases, "case_id int, packet_id string, frozen_at int, adjudicated_by string, adjudicated_at int, conflict_count int"), (reviews, "case_id int, reviewer_id string, submitted_at int, packet_id string, calibrated_at int"), (causes, "case_id int, root_cause_id string"), (sessions, "case_id int, reviewer_id string, arm string, excluded_reason string"))]
    gate = packets.phase_gate(*frames)
    assert tuple(gate.first())[:12] == want and want[1] > 3 and want[11] > 0
    assert _plan(gate).count("Exchange hashpartitioning(case_id") == 2 and "SortMergeJoin [case_id" not in _plan(gate)


def test_change_groups_tie_short_keys_in_tasks_by_edges(spark, monkeypatch):
    # components take numbers, not paths, and make edges distinct in tasks that grow in number with them; groups are named by the smallest path
    from patchloom.operators import components as stars

    plans, own = [], stars.saved

    def saved(frame, name):
        plans.append((name, _plan(frame)))
        return own(frame, name)

    monkeypatch.setattr(stars, "saved", saved)
    monkeypatch.setattr(stars, "TASK_EDGES", 20)
    monkeypatch.setattr(stars, "HASHED_NODES", 5)
    files = spark.createDataFrame([*[(f"part:{k}", k) for k in range(1, 121)], (None, 900), ("nokey", None)], "path string, k long")
    draw = random.Random(12)
    members = [(t, draw.randint(1, 125)) for t in range(50) for _ in range(draw.randint(1, 3))] + [(None, 1), (None, 2), (70, 900), (70, 3), (71, 900), (71, 4), (72, 9), (72, 9), (72, 10), (73, None)]
    group = {k: {k} for k in range(1, 121)}
    for t, a in members:
        for other, b in members:
            if t is not None and t == other and a in group and b in group and group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[b]:
                    group[k] = group[a]
    got = review.tied_groups(files, spark.createDataFrame(members, "t long, k long"), "t", "k").collect()
    assert {r.path: r.group for r in got} == {f"part:{k}": min(f"part:{x}" for x in group[k]) for k in group} and len(got) == 120
    assert all("SortAggregate" not in p for _, p in plans)
    dealt = [int(p.split("hashpartitioning(u#")[1].split("), REPARTITION_BY_NUM")[0].split(", ")[-1]) for name, p in plans if name == "stars" and "REPARTITION_BY_NUM" in p and "hashpartitioning(u#" in p]
    assert max(dealt) > 1 and any("ShuffledHashJoin" in p for _, p in plans)
