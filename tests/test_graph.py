import random

from patchloom.operators import evaluation, findings, graph, state

SYMBOL = "stable_key string, kind string, qualified_name string, signature string, content_hash string"
EDGE = "from_key string, to_key string, type string, confidence double, ord long"


def test_compare_and_move(spark):
    base = spark.createDataFrame([("a", "f", "m.a", "s", "1"), ("b", "f", "m.b", "s", "2"), ("x", "f", "m.x", "s", "9")], SYMBOL)
    head = spark.createDataFrame([("a", "f", "m.a", "s", "3"), ("c", "f", "m.c", "s", "4"), ("y", "f", "m.x", "s", "9")], SYMBOL)
    assert {r.stable_key: r.change for r in graph.compare_symbols(base, head).collect()} == {"a": "MODIFIED", "b": "DELETED", "c": "ADDED", "x": "DELETED", "y": "ADDED"}
    assert [(r.from_key, r.to_key, r.tier) for r in graph.moved_symbols(base, head).collect()] == [("x", "y", 1)]


def brute_paths(seed, edges, cap):
    """First path to each caller, breadth first, cap tested before each node's callers are taken."""
    seen, queue, out = {seed}, [(seed, 1.0, 0)], []
    while queue and len(out) < cap:
        node, score, depth = queue.pop(0)
        if depth == 2:
            continue
        for f, t, kind, c, _ in sorted(edges, key=lambda e: e[4]):
            if t == node and f not in seen:
                seen.add(f)
                s = round(score * (0.6 if kind == "IMPORTS" else 1.0) * c * (1 if depth == 0 else 0.55) + 1e-12, 3)
                out.append((f, depth + 1, s))
                queue.append((f, s, depth + 1))
    return sorted(out)


def test_impact_equals_breadth_first_search(spark):
    rnd = random.Random(4)
    for _ in range(6):
        edges = [(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", rnd.choice(["CALLS", "IMPORTS"]), rnd.choice([0.5, 0.8, 1.0]), k) for k in range(40)]
        changes = spark.createDataFrame([("n0",), ("n1",)], "stable_key string")
        for cap in (3, 200):
            got = graph.impact_paths(changes, spark.createDataFrame(edges, EDGE), graph.WEIGHTS, cap=cap).collect()
            for seed in ("n0", "n1"):
                assert sorted((r.impacted_key, r.depth, r.score) for r in got if r.change_key == seed) == brute_paths(seed, edges, cap)


def test_links_need_one_symbol(spark):
    edges = spark.createDataFrame([("x", "unresolved:a", 0.4), ("x", "unresolved:b", 0.4)], "from_key string, to_key string, confidence double")
    symbols = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "b")], "stable_key string, name string")
    assert sorted((r.to_key, r.confidence) for r in graph.link_unique_names(edges, symbols, 0.7).collect()) == [("k1", 0.7), ("unresolved:b", 0.4)]


def test_verification_reasons(spark):
    kinds = "ordinal int, rule_id string, category string, severity string, confidence double, path string, line int, excerpt string"
    rows = [(1, "r", "c", "high", 0.9, "a", 1, "x"), (2, "r", "c", "high", 0.9, "a", 1, "x"), (3, "r", "c", "high", 0.9, "../a", 1, "x"), (4, "r", "c", "high", 0.9, "a", 9, "x"), (5, "r", "c", "high", 0.9, "a", 2, "y"), (6, "r", "c", "high", 0.9, "a", 3, "q"), (7, "s", "c", "low", 0.9, "a", 1, "x")]
    right = spark.createDataFrame([("a", 1, "added", " x "), ("a", 2, "context", "y"), ("a", 3, "added", "z")], "path string, right_line int, kind string, content string")
    got = findings.verify(spark.createDataFrame(rows, kinds), right).orderBy("ordinal").collect()
    assert [r.rejection_reason for r in got] == [None, "duplicate", "unsafe_path", "line_not_in_diff", "evidence_not_added_line", "excerpt_mismatch", "below_publish_threshold"]


def test_counts_without_cases(spark):
    empty = spark.createDataFrame([], "k int")
    row = evaluation.set_counts(empty, empty, ["k"]).first()
    assert (row.tp, row.precision, row.precision_low, row.precision_high) == (0, None, 0.0, 1.0)


def test_budget_refusals_cost_nothing(spark):
    calls = spark.createDataFrame([(1, k, n) for k, n in enumerate([900, 900, 500, 200, 50, 50])], "g int, k int, n int")
    got = state.admit_by_budget(calls, "g", "k", "n", 4, 1500).orderBy("k").collect()
    assert [r.admitted for r in got] == [True, False, True, False, True, True]


def test_upsert_keeps_old_values(spark):
    old, new = (spark.createDataFrame(x, "k int, a string, b int") for x in ([(1, "x", 1), (2, "y", 2)], [(2, None, 5), (3, "z", 3)]))
    assert sorted(map(tuple, state.upsert(old, new, ["k"]).collect())) == [(1, "x", 1), (2, "y", 5), (3, "z", 3)]
