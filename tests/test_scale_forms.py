"""Components, spans, percentiles and quotas in the forms that hold no whole group in one task, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import intervals, packets, percentiles, review
from patchloom.operators.components import components


def plain_components(edges):
    name = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            name.setdefault(a, {a})
            name.setdefault(b, {b})
            if name[a] is not name[b]:
                name[a] |= name[b]
                for x in name[b]:
                    name[x] = name[a]
    return {a: min(group) for a, group in name.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(150):03d}", f"n{rnd.randrange(150):03d}") for _ in range(110)] + [("n000", "n000"), (None, "n001"), ("n002", None), ("n003", "n004"), ("n004", "n003")]
    found = components(spark.createDataFrame(edges, "u string, v string")).collect()
    assert {r.node: r.component for r in found} == plain_components(edges) and len(found) == len({r.node for r in found})


def test_a_long_path_and_one_crowded_node(spark):
    order = list(range(100_000))
    random.Random(3).shuffle(order)
    path = list(zip(order, order[1:], strict=False))
    star = [(500_000, 600_000 + k) for k in range(30_000)] + [(500_000, 499_999)]
    found = components(spark.createDataFrame(path + star, "u long, v long").repartition(4))
    counts = {r.component: r["count"] for r in found.groupBy("component").count().collect()}
    assert counts == {0: 100_000, 499_999: 30_002}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_blocks_are_few_and_cover(spark):
    rnd = random.Random(4)
    spans = [(0, 0), (0, 999_999), (1, 1_000_000), (5, 4), (-3, 4), (7, 7), (2**31 - 2, 2**31 - 1)] + [(a := rnd.randrange(1000), a + rnd.randrange(300)) for _ in range(60)]
    rows = spark.createDataFrame(spans, "a long, b long").withColumn("blocks", intervals.blocks(F.col("a"), F.col("b"))).collect()
    for r in rows:
        if not 0 <= r.a <= r.b:
            assert r.blocks == []
            continue
        parts = sorted((x.number << x.level, (x.number + 1 << x.level) - 1) for x in r.blocks)
        assert parts[0][0] == r.a and parts[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * max(1, math.ceil(math.log2(r.b - r.a + 2)))
    assert max(len(r.blocks) for r in rows) <= 40


def test_points_meet_the_spans_that_hold_them(spark):
    rnd = random.Random(5)
    points = [(k, rnd.choice("ab"), rnd.randrange(-5, 400)) for k in range(200)] + [(900, None, 5), (901, "a", None)]
    spans = [(k, rnd.choice("ab"), a := rnd.randrange(400), a + rnd.randrange(-2, 90)) for k in range(40)] + [(99, None, 0, 10)]
    got = intervals.holding(spark.createDataFrame(points, "p int, path string, line long"), "line", spark.createDataFrame(spans, "s int, path string, first int, last int"), ["path"], "first", "last")
    want = sorted((p, s) for p, path, line in points for s, other, first, last in spans if path is not None and path == other and line is not None and 0 <= first <= line <= last)
    assert sorted((r.p, r.s) for r in got.collect()) == want


def test_evidence_spans_need_all_their_lines(spark):
    patch = "@@ -1,6 +1,7 @@\n a\n+b\n+c\n d\n+e\n+f\n+g"
    files = spark.createDataFrame([("p", patch)], "path string, patch string")
    evidence = [(1, "p", "RIGHT", 2, 3), (2, "p", "RIGHT", 2, 4), (3, "p", "RIGHT", 5, 7), (4, "p", "RIGHT", 5, 1_000_000), (5, "q", "RIGHT", 2, 2), (6, "p", "LEFT", 2, 2), (7, "p", "RIGHT", 6, 6)]
    got = packets.diff_evidence_problems(spark.createDataFrame(evidence, "id int, path string, side string, start_line int, end_line int"), files)
    assert {r.id: r.problem for r in got.collect()} == {1: None, 2: "line_not_in_diff", 3: None, 4: "line_not_in_diff", 5: "unknown_path", 6: "line_not_in_diff", 7: None}


@pytest.mark.parametrize("buckets", [64, 4096])
def test_percentiles_of_any_values(spark, buckets):
    rnd = random.Random(6)
    values = {
        "near": [1.0 + k * 2**-52 for k in range(9)], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324], "inf": [math.inf, -math.inf, 3.0, math.inf], "nan": [math.nan, 1.0, math.nan],
        "one": [7.25], "ties": [2.0] * 500 + [3.0], "any": [rnd.choice((rnd.gauss(0, 1e6), rnd.random(), 0.0, -0.0)) for _ in range(700)], None: [1.5, 2.5],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("one", None), ("bare", None)]
    shares = {"low": 0.001, "p50": 0.5, "p95": 0.95, "all": 1.0}
    got = {r.v: r for r in percentiles.nearest_rank(spark.createDataFrame(rows, "v string, x double"), "x", shares, ["v"], buckets).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        order = sorted(vs, key=lambda v: (math.isnan(v), v))
        for name, p in shares.items():
            want, have = order[max(1, math.ceil(len(order) * p)) - 1], got[g][name]
            assert (math.isnan(want) and math.isnan(have)) or have == pytest.approx(round(want, 2) if abs(want) < 1e300 else want), (g, name)
    assert percentiles.nearest_rank(spark.createDataFrame(rows, "v string, x double").filter("v = 'any'"), "x", {"m": 0.5}, [], buckets).first().n == 700
    assert percentiles.nearest_rank(spark.createDataFrame([], "v string, x double"), "x", {"m": 0.5}, [], buckets).count() == 0


def test_quotas_send_on_no_more_than_the_target(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("kind"), F.col("id").alias("n")).filter("kind <> '2' OR n < 9").repartition(4)
    got = review.quota_sample(rows, "kind", "n", 30)
    assert sorted((r.kind, r.n) for r in got.collect()) == sorted([("0", 3 * k) for k in range(10)] + [("1", 3 * k + 1) for k in range(10)] + [("2", n) for n in (2, 5, 8)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit"), "each task keeps its first rows before the exchange"


def test_calls_in_scope_by_prefix(spark):
    facts = spark.createDataFrame([("p", "CALLS", True, k) for k in ("java:a.B#c", "java:a.", "java:a", "x", "java:b")] + [("q", "CALLS", True, "java:a.B"), ("p", "READS", True, "java:a.B"), ("p", "CALLS", False, "java:a.B"), ("p", "CALLS", True, None)], "source_path string, type string, type_resolved boolean, to_key string")
    got = packets.scoped_calls(facts, spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([("java:a.",), ("java:b",), ("java:b",), (None,)], "prefix string"))
    assert sorted(r.to_key for r in got.collect()) == ["java:a.", "java:a.B#c", "java:b"]
    assert packets.scoped_calls(facts, spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([], "prefix string")).count() == 0
