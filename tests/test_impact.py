"""Impact at any depth against a plain search, and graphs stored for their joins."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import graph, impact
from patchloom.sources import graphs

EDGE = "from_key string, to_key string, type string, confidence double, ord long"


def round3(x):
    return float(f"{x:.3f}")


def plain(changes, edges, depth, weights=None, types=(), cap=None, over_all=False, trim=False, known=None):
    """A queue, as the analysers have it: (change, impacted, depth, score, path, edges)."""
    out = []
    for change in changes:
        queue, seen, mine = [(change, 0, [change], [], 1.0)], {change}, []
        total = lambda: len(out) + len(mine) if over_all else len(mine)  # noqa: B023, E731
        while queue and (cap is None or total() < cap):
            key, level, path, ords, score = queue.pop(0)
            if level == depth:
                continue
            for a, b, kind, confidence, n in sorted(edges, key=lambda e: e[4]):
                if b != key or a in seen or (types and kind not in types) or (known is not None and a not in known):
                    continue
                seen.add(a)
                gain = round3(score * (weights or {}).get(kind, 1.0) * confidence * (1 if level == 0 else 0.55))
                mine.append((change, a, level + 1, gain, [a, *path], [n, *ords]))
                queue.append((a, level + 1, [a, *path], [n, *ords], gain))
        if trim:
            mine = sorted(mine, key=lambda r: (-r[3], r[1]))[:cap]
        out += mine
    return sorted(out)


def rows(found):
    return sorted((r.change_key, r.impacted_key, r.depth, r.score, list(r.path), list(r.edge_ords)) for r in found.collect())


def random_graph(seed, n=14, m=45):
    rnd = random.Random(seed)
    return [(f"s{rnd.randrange(n):02d}", f"s{rnd.randrange(n):02d}", rnd.choice(("CALLS", "IMPORTS", "READS")), rnd.choice((0.5, 0.9, 1.0)), k) for k in rnd.sample(range(500), m)]


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_any_depth_with_cycles(spark, depth):
    edges = random_graph(depth)
    keys = [f"s{k:02d}" for k in range(0, 14, 3)] + ["nowhere"]
    changes = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "stable_key string")
    got = impact.search(changes, spark.createDataFrame([*edges, (None, "s00", "CALLS", 1.0, 900), ("s01", None, "CALLS", 1.0, 901)], EDGE).filter("from_key IS NOT NULL"), depth, graph.WEIGHTS)
    assert rows(got) == plain(keys, edges, depth, graph.WEIGHTS)


def test_caps(spark):
    edges = random_graph(7, 20, 90)
    keys = [f"s{k:02d}" for k in range(0, 20, 2)]
    changes = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "stable_key string, place int")
    frame = spark.createDataFrame(edges, EDGE)
    for cap in (1, 4, 9):
        assert rows(impact.search(changes, frame, 3, cap=cap)) == plain(keys, edges, 3, cap=cap)
        assert rows(impact.search(changes, frame, 3, cap=cap, trim=True)) == plain(keys, edges, 3, cap=cap, trim=True)
    for cap in (1, 17, 60):
        assert rows(impact.search(changes, frame, 3, types=("CALLS",), cap=cap, over_all=True)) == plain(keys, edges, 3, types=("CALLS",), cap=cap, over_all=True)
    known = spark.createDataFrame([(f"s{k:02d}",) for k in range(12)], "stable_key string")
    assert rows(impact.search(changes, frame, 4, known=known)) == plain(keys, edges, 4, known={f"s{k:02d}" for k in range(12)})


def test_each_side_in_its_own_graph(spark):
    edges = spark.createDataFrame([("base", "a", "t", "CALLS", 1.0, 1), ("head", "b", "t", "CALLS", 1.0, 1), ("head", "c", "b", "CALLS", 1.0, 2)], f"graph string, {EDGE}")
    changes = spark.createDataFrame([("t", "head"), ("t", "base")], "stable_key string, graph string")
    got = impact.search(changes.filter("graph = 'head'"), edges, 2)
    assert {r.impacted_key for r in got.collect()} == {"b", "c"}
    assert sorted(r.impacted_key for r in impact.search(changes, edges, 2).collect()) == ["a", "b", "c"]


def test_order_of_any_type(spark):
    edges = spark.createDataFrame([("a", "t", "CALLS", 0.4, "z"), ("a", "t", "CALLS", 0.9, "y"), ("b", "a", "CALLS", 1.0, "a"), ("b", "t", "READS", 0.1, "zz")], "from_key string, to_key string, type string, confidence double, path string")
    ranked = edges.withColumn("ord", F.struct((-F.col("confidence")).alias("first"), "path"))
    got = impact.search(spark.createDataFrame([("t",)], "stable_key string"), ranked, 2)
    assert sorted((r.impacted_key, r.depth, r.score) for r in got.collect()) == [("a", 1, 0.9), ("b", 1, 0.1)]


def test_empty_and_wrong_input(spark):
    none = spark.createDataFrame([], EDGE)
    assert impact.search(spark.createDataFrame([("t",)], "stable_key string"), none, 3, cap=2).count() == 0
    assert impact.search(spark.createDataFrame([], "stable_key string"), none, 3).count() == 0
    for bad in ({"depth": 0}, {"depth": 2, "over_all": True}):
        with pytest.raises(ValueError):
            impact.search(none, none, **bad)


def stored(spark, tmp_path, edges, key="k", **more):
    symbols = spark.createDataFrame([("a", "A"), ("b", "B")], "stable_key string, qualified_name string")
    return graphs.publish(spark, str(tmp_path), key, {"edges": spark.createDataFrame(edges, EDGE), "symbols": symbols}, 4, **more)


def test_stored_graph_is_read_without_an_exchange_of_edges(spark, tmp_path):
    edges = random_graph(11, 60, 400)
    stored(spark, tmp_path, edges)
    changes = spark.createDataFrame([(f"s{k:02d}",) for k in range(0, 60, 7)], "stable_key string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        opened = graphs.opened(spark, str(tmp_path), "k", "edges")
        got = graph.impact_paths(changes, opened, graph.WEIGHTS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = graph.impact_paths(changes, spark.createDataFrame(edges, EDGE), graph.WEIGHTS)
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scans = [k for k, line in enumerate(lines) if "Scan parquet" in line and "to_key" in line]
    assert scans and "Bucketed: true" in plan
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    for k in scans:  # from the scan up to the join that reads it
        above, at = k, depth(lines[k])
        while "Join" not in lines[above]:
            above -= 1
            if depth(lines[above]) < at:
                at = depth(lines[above])
                assert "Exchange" not in lines[above], "edges are dealt again"


def test_a_failed_version_leaves_the_old_one(spark, tmp_path):
    first = stored(spark, tmp_path, [("a", "b", "CALLS", 1.0, 1)], facts={"files": 3})
    broken = spark.range(1).select(F.raise_error(F.lit("no more")).cast("string").alias("stable_key"))
    with pytest.raises(Exception, match="no more"):
        graphs.publish(spark, str(tmp_path), "k", {"edges": spark.createDataFrame([("x", "y", "CALLS", 1.0, 1)], EDGE), "symbols": broken}, 4)
    assert graphs.manifest(spark, str(tmp_path), "k") == first and first["facts"] == {"files": 3}
    assert [r.from_key for r in graphs.opened(spark, str(tmp_path), "k", "edges").collect()] == ["a"]
    second = stored(spark, tmp_path, [("c", "b", "CALLS", 1.0, 1), (None, None, "CALLS", 1.0, 2)])
    assert second["version"] != first["version"] and sorted(str(r.from_key) for r in graphs.opened(spark, str(tmp_path), "k", "edges").collect()) == ["None", "c"]
    stored(spark, tmp_path, [("d", "b", "CALLS", 1.0, 1)], "other", status="building")
    assert graphs.opened(spark, str(tmp_path), "other", "edges") is None and graphs.opened(spark, str(tmp_path), "none", "edges") is None
    assert graphs.retire(spark, str(tmp_path)) == 2  # the first version and the failed one
    assert graphs.opened(spark, str(tmp_path), "k", "symbols").count() == 2 and graphs.retire(spark, str(tmp_path / "nowhere")) == 0
