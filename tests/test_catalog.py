"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os
import random

import duckdb
import pytest

from patchloom.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    mine = sorted(tuple(value(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(value(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    """Queries without SQL; their operators are held against plain versions in test_families."""
    got = catalog.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows and all(set(r.asDict()) == set(got.columns) for r in rows)


def test_change_groups_over_all_parts(spark, tmp_path):
    rnd = random.Random(9)
    lines = [(k, rnd.randint(1, 120)) for k in range(60) for _ in range(rnd.randint(1, 3))] + [(100, 7), (100, 999), (101, 999), (101, 8)]
    spark.createDataFrame([(k,) for k in range(1, 121)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    group = {k: {k} for k in range(1, 121)}
    for order, part in lines:
        for other, second in lines:
            if order == other and part in group and second in group and group[part] is not group[second]:
                group[part] |= group[second]
                for k in group[second]:
                    group[k] = group[part]
    want = {f"part:{k}": min(f"part:{x}" for x in group[k]) for k in group}
    assert {r.path: r.group for r in catalog.QUERIES["change_groups"](spark, str(tmp_path)).collect()} == want
