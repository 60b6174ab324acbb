from pyspark.sql import functions as F

from patchloom.operators import diff, rules

PATCH = "intro\n@@ -8,4 +8,5 @@\n same\n-old\n+new\n+eval(x)\n\n+items.forEach(async i => 1)\n\\ No newline at end\n tail\n@@ -30 +31 @@\n-a\n+b"


def files(spark, patch=PATCH, path="src/a.ts"):
    return spark.createDataFrame([(path, patch)], "path string, patch string")


def test_line_map(spark):
    rows = [(r.kind, r.content, r.left_line, r.right_line) for r in diff.parse_patch(files(spark)).orderBy("pos").collect()]
    assert rows == [
        ("context", "same", 8, 8), ("deleted", "old", 9, None), ("added", "new", None, 9), ("added", "eval(x)", None, 10), ("added", "items.forEach(async i => 1)", None, 11),
        ("context", "tail", 10, 12), ("deleted", "a", 30, None), ("added", "b", None, 31),
    ]


def test_loose_map_counts_other_lines(spark):
    rows = {r.content: r.right_line for r in diff.parse_patch(files(spark), loose=True).collect()}
    assert rows["items.forEach(async i => 1)"] == 12


def test_reversed_twice_is_the_same(spark):
    once = files(spark).select(diff.reversed_patch(F.col("patch")).alias("patch"))
    assert once.first().patch.startswith("intro\n@@ -8,5 +8,4 @@\n same\n+old\n-new")
    assert once.select(diff.reversed_patch(F.col("patch"))).first()[0] == PATCH


def test_budget_by_line_charges_what_is_kept(spark):
    rows = spark.createDataFrame([(1, 1, "a", "12345\n678"), (1, 2, "b", "xxxxxxxxxx"), (1, 3, "c", "ab")], "g int, k int, path string, patch string")
    out = {r.path: r.kept_chars for r in diff.patch_budget_by_line(rows, "g", "k", 8).collect()}
    assert out == {"a": 6, "b": 0, "c": 2}  # the line end that a cut falls behind is kept and charged
    plain = {r.path: r.kept_chars for r in diff.patch_budget(rows, "g", "k", 12).collect()}
    assert plain == {"a": 9, "b": 3}


def test_rules_and_scopes(spark):
    added = lambda path, patch=PATCH: diff.added_lines(diff.parse_patch(files(spark, patch, path)))
    assert sorted((r.rule_id, r.line) for r in rules.rule_candidates(added("src/a.ts")).collect()) == [("concurrency/no-async-foreach", 11), ("security/no-eval", 10)]
    secret = '@@ -1 +1 @@\n+const password = "abcdefgh1"'
    assert rules.rule_candidates(added("src/a.ts", secret)).count() == 1
    assert rules.rule_candidates(added("tests/a.ts", secret)).count() == 0
    go = "@@ -1 +10,3 @@\n+tls.Config{InsecureSkipVerify: true}\n+json.Unmarshal(b, &x)\n+http.Get(u)"
    assert rules.rule_candidates(added("m.go", go)).count() == 3
    assert rules.rule_candidates(added("m_test.go", go)).count() == 0
    assert rules.rule_candidates(added("m_test.go", go), scoped=False).count() == 3


def test_close_before_check(spark):
    bad = "@@ -1 +1,3 @@\n+resp, err := http.Get(u)\n+defer resp.Body.Close()\n+x"
    good = "@@ -1 +1,4 @@\n+resp, err := client.Do(r)\n+if err != nil { return }\n+defer resp.Body.Close()"
    found = lambda p: [r.line for r in rules.unguarded_close(diff.parse_patch(files(spark, p, "m.go")), body=True).collect()]
    assert found(bad) == [2] and found(good) == []


def test_remote_call_near_transaction(spark):
    patch = "@@ -1 +1,3 @@\n+await db.transaction(async t => {\n+  await fetch(url)\n+})"
    assert [r.line for r in rules.remote_in_transaction(diff.added_lines(diff.parse_patch(files(spark, patch)))).collect()] == [2]
    far = "@@ -1 +1,3 @@\n+transaction()\n" + "+x\n" * 9 + "+fetch(url)"
    assert rules.remote_in_transaction(diff.added_lines(diff.parse_patch(files(spark, far)))).count() == 0
