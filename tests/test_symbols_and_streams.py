from patchloom.operators import symbols
from patchloom.streaming import intake

JAVA = "public class A {\n  void run(int a, Map<String, Integer> b) {\n    helper(a); // other(a)\n    missing(b);\n  }\n  private void helper(int a) { count += a; }\n}\nclass B { }\n"
PY = "class Outer:\n    def one(self):\n        return two()\n\n    # note\n    def _hidden(self): pass\n\ndef two():\n    return 1\n"


def test_java(spark):
    files = spark.createDataFrame([("src/A.java", JAVA), ("notes.txt", "x"), ("b.go", None)], "path string, content string")
    rows = {r.stable_key: r for r in symbols.extract_symbols(files).collect()}
    assert set(rows) == {"java:src/A.java:file:$module", "java:src/A.java:class:A", "java:src/A.java:method:A.run/2", "java:src/A.java:method:A.helper/1", "java:src/A.java:class:B"}
    assert (rows["java:src/A.java:class:A"].start_line, rows["java:src/A.java:class:A"].end_line) == (1, 7) and rows["java:src/A.java:method:A.run/2"].end_line == 5
    calls = {(r.from_key.split(":")[-1], r.to_key.split(":")[-1], r.confidence, r.source_line) for r in symbols.extract_calls(files).collect()}
    assert ("A.run/2", "A.helper/1", 0.9, 3) in calls and ("A.run/2", "missing", 0.4, 4) in calls and not any("other" in x[1] for x in calls)


def test_python_go_ruby():
    found = {x[0].split(":", 2)[2]: x for x in symbols.parse("m.py", "python", PY)[0]}
    assert set(found) == {"file:$module", "class:Outer", "method:Outer.one/1", "method:Outer._hidden/1", "function:two/0"}
    assert found["class:Outer"][5] == 7 and found["method:Outer.one/1"][5] == 5 and not found["method:Outer._hidden/1"][8]
    go = symbols.parse("m.go", "go", "func (s *Server) Run(a int) {\n}\ntype Server struct {\n}")[0]
    assert [x[0].split(":", 2)[2] for x in go[1:]] == ["method:Server.Run/1", "type:Server"]


def test_arity():
    assert [symbols.arity(x) for x in ("f()", "f(a, b)", "f(Map<K, V> m, int[] x)", "f", "f( )")] == [0, 2, 2, 0, 0]


def test_streams_end_and_agree(spark, tmp_path):
    spark.range(60).selectExpr("id % 20 AS key", "timestamp_seconds(id * 7) AS ts", "id % 3 AS client", "id").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key long, ts timestamp, client long, id long").parquet(str(tmp_path / "in"))
    for k, (frame, mode) in enumerate(((intake.first_deliveries(stream(), "key", "ts"), "append"), (intake.requests_by_window(stream(), "client", "ts", 2), "complete"))):
        query = frame.writeStream.outputMode(mode).format("memory").queryName(f"t{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        rows = spark.table(f"t{k}").collect()
        assert (len(rows) == 20 and len({r.key for r in rows}) == 20) if k == 0 else (sum(r.requests for r in rows) == 60 and all(r.refused == max(0, r.requests - 2) for r in rows))
