"""Registered queries of extraction in all thirteen languages, and of rules on their own patterns, from tables of files.

Each part is a file in one of the languages; beside its text stands what it declares and calls.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import policy, rules, symbols
from patchloom.plans import adapters as A
from patchloom.plans.catalog import query
from patchloom.sources.tables import table

#: A file of each language (# is the part's number) by its extension: text, its symbols (key, first line, last line, whether exported), its calls (from, to, line).
SOURCES = {
    "go": (
        "go",
        'package p\ntype Server# struct {\n}\nfunc (s *Server#) Run(a int) {\n\thelper#(a)\n}\nfunc helper#(x int) {\n}\n',
        (
            "file:$module 1 9 yes",
            "type:Server# 2 3 yes",
            "method:Server#.Run/1 4 6 yes",
            "function:helper#/1 7 8 no",
        ),
        (
            "method:Server#.Run/1 -> function:helper#/1 5",
        ),
    ),
    "typescript": (
        "ts",
        'export class Api# {\n}\nexport function load#(a, b) {\n  return parse#(a); // skip(b)\n}\nfunction parse#(x) {\n  return outside(x);\n}\n',
        (
            "file:$module 1 9 yes",
            "class:Api# 1 2 yes",
            "function:load#/2 3 5 yes",
            "function:parse#/1 6 8 no",
        ),
        (
            "function:load#/2 -> function:parse#/1 4",
            "function:parse#/1 -> unresolved:outside 7",
        ),
    ),
    "javascript": (
        "js",
        'export const make# = async (a) => {\n  use#(a);\n}\nfunction use#(b) {\n}\nclass Box# {\n}\n',
        (
            "file:$module 1 8 yes",
            "function:make#/1 1 3 yes",
            "function:use#/1 4 5 no",
            "class:Box# 6 8 no",
        ),
        (
            "function:make#/1 -> unresolved:async 1",
            "function:make#/1 -> function:use#/1 2",
        ),
    ),
    "java": (
        "java",
        'public class P# {\n  void run(int a, int b) {\n    helper(a);\n    missing(b);\n  }\n  private void helper(int a) { }\n}\n',
        (
            "file:$module 1 8 yes",
            "class:P# 1 7 yes",
            "method:P#.run/2 2 5 no",
            "method:P#.helper/1 6 6 no",
        ),
        (
            "class:P# -> method:P#.run/2 2",
            "class:P# -> method:P#.helper/1 3",
            "class:P# -> unresolved:missing 4",
            "class:P# -> method:P#.helper/1 6",
            "method:P#.run/2 -> method:P#.helper/1 3",
            "method:P#.run/2 -> unresolved:missing 4",
        ),
    ),
    "kotlin": (
        "kt",
        'class K# {\n  fun run(a: Int) {\n    helper(a)\n  }\n  private fun helper(a: Int) {\n  }\n}\n',
        (
            "file:$module 1 8 yes",
            "class:K# 1 8 yes",
            "method:K#.run/1 2 4 no",
            "method:K#.helper/1 5 6 no",
        ),
        (
            "class:K# -> method:K#.run/1 2",
            "class:K# -> method:K#.helper/1 3",
            "class:K# -> method:K#.helper/1 5",
            "method:K#.run/1 -> method:K#.helper/1 3",
        ),
    ),
    "python": (
        "py",
        'class Outer#:\n    def one(self):\n        return two#()\n\n    def _hidden(self): pass\n\ndef two#():\n    return 1\n',
        (
            "file:$module 1 9 yes",
            "class:Outer# 1 6 yes",
            "method:Outer#.one/1 2 4 yes",
            "method:Outer#._hidden/1 5 6 no",
            "function:two#/0 7 9 yes",
        ),
        (
            "class:Outer# -> method:Outer#.one/1 2",
            "class:Outer# -> function:two#/0 3",
            "class:Outer# -> method:Outer#._hidden/1 5",
            "method:Outer#.one/1 -> function:two#/0 3",
        ),
    ),
    "c": (
        "c",
        'struct node# {\n  int x;\n};\nint add#(int a, int b) {\n  return twice#(a);\n}\nstatic int twice#(int a) {\n  return a;\n}\n',
        (
            "file:$module 1 10 yes",
            "type:node# 1 3 yes",
            "function:add#/2 4 6 yes",
            "function:twice#/1 7 9 yes",
        ),
        (
            "function:add#/2 -> function:twice#/1 5",
        ),
    ),
    "cpp": (
        "cpp",
        'namespace n# {\nclass Box# {\n  int size(int a) {\n    return grow#(a);\n  }\n};\nint grow#(int a) {\n  return a;\n}\n}\n',
        (
            "file:$module 1 11 yes",
            "namespace:n# 1 10 yes",
            "class:n#.Box# 2 11 yes",
            "method:n#.Box#.size/1 3 5 yes",
            "method:n#.Box#.grow#/1 7 9 yes",
        ),
        (
            "namespace:n# -> method:n#.Box#.size/1 3",
            "namespace:n# -> method:n#.Box#.grow#/1 4",
            "namespace:n# -> method:n#.Box#.grow#/1 7",
            "class:n#.Box# -> method:n#.Box#.size/1 3",
            "class:n#.Box# -> method:n#.Box#.grow#/1 4",
            "class:n#.Box# -> method:n#.Box#.grow#/1 7",
            "method:n#.Box#.size/1 -> method:n#.Box#.grow#/1 4",
        ),
    ),
    "csharp": (
        "cs",
        'public class C# {\n  public int Run(int a) {\n    return Help(a);\n  }\n  private int Help(int a) {\n    return a;\n  }\n}\n',
        (
            "file:$module 1 9 yes",
            "class:C# 1 8 yes",
            "method:C#.Run/1 2 4 yes",
            "method:C#.Help/1 5 7 no",
        ),
        (
            "class:C# -> method:C#.Run/1 2",
            "class:C# -> method:C#.Help/1 3",
            "class:C# -> method:C#.Help/1 5",
            "method:C#.Run/1 -> method:C#.Help/1 3",
        ),
    ),
    "rust": (
        "rs",
        'pub struct Item# {\n  x: i32,\n}\nimpl Item# {\n  pub fn run(a: i32) {\n    help#(a);\n  }\n}\nfn help#(a: i32) {\n}\n',
        (
            "file:$module 1 11 yes",
            "type:Item# 1 3 yes",
            "implementation:Item# 4 8 no",
            "method:Item#.run/1 5 7 yes",
            "function:help#/1 9 10 no",
        ),
        (
            "implementation:Item# -> method:Item#.run/1 5",
            "implementation:Item# -> function:help#/1 6",
            "method:Item#.run/1 -> function:help#/1 6",
        ),
    ),
    "php": (
        "php",
        '<?php\nclass Page# {\n  public function show($a) {\n    return draw#($a); // old($a)\n  }\n}\nfunction draw#($a) {\n}\n',
        (
            "file:$module 1 9 yes",
            "class:Page# 2 9 yes",
            "method:Page#.show/1 3 5 yes",
            "method:Page#.draw#/1 7 8 yes",
        ),
        (
            "class:Page# -> method:Page#.show/1 3",
            "class:Page# -> method:Page#.draw#/1 4",
            "class:Page# -> method:Page#.draw#/1 7",
            "method:Page#.show/1 -> method:Page#.draw#/1 4",
        ),
    ),
    "ruby": (
        "rb",
        'module M#\n  class Job\n    def run(a)\n      help#(a)\n    end\n  end\nend\ndef help#(a)\nend\n',
        (
            "file:$module 1 10 yes",
            "module:M# 1 7 yes",
            "class:M#.Job 2 6 yes",
            "method:M#.Job.run/1 3 4 yes",
            "function:help#/1 8 8 yes",
        ),
        (
            "module:M# -> method:M#.Job.run/1 3",
            "module:M# -> function:help#/1 4",
            "class:M#.Job -> method:M#.Job.run/1 3",
            "class:M#.Job -> function:help#/1 4",
            "method:M#.Job.run/1 -> function:help#/1 4",
        ),
    ),
    "swift": (
        "swift",
        'public struct View# {\n  func body(a: Int) {\n    paint#(a)\n  }\n}\nfunc paint#(a: Int) {\n}\n',
        (
            "file:$module 1 8 yes",
            "type:View# 1 5 yes",
            "method:View#.body/1 2 4 no",
            "function:paint#/1 6 7 no",
        ),
        (
            "type:View# -> method:View#.body/1 2",
            "type:View# -> function:paint#/1 3",
            "method:View#.body/1 -> function:paint#/1 3",
        ),
    ),
}


def _quoted(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in rows)


def _files_sql() -> str:
    named = _values((n, g, e, t) for n, (g, (e, t, _, _)) in enumerate(SOURCES.items()))
    return f"WITH lang(n, language, extension, text) AS (VALUES {named}), f AS (SELECT CAST(p_partkey AS VARCHAR) AS k, language, language || ':src/f' || p_partkey || '.' || extension || ':' AS start, n FROM part JOIN lang ON n = p_partkey % {len(SOURCES)})"


def _files(s, d):
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SOURCES.values()]), (1 + F.col("p_partkey") % len(SOURCES)).cast("int"))
    key = F.col("p_partkey").cast("string")
    return A.dealt(table(s, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("src/f"), key, F.lit("."), pick(0)).alias("path"), F.replace(pick(1), F.lit("#"), key).alias("content"))


_SYMBOLS = _values((n, *x.rsplit(" ", 3)) for n, (_, _, own, _) in enumerate(SOURCES.values()) for x in own)
_CALLS = _values((n, x.split(" -> ")[0], *x.split(" -> ")[1].rsplit(" ", 1)) for n, (_, _, _, own) in enumerate(SOURCES.values()) for x in own)


@query("extracted_languages", f"{_files_sql()}, x(n, key, first, last, exported) AS (VALUES {_SYMBOLS}) SELECT start || replace(key, '#', k) AS stable_key, split_part(key, ':', 1) AS kind, CAST(first AS INT) AS start_line, CAST(last AS INT) AS end_line, exported = 'yes' AS exported FROM f JOIN x USING (n)")
def extracted_languages(s, d):
    return symbols.extract_symbols(_files(s, d)).select("stable_key", "kind", "start_line", "end_line", "exported")


@query("extracted_language_calls", f"{_files_sql()}, x(n, a, b, line) AS (VALUES {_CALLS}) SELECT start || replace(a, '#', k) AS from_key, CASE WHEN b LIKE 'unresolved:%' THEN b ELSE start || replace(b, '#', k) END AS to_key, CASE WHEN b LIKE 'unresolved:%' THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence, CAST(line AS INT) AS source_line FROM f JOIN x USING (n)")
def extracted_language_calls(s, d):
    return symbols.extract_calls(_files(s, d)).select("from_key", "to_key", "confidence", "source_line")


#: Lines that are remote calls, lines that are none, lines that open a transaction, and lines that only look like it.
_REMOTE, _LOCAL = ("await fetch (u)", "axios.post(u, b)", "x = HTTP.request(o)"), ("prefetch_all(u)", "axios.create(o)", "http.listen(p)")
_OPENS, _SHUT = ("const transaction = db.open()", "conn.beginTransaction()", "BEGIN TRANSACTION;"), ("transactions += 1", "begin_work()", "@Transaction2")


@query("remote_calls_in_transactions", "SELECT path, line FROM (SELECT 'src/f' || p_partkey || '.ts' AS path, CAST(20 + p_partkey % 23 AS INT) AS line, p_partkey AS k FROM part) WHERE k % 6 < 3 AND k % 7 < 4 AND abs(line - 31) <= 8")
def remote_calls_in_transactions(s, d):
    """A file a part: one line that is a remote call or isn't, and one at line 31 that opens a transaction or doesn't."""
    k = F.col("p_partkey")
    pick = lambda n, m, yes, no: F.when(k % n < m, F.element_at(F.array(*[F.lit(x) for x in yes]), (1 + k % 3).cast("int"))).otherwise(F.element_at(F.array(*[F.lit(x) for x in no]), (1 + k % 3).cast("int")))
    lines = F.array(F.struct((20 + k % 23).cast("int").alias("right_line"), pick(6, 3, _REMOTE, _LOCAL).alias("content")), F.struct(F.lit(31).alias("right_line"), pick(7, 4, _OPENS, _SHUT).alias("content")))
    added = table(s, d, "part").select(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".ts")).alias("path"), F.explode(lines).alias("l")).select("path", "l.*")
    return rules.remote_in_transaction(added)


@query("policy_hashes", """SELECT c_custkey, sha256('{"blocking":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"exclude":["gen/' || (c_custkey % 9) || '/**"],"include":["src/**"],"language":"en","max_inline":' || (c_custkey % 50) || ',"minimum_confidence":[{"key":"high","value":0.5}],"rules":[{"id":"r' || c_custkey || '","scope":"all","severity":"high","description":"no ' || c_mktsegment || '","enabled":true}]}') AS policy_hash FROM customer""")
def policy_hashes(s, d):
    """Policies of customers, each with a rule of its own; the hash is over the content, whatever the file's layout."""
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, "# a note\n").otherwise("")
    text = F.concat(note, F.lit("version: 1\ninclude:\n  - 'src/**'\nexclude:\n  - \"gen/"), (k % 9).cast("string"), F.lit("/**\"\nreview:\n  blocking: "), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("\n  maxInlineComments: "), (k % 50).cast("string"), F.lit("\n  minimumConfidence:\n    high: 0.5\nrules:\n  - id: r"), k.cast("string"), F.lit("\n    scope: all\n    severity: high\n    description: no "), F.col("c_mktsegment"), F.lit("\n"))
    return policy.policies(table(s, d, "customer").select("c_custkey", text.alias("text"))).select("c_custkey", "policy_hash")
