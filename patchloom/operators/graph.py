"""Symbol snapshots and the code graph: comparison, linking, bounded impact, reuse candidates.

Traversal is unrolled joins to the fixed depth of two, first path wins by an explicit order. Changed symbols stand on one
side of each join, edges on the other; edges are read by key, so both shuffle on it once and are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import name_tokens, simple_name
from patchloom.sources.saved import saved

#: Fixed values.
WEIGHTS = {"CALLS": 1.0, "IMPORTS": 0.6}
SECOND = 0.55
IMPACT_TYPES = ("CALLS", "READS", "WRITES", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "TESTS")
INHERITANCE = ("IMPLEMENTS", "EXTENDS", "OVERRIDES")
MODULE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def compare_symbols(base: DataFrame, head: DataFrame, flags: bool = True, files: str = "all") -> DataFrame:
    """stable_key, qualified_name, change, body_changed, signature_changed of symbols that differ.

    ``flags`` is what the two flags are where a symbol is new or gone. Symbols of kind ``file`` count (``all``), count only
    where they are new or gone (``edges``), or don't (``none``); the last two need a ``kind`` column.
    """
    if files == "none":
        base, head = base.filter("kind <> 'file'"), head.filter("kind <> 'file'")
    if files == "edges":
        both_sides = base.filter("kind = 'file'").select("stable_key").intersect(head.filter("kind = 'file'").select("stable_key"))
        base, head = base.join(both_sides, "stable_key", "left_anti"), head.join(both_sides, "stable_key", "left_anti")
    side = lambda x, n: x.select("stable_key", *[F.col(c).alias(f"{n}_{c}") for c in ("qualified_name", "signature", "content_hash")])
    both = side(base, "b").join(side(head, "h"), "stable_key", "full_outer")
    gone, new = F.col("h_content_hash").isNull(), F.col("b_content_hash").isNull()
    body, signature = ~F.col("b_content_hash").eqNullSafe(F.col("h_content_hash")), ~F.col("b_signature").eqNullSafe(F.col("h_signature"))
    change = F.when(new, "ADDED").when(gone, "DELETED").when(body | signature, "MODIFIED")
    edge = new | gone
    return both.withColumn("change", change).filter("change IS NOT NULL").select("stable_key", F.coalesce("h_qualified_name", "b_qualified_name").alias("qualified_name"), "change", F.when(edge, F.lit(flags)).otherwise(body).alias("body_changed"), F.when(edge, F.lit(flags)).otherwise(signature).alias("signature_changed"))


def moved_symbols(base: DataFrame, head: DataFrame, order: str = "stable_key") -> DataFrame:
    """from_key, to_key, tier: each lost symbol, in ``order``, with the one new symbol that may take its place.

    The only new one still free of its kind, name and content (tier 1), else the only one still free of its kind and name
    (tier 2). Only new symbols need be alone. A fold over the lost of one kind and name, which are few.
    """
    lost = base.join(head.select("stable_key"), "stable_key", "left_anti").groupBy("kind", "qualified_name").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("stable_key").alias("k"), F.col("content_hash").alias("h")))).alias("lost"))
    new = head.join(base.select("stable_key"), "stable_key", "left_anti").groupBy("kind", "qualified_name").agg(F.array_sort(F.collect_list(F.struct(F.col("stable_key").alias("k"), F.col("content_hash").alias("h")))).alias("new"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter("new", lambda c: ~F.array_contains(acc["used"], c["k"]))
        same = F.filter(free, lambda c: c["h"] == x["h"])
        tier = F.when(F.size(same) == 1, 1).when(F.size(free) == 1, 2)
        found = F.when(F.size(same) == 1, same[0]["k"]).when(F.size(free) == 1, free[0]["k"])
        one = F.struct(x["k"].alias("from_key"), found.alias("to_key"), tier.alias("tier"))
        return F.struct(F.when(found.isNotNull(), F.array_append(acc["used"], found)).otherwise(acc["used"]).alias("used"), F.when(found.isNotNull(), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<from_key:string,to_key:string,tier:int>>").alias("out"))
    return lost.join(new, ["kind", "qualified_name"]).select(F.explode(F.aggregate("lost", empty, step, lambda acc: acc["out"])).alias("o")).select("o.*")


def link_unique_names(edges: DataFrame, symbols: DataFrame, confidence: float, files: bool = True, again: bool = False) -> DataFrame:
    """``unresolved:<name>`` targets become the key of the only symbol of that name; others stay.

    Without ``files`` symbols of kind ``file`` don't count; ``again`` keeps one of edges that have become the same, the surest.
    """
    if not files:
        symbols = symbols.filter("kind <> 'file'")
    only = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("stable_key").alias("found")).filter("n = 1").select(F.concat(F.lit("unresolved:"), "name").alias("to_key"), "found")
    out = edges.join(only, "to_key", "left")
    linked = out.select("from_key", F.coalesce("found", "to_key").alias("to_key"), F.when(F.col("found").isNotNull(), F.lit(confidence)).otherwise(F.col("confidence")).alias("confidence"))
    return linked.groupBy("from_key", "to_key").agg(F.max("confidence").alias("confidence")) if again else linked


def normal_path(path: Column) -> Column:
    """A path without ``.`` and empty segments, each ``..`` taking the segment before it, if there is one to take."""
    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
        return F.when((x == "") | (x == "."), acc).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def link_modules(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``edges`` (from_key, to_key, confidence, source_path, ...) whose ``external:<specifier>#<export>`` target a file of the snapshot has.

    Relative specifiers are taken from the source's folder; without an extension the first of ``MODULE_SUFFIXES`` that is a file
    counts. ``*`` is the file's own symbol, ``default`` the exported symbol marked so, else the exported symbol of that name;
    it must be the only one. Linked edges have a confidence of 0.9 at least; all others stay as they are. Targets are looked up once
    for each folder and come back by (folder, target), never by a row number, which a second reading could deal out differently.
    ``symbols`` (stable_key, kind, path, name, exported, is_default).
    """
    keyed = edges.withColumn("__dir", F.regexp_replace(F.coalesce("source_path", F.lit("")), "/?[^/]*$", ""))
    spec = F.regexp_extract("to_key", "^external:(.*)#[^#]*$", 1)
    wanted = keyed.filter(F.col("to_key").startswith("external:") & spec.startswith(".")).select("__dir", "to_key").distinct().select("__dir", "to_key", F.regexp_extract("to_key", "#([^#]*)$", 1).alias("__name"), normal_path(F.concat_ws("/", "__dir", spec)).alias("__base"))
    extension = F.regexp_extract("__base", r"[^/.][^/]*(\.[^/.]*)$", 1) != ""
    tried = F.when(extension, F.array(F.struct(F.lit(0).alias("n"), F.col("__base").alias("path")))).otherwise(F.array(*[F.struct(F.lit(k).alias("n"), F.concat("__base", F.lit(x)).alias("path")) for k, x in enumerate(MODULE_SUFFIXES)]))
    files = symbols.filter("kind = 'file'").groupBy("path").agg(F.max("stable_key").alias("file_key"))
    hit = wanted.select("__dir", "to_key", "__name", F.explode(tried).alias("t")).select("__dir", "to_key", "__name", "t.n", "t.path").join(files, "path").groupBy("__dir", "to_key", "__name").agg(F.min_by(F.struct("path", "file_key"), "n").alias("f")).select("__dir", "to_key", "__name", "f.path", "f.file_key")
    named = symbols.filter("exported AND kind <> 'file'").select("path", F.col("name").alias("__name"), "stable_key")
    chosen = symbols.filter("exported AND is_default").select("path", F.lit("default").alias("__name"), "stable_key")
    only = named.filter("__name <> 'default'").unionByName(chosen).groupBy("path", "__name").agg(F.count("*").alias("n"), F.min("stable_key").alias("found")).filter("n = 1").drop("n")
    linked = hit.join(only, ["path", "__name"], "left").select("__dir", "to_key", F.when(F.col("__name") == "*", F.col("file_key")).otherwise(F.col("found")).alias("__to")).filter("__to IS NOT NULL")
    out = keyed.join(linked, ["__dir", "to_key"], "left").withColumn("confidence", F.when(F.col("__to").isNotNull(), F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence"))).withColumn("to_key", F.coalesce("__to", "to_key"))
    return out.select(*edges.columns)


def unchanged_callers(symbols: DataFrame, relationships: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """group, kind (caller, test), name: callers outside a group of changed files, and test files tied to it.

    ``symbols`` (id, name, path), ``relationships`` (from_id, to_id, type), ``groups`` (group, path), ``files`` (path, role).
    A caller is a symbol outside the group and outside test files that calls one of its symbols. Tests are the group's own test
    files and the outside test files at either end of a relationship with its symbols.
    """
    tests = files.filter("role = 'test'").select(F.col("path").alias("test_path")).distinct()
    core = groups.join(symbols, "path").select("group", F.col("id").alias("core_id"))
    end = lambda mine, other: relationships.join(core, F.col(mine) == F.col("core_id")).select("group", "type", F.col(other).alias("id"), F.lit(mine).alias("mine"))
    near = end("to_id", "from_id").unionByName(end("from_id", "to_id")).join(symbols, "id").join(groups.select("group", "path", F.lit(True).alias("inside")), ["group", "path"], "left").filter("inside IS NULL").join(tests, F.col("path") == F.col("test_path"), "left")
    callers = near.filter("type = 'calls' AND mine = 'to_id' AND test_path IS NULL").select("group", F.lit("caller").alias("kind"), "name")
    own = groups.join(tests, F.col("path") == F.col("test_path")).select("group", F.lit("test").alias("kind"), F.col("path").alias("name"))
    outside = near.filter("test_path IS NOT NULL").select("group", F.lit("test").alias("kind"), F.col("path").alias("name"))
    return callers.unionByName(own).unionByName(outside).distinct()


def incoming(edges: DataFrame, key: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Edges that lead to ``key``, of the given types or of any."""
    rows = edges.filter(F.col("to_key") == key)
    return rows.filter(F.col("type").isin(*types)) if types else rows


def symbols_at(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.filter(F.col("path") == path)


def unresolved_names(symbols: DataFrame) -> DataFrame:
    """The unresolved targets that a snapshot's methods and constructors can settle: to_key."""
    inside = F.regexp_extract("stable_key", r"^.*\((.*)\)", 1)
    arity = F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ","))).cast("string")
    rows = symbols.filter(F.col("stable_key").rlike(r"\(.*\)"))
    method = rows.filter("kind = 'METHOD'").select(F.regexp_extract("stable_key", r"^.*#([^(]*)\([^(]*$", 1).alias("name"), arity.alias("arity")).filter("name <> ''").select(F.concat(F.lit("unresolved:method:"), "name", F.lit("/"), "arity").alias("to_key"))
    made = rows.filter("kind = 'CONSTRUCTOR'").select(F.concat(F.lit("unresolved:constructor:"), F.regexp_replace("qualified_name", r"\.<init>$", ""), F.lit("/"), arity).alias("to_key"))
    return method.unionByName(made).distinct()


def affected_paths(symbols: DataFrame, edges: DataFrame, changed: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """path: files to be parsed again. The changed ones, those whose symbols lead to symbols of changed files, and, once those are
    ``parsed`` (their new symbols), those with a target that was unresolved and that the new symbols settle; one step, not more."""
    keys = symbols.join(changed, "path", "left_semi").select(F.col("stable_key").alias("to_key")).distinct()
    if parsed is not None:
        keys = keys.unionByName(unresolved_names(parsed)).distinct()
    sources = edges.join(keys, "to_key", "left_semi").select(F.col("from_key").alias("stable_key")).distinct()
    return changed.select("path").unionByName(symbols.join(sources, "stable_key", "left_semi").select("path")).distinct()


def incremental_index(base_symbols: DataFrame, base_edges: DataFrame, new_symbols: DataFrame, new_edges: DataFrame, changed: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of the head: what was parsed again, and all else of the base, without edges into symbols of changed files that are gone.

    ``affected`` are the files parsed again, ``changed`` the files that differ. Edges have a ``source_path``; TESTS edges are derived anew.
    """
    kept = base_symbols.join(affected, "path", "left_anti")
    symbols = kept.unionByName(new_symbols.select(*kept.columns))
    was = base_symbols.join(changed.select("path"), "path", "left_semi").select("stable_key")
    gone = saved(was.join(symbols.select("stable_key"), "stable_key", "left_anti").select(F.col("stable_key").alias("to_key")), "gone")  # its size is known then: a few meet the edges where they stand
    reused = base_edges.filter("type <> 'TESTS'").join(affected.select(F.col("path").alias("source_path")), "source_path", "left_anti").join(gone, "to_key", "left_anti").select(*base_edges.columns)
    edges = reused.unionByName(new_edges.filter("type <> 'TESTS'").select(*base_edges.columns)).distinct()
    return symbols, edges


def _weight(kind: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in weights.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def impact_paths(changes: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None, rounded: bool = True, cap: int | None = None, types: tuple[str, ...] = (), trim: bool = False, evidence: bool = False) -> DataFrame:
    """change_key, impacted_key, depth, score: callers within two steps of each change, each once and by its first path.

    ``edges`` (from_key, to_key, type, confidence, ord), of ``types`` or of any; a smaller ord comes first. A score is the
    parent's times weight, confidence and, at depth two, 0.55; with ``rounded`` it is rounded to 3 places before it passes on.
    ``cap`` stops after the step that reaches so many paths of a change; with ``trim`` the best ``cap`` stay (by score and key).
    ``evidence`` adds ``path`` (keys, the caller first) and ``edge_ords`` (its edges in that order). Edges that lead
    nowhere near a change are left out by a semi-join before the first step's rows meet them.
    """
    weight = _weight(F.col("type"), weights or {})
    use = edges.filter(F.col("type").isin(*types)) if types else edges
    to = use.select(F.col("to_key").alias("at"), F.col("from_key").alias("node"), F.col("ord"), (weight * F.col("confidence")).alias("gain"))
    fix = (lambda c: F.round(c, 3)) if rounded else (lambda c: c)
    pick = lambda *order: F.row_number().over(Window.partitionBy("change_key", "node").orderBy(*order))
    one = changes.select(F.col("stable_key").alias("change_key")).join(to, F.col("change_key") == F.col("at")).filter("node != change_key")
    one = one.withColumn("n", pick("ord")).filter("n = 1").select("change_key", "node", F.col("ord").alias("o1"), fix(F.col("gain")).alias("score"))
    two = one.select("change_key", F.col("node").alias("at"), "o1", F.col("score").alias("parent")).join(to, "at").filter("node != change_key")
    two = two.join(one.select("change_key", "node"), ["change_key", "node"], "left_anti")
    two = two.withColumn("n", pick("o1", "ord")).filter("n = 1").select("change_key", "node", F.col("at").alias("via"), "o1", F.col("ord").alias("o2"), fix(F.col("parent") * F.col("gain") * SECOND).alias("score"))
    none = F.lit(None)
    out = one.select("change_key", "node", none.cast("string").alias("via"), "o1", none.cast("long").alias("o2"), F.lit(1).alias("depth"), "score").unionByName(two.withColumn("depth", F.lit(2)))
    if cap is not None:  # a step is all that one node adds: the first one for depth 1, then each node of depth 1
        step = F.when(F.col("depth") == 1, F.lit(-1)).otherwise(F.col("o1"))
        sizes = out.withColumn("step", step).groupBy("change_key", "step").agg(F.count("*").alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy("change_key").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        open_steps = sizes.withColumn("before", before).filter(F.col("before") < cap).select("change_key", "step")
        out = out.withColumn("step", step).join(open_steps, ["change_key", "step"], "left_semi").drop("step")
        if trim:
            out = out.withColumn("n", F.row_number().over(Window.partitionBy("change_key").orderBy(F.col("score").desc(), "node"))).filter(F.col("n") <= cap)
    more = []
    if evidence:
        more = [F.array_compact(F.array("node", "via", "change_key")).alias("path"), F.when(F.col("depth") == 1, F.array("o1")).otherwise(F.array("o2", "o1")).alias("edge_ords")]
    return out.select("change_key", F.col("node").alias("impacted_key"), "depth", F.round("score", 3).alias("score"), *more)


def semantic_impact(base: DataFrame, head: DataFrame, edges: DataFrame, changed_paths: DataFrame, top: int = 12) -> DataFrame:
    """Direct impact over resolved edges of the whole repository: changed_name, impacted_name, score, place; the ``top`` best of all.

    ``base`` and ``head`` (stable_key, qualified_name, path); of a symbol in both the head's counts. Changed symbols are those of
    either side in changed paths; impacted ones are known and lie elsewhere. The first edge of each pair counts; tests score 1.
    """
    side = lambda x, n: x.select("stable_key", F.lit(n).alias("__side"), "qualified_name", "path")
    marked = side(head, 0).unionByName(side(base, 1)).join(changed_paths.select("path", F.lit(True).alias("__in")).distinct(), "path", "left")
    both = marked.groupBy("stable_key").agg(F.min_by(F.struct("qualified_name", "__in"), "__side").alias("first"), F.max(F.coalesce("__in", F.lit(False))).alias("changed"))
    inside = both.filter("changed").select(F.col("stable_key").alias("to_key"), F.col("first.qualified_name").alias("changed_name"))
    near = edges.filter(F.col("type_resolved") & F.col("type").isin(*IMPACT_TYPES)).select("from_key", "to_key", "type", "confidence", "ord").join(inside, "to_key")
    outside = both.filter("first.__in IS NULL").select(F.col("stable_key").alias("from_key"), F.col("first.qualified_name").alias("impacted_name"))
    rows = near.join(outside, "from_key")
    score = F.when(F.col("type") == "TESTS", 1.0).otherwise(F.col("confidence"))
    first = rows.groupBy("to_key", "from_key", "changed_name", "impacted_name").agg(F.min_by(score, "ord").alias("score"))
    best = first.orderBy(F.col("score").desc(), "changed_name", "impacted_name", "to_key", "from_key").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "changed_name", "impacted_name", "to_key", "from_key"))).select("changed_name", "impacted_name", "score", "place")


def blast_radius(changes: DataFrame, paths: DataFrame, variant: str) -> DataFrame:
    """One row: score and level, by the ``strict`` (3, 5 and 8 times scores), ``plain`` (5, 8, 6 or 3) or ``semantic`` (2, 8) formula.

    For the variant that counts exported symbols of both sides, ``changes`` holds the changed symbols' rows of both.
    """
    n = changes.agg(F.count("*").alias("changes"), F.count_if("exported").alias("exported"))
    p = paths.agg(F.count("*").alias("paths"), F.countDistinct("impacted_key").alias("impacted"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("scores"), F.coalesce(F.sum(F.when(F.col("depth") == 1, 6).otherwise(3)), F.lit(0)).alias("steps"))
    raw = {"strict": F.col("changes") * 3 + F.col("exported") * 5 + F.col("scores") * 8, "plain": F.col("changes") * 5 + F.col("impacted") * 8 + F.col("steps"), "semantic": F.col("changes") * 2 + F.col("paths") * 8}[variant]
    high, medium = (70, 30) if variant == "semantic" else (60, 25)
    score = F.least(F.lit(100), F.round(raw)).cast("int")
    return n.select("*", F.lit(1).alias("k")).join(p.select("*", F.lit(1).alias("k")), "k").select("changes", "paths", score.alias("score"), F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low").alias("level"))


def direct_relationships(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Resolved edges with one changed end: the other end, and how it is tied."""
    flag = lambda c: changed.select(F.col("stable_key").alias(c), F.lit(True).alias(f"{c}_changed"))
    rows = edges.filter("type_resolved").join(flag("from_key"), "from_key", "left").join(flag("to_key"), "to_key", "left")
    a, b = F.coalesce("from_key_changed", F.lit(False)), F.coalesce("to_key_changed", F.lit(False))
    return rows.filter(a != b).select(F.when(a, F.col("to_key")).otherwise(F.col("from_key")).alias("other_key"), F.when(a, "callee").otherwise("caller").alias("side"), "type").distinct()


def shared_callers(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Callees that callers of changed symbols also call, with the number of such callers."""
    calls = edges.filter("type = 'CALLS' AND type_resolved").select("from_key", "to_key").distinct()
    callers = calls.join(changed.select(F.col("stable_key").alias("to_key")), "to_key", "left_semi").select("from_key").distinct()
    others = calls.join(callers, "from_key", "left_semi").join(changed.select(F.col("stable_key").alias("to_key")), "to_key", "left_anti")
    return others.groupBy(F.col("to_key").alias("candidate_key")).agg(F.count("*").alias("callers"))


def shared_caller_evidence(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """candidate_key, ord: the calls that show a shared caller, the candidate's own and its callers' calls of changed symbols."""
    calls = edges.filter("type = 'CALLS' AND type_resolved").select("from_key", "to_key", "ord")
    anchors = calls.join(changed.select(F.col("stable_key").alias("to_key")), "to_key", "left_semi").select("from_key", F.col("ord").alias("anchor"))
    own = calls.join(changed.select(F.col("stable_key").alias("to_key")), "to_key", "left_anti").join(anchors.select("from_key"), "from_key", "left_semi").select("from_key", F.col("to_key").alias("candidate_key"), "ord")
    return own.select("candidate_key", "ord").unionByName(own.join(anchors, "from_key").select("candidate_key", F.col("anchor").alias("ord"))).distinct()


def derive_test_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """TESTS edges from calls of a test symbol on one that isn't."""
    side = lambda c: symbols.select(F.col("stable_key").alias(c), F.col("test_source").alias(f"{c}_test"))
    return edges.filter("type = 'CALLS'").join(side("from_key"), "from_key").join(side("to_key"), "to_key").filter("from_key_test AND NOT to_key_test").select("from_key", "to_key", F.lit("TESTS").alias("type")).distinct()


def reuse_candidates(symbols: DataFrame, changed: DataFrame, edges: DataFrame, top: int = 12, inheritance: bool = True) -> DataFrame:
    """stable_key, qualified_name, tier, fit, score: unchanged symbols that could serve instead of changed ones, the ``top`` best.

    The first tier that fits: test fixture .90 (a test symbol with a direct relationship), same contract .96 (a direct
    inheritance; left out without ``inheritance``), same contract .95 (simple name and kind), same role .84 (a shared caller and the kind),
    caller pattern .72 (a shared caller), similar logic up to .69 (tokens of the name and the kind). Changed names, kinds
    and tokens are sets of their own and meet symbols by key. ``symbols`` (stable_key, kind, qualified_name, test_source).
    """
    rows = symbols.join(changed.select("stable_key"), "stable_key", "left_anti").withColumn("simple", simple_name(F.col("qualified_name")))
    names = changed.select(simple_name(F.col("qualified_name")).alias("simple"), F.lit(True).alias("same_name")).distinct()
    kinds = changed.select("kind", F.lit(True).alias("same_kind")).distinct()
    tokens = changed.select(F.explode(name_tokens(F.col("qualified_name"))).alias("token")).distinct()
    overlap = rows.select("stable_key", F.explode(name_tokens(F.col("qualified_name"))).alias("token")).join(tokens, "token").groupBy("stable_key").agg(F.count("*").alias("overlap"))
    direct = direct_relationships(edges, changed).groupBy(F.col("other_key").alias("stable_key")).agg(F.max(F.col("type").isin(*INHERITANCE)).alias("inherits"))
    shared = shared_callers(edges, changed).select(F.col("candidate_key").alias("stable_key"), "callers")
    rows = rows.join(names, "simple", "left").join(kinds, "kind", "left").join(overlap, "stable_key", "left").join(direct, "stable_key", "left").join(shared, "stable_key", "left")
    kind, called = F.col("same_kind").isNotNull(), F.col("callers").isNotNull()
    one = lambda tier, fit, score: F.struct(F.lit(tier).alias("tier"), F.lit(fit).alias("fit"), score.cast("double").alias("score"))
    case = (
        F.when(F.col("test_source") & F.col("inherits").isNotNull(), one("test_fixture", "extendable", F.lit(0.90)))
        .when(F.lit(inheritance) & F.coalesce("inherits", F.lit(False)), one("same_contract", "direct", F.lit(0.96)))
        .when(F.col("same_name").isNotNull() & kind, one("same_contract", "direct", F.lit(0.95)))
        .when(called & kind, one("same_role", "extendable", F.lit(0.84)))
        .when(called, one("caller_pattern", "partial", F.lit(0.72)))
        .when((F.col("overlap") >= 1) & kind, one("similar_logic", "partial", F.round(F.least(F.lit(0.69), F.lit(0.50) + 0.08 * F.col("overlap")), 2)))
    )
    return rows.withColumn("c", case).filter("c IS NOT NULL").select("stable_key", "qualified_name", "c.*").orderBy(F.col("score").desc(), "qualified_name", "stable_key").limit(top)


def fact_audit(edges: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: resolved calls, those from unchanged into changed symbols and their distinct callers, and annotations whose path isn't their owner's.

    ``symbols`` (stable_key, path); an edge of type ANNOTATED_WITH names its owner as from_key and its own place as source_path.
    """
    flag = lambda c: changed.select(F.col("stable_key").alias(c), F.lit(True).alias(f"{c}_changed"))
    rows = edges.filter("type = 'CALLS' AND type_resolved").join(flag("to_key"), "to_key", "left").join(flag("from_key"), "from_key", "left")
    into = F.col("to_key_changed").isNotNull() & F.col("from_key_changed").isNull()
    calls = rows.agg(F.count("*").alias("calls"), F.count_if(into).alias("from_unchanged"), F.countDistinct(F.when(into, F.col("from_key"))).alias("callers"))
    owners = edges.filter("type = 'ANNOTATED_WITH'").join(symbols.select(F.col("stable_key").alias("from_key"), F.col("path").alias("__path")), "from_key", "left")
    wrong = owners.agg(F.count_if(~F.col("source_path").eqNullSafe(F.col("__path"))).alias("annotation_mismatches"))
    return calls.withColumn("__k", F.lit(1)).join(wrong.withColumn("__k", F.lit(1)), "__k").drop("__k")


def snapshot_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of ``a`` are missing in ``b`` and how many are extra, as sets."""
    return a.exceptAll(b).agg(F.count("*").alias("missing")).withColumn("k", F.lit(1)).join(b.exceptAll(a).agg(F.count("*").alias("extra")).withColumn("k", F.lit(1)), "k").drop("k")
