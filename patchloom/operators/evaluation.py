"""Agreement and quality figures: set and row counts, intervals, percentiles, gates, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import wilson
from patchloom.operators.percentiles import nearest_rank
from patchloom.operators.ranks import numbered


#: Tasks that take up what one task of a scan gives.
SHARES = 8


def share(hits: Column, total: Column) -> Column:
    """hits / total to 4 decimals, null without cases."""
    return F.round(F.try_divide(hits.cast("double"), total.cast("double")), 4)


def two_sets(a: DataFrame, b: DataFrame, key: list[str], in_a: str, in_b: str) -> DataFrame:
    """``key`` of two sets, with true in the column of each set that holds it, else null: a full join of them as one grouping.

    Nothing is sorted, and tasks group before the exchange. As in a join, a key with a null part equals none of the other set.
    """
    apart = F.lit(False)
    for c in key:
        apart = apart | F.col(c).isNull()
    side = lambda x, x_in, y_in, n: x.select(*key, F.when(apart, F.lit(n)).alias("__apart"), F.lit(x_in).cast("boolean").alias(in_a), F.lit(y_in).cast("boolean").alias(in_b))
    return side(a, True, None, 1).unionByName(side(b, None, True, 2)).groupBy(*key, "__apart").agg(F.max(in_a).alias(in_a), F.max(in_b).alias(in_b)).drop("__apart")


def set_counts(predicted: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """One row: true and false positives and false negatives of two sets by ``key``, precision, recall, intervals."""
    both = two_sets(predicted, expected, key, "p", "e")
    n = both.agg(F.count_if(F.col("p") & F.col("e")).alias("tp"), F.count_if(F.col("p") & F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull() & F.col("e")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    low, high = wilson(tp, tp + fp)
    return n.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), low.alias("precision_low"), high.alias("precision_high"))


def category_counts(predicted: DataFrame, expected: DataFrame, key: list[str], category: str) -> DataFrame:
    """By category, counted by rows: predicted, expected, and predicted rows that are expected."""
    hit = predicted.join(expected.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left")
    a = hit.groupBy(category).agg(F.count("*").alias("predicted"), F.count_if("hit").alias("tp"))
    b = expected.groupBy(category).agg(F.count("*").alias("expected"))
    out = a.join(b, category, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(category, zero("predicted"), zero("expected"), zero("tp"))


#: What a benchmark must show.
BENCHMARK = [("cases", "cases >= 100"), ("positive", "positive >= 20"), ("negative", "negative >= 20"), ("precision", "precision >= 0.8"), ("recall", "recall >= 0.7"), ("latency", "p95 <= 1000")]


def gate(metrics: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """``metrics`` with the names of failed checks (SQL conditions that must hold), and whether all passed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return metrics.withColumn("failures", F.array_join(failed, ",")).withColumn("passed", F.col("failures") == "")


def agreement(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: facts of both, of one only, and the agreement over the union (1 if it is empty)."""
    both = two_sets(a, b, key, "x", "y")
    n = both.agg(F.count_if(F.col("x") & F.col("y")).alias("agreed"), F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"))
    return n.withColumn("rate", F.coalesce(share(F.col("agreed"), F.col("agreed") + F.col("only_first") + F.col("only_second")), F.lit(1.0)))


def conflicts(facts: DataFrame, key: list[str], reviewer: str, reviewers: int) -> DataFrame:
    """One row: facts that not all of ``reviewers`` state."""
    # dealt by the facts' key, so that reviewers are made distinct and counted in one place, in tasks whose number grows with the scan's
    dealt = facts.repartition(SHARES * facts.rdd.getNumPartitions(), *key)
    return dealt.groupBy(*key).agg(F.countDistinct(reviewer).alias("n")).agg(F.count("*").alias("facts"), F.count_if(F.col("n") < reviewers).alias("conflicts"))


def review_queue(a: DataFrame, b: DataFrame, key: list[str], every: int) -> DataFrame:
    """All facts that one side alone states, and every ``every``-th of the others in their order."""
    both = two_sets(a, b, key, "x", "y")
    apart = both.filter("x IS NULL OR y IS NULL").select(*key, F.lit("disagreement").alias("reason"))
    agreed = numbered(both.filter("x AND y").select(*key), [], key)
    return apart.unionByName(agreed.filter(F.col("place") % every == 0).select(*key, F.lit("sample").alias("reason")))


def hash_sample(rows: DataFrame, salt: str, columns: list[str], n: int) -> DataFrame:
    """The ``n`` rows whose hash with ``salt`` is smallest: the same sample wherever it is drawn."""
    rank = F.sha2(F.concat_ws("\n", F.lit(salt), *[F.col(c).cast("string") for c in columns]), 256)
    return rows.withColumn("sample_rank", rank).orderBy("sample_rank").limit(n)


def fingerprint_of(rows: DataFrame) -> DataFrame:
    """One row: a hash of all rows as JSON, whatever their order, and their number.

    Each row's SHA-256 is cut into four numbers of 60 bits, which are added up over all rows, so nothing is gathered; the
    hash of the sums and the number is the table's.
    """
    hashed = rows.select(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("h"))
    lanes = [F.coalesce(F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k in range(4)]
    sums = hashed.agg(F.count("*").alias("n_rows"), *lanes)
    return sums.select(F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"), "n_rows")


def canonical_call(key: Column) -> Column:
    """A call target without type arguments, with single-identifier parameters that look like type variables as java.lang.Object.

    ``<init>`` behind a # is a constructor's name and stays. Nested arguments go from the inside outwards, eight deep.
    """
    marked = F.regexp_replace(key, "#<init>", "#\u0001")
    for _ in range(8):
        marked = F.regexp_replace(marked, "<[^<>]*>", "")
    plain = F.regexp_replace(marked, "#\u0001", "#<init>")
    open_, close = F.length(plain) - F.instr(F.reverse(plain), "(") + 1, F.length(plain) - F.instr(F.reverse(plain), ")") + 1
    inside = F.substring(plain, open_ + 1, close - open_ - 1)
    turned = F.array_join(F.transform(F.split(inside, ","), lambda x: F.when(x.rlike("^[A-Z][A-Za-z0-9_]*$"), F.lit("java.lang.Object")).otherwise(x)), ",")
    has = (F.instr(plain, "(") > 0) & (F.instr(plain, ")") > 0) & (close > open_)
    return F.when(has & (F.trim(inside) != ""), F.concat(F.substring(plain, F.lit(1), open_), turned, F.substring(plain, close, F.length(plain)))).otherwise(plain)


def canonical_facts(facts: DataFrame) -> DataFrame:
    """source_path, line, from_key, to_key of call facts, the caller named by its place, the target canonical."""
    return facts.select("source_path", "line", F.concat_ws(":", F.lit("java:callsite"), "source_path", F.col("line").cast("string")).alias("from_key"), canonical_call(F.col("to_key")).alias("to_key")).distinct()


def load_summary(samples: DataFrame, status: str, ms: str, wall_ms: float, by: list[str]) -> DataFrame:
    """Requests of each group: completed (200), rejected (409) and other, completed a second, and each kind's latencies."""
    if not wall_ms > 0:
        raise ValueError("wall time must be positive")
    kind = F.when(F.col(status) == 200, "completed").when(F.col(status) == 409, "rejected").otherwise("failures")
    rows = samples.withColumn("__kind", kind)
    out = rows.groupBy(*by).agg(F.count("*").alias("requests"), *[F.count_if(F.col("__kind") == k).alias(k) for k in ("completed", "rejected", "failures")])
    out = out.withColumn("completed_per_second", F.round(F.col("completed") * 1000.0 / F.lit(float(wall_ms)), 4))
    most = rows.groupBy(*by, "__kind").agg(F.round(F.max(ms), 2).alias("max"))
    each = nearest_rank(rows, ms, {"p50": 0.5, "p95": 0.95}, [*by, "__kind"]).join(most, [*by, "__kind"])
    for k in ("completed", "rejected", "failures"):
        out = out.join(each.filter(F.col("__kind") == k).select(*by, *[F.col(c).alias(f"{k}_{c}") for c in ("p50", "p95", "max")]), by, "left")
    return out


def holdout(files: DataFrame, policy: str, n: int, least: int = 60, most: int = 240, calls: int = 3) -> DataFrame:
    """The ``n`` files of a repository and commit whose hashes are smallest, of those with enough lines and call-like places.

    ``files`` (repository, commit_sha, path, content). Fewer than ``n`` eligible files are an error.
    """
    lines = F.size(F.split("content", "\n"))
    places = F.size(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*\s*\("), F.lit(0)))
    rows = files.withColumn("n_lines", lines).withColumn("n_calls", places).filter(F.col("n_lines").between(least, most) & (F.col("n_calls") >= calls))
    rank = F.sha2(F.concat_ws("\n", F.lit(policy), "repository", "commit_sha", "path"), 256)
    chosen = rows.select("repository", "commit_sha", "path", "n_lines", "n_calls", rank.alias("sample_rank")).orderBy("sample_rank", "path").limit(n)
    short = chosen.agg(F.count("*").alias("found")).select(F.when(F.col("found") < n, F.raise_error(F.concat(F.lit("eligible holdout files "), F.col("found").cast("string"), F.lit(f" < requested {n}")))).alias("error"))
    return chosen.join(F.broadcast(short), F.col("error").isNull()).drop("error")
