"""Repository policy, admission and merging of candidate findings, deterministic summaries and reports."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.text import SEVERITIES, is_high_risk_path, is_test_path, severity_rank

#: Limits and vocabulary of a policy, categories a candidate may have, source files of the variants, levels.
MOST_CHARS, LANGUAGES, MOST_COMMENTS = 100_000, ("en", "zh"), 50
CATEGORIES = ("correctness", "security", "data_integrity", "concurrency", "performance", "architecture", "test_gap")
SCRIPT_FILES = r"\.[jt]sx?$"
SOURCE_FILES = r"(?i)\.(?:[jt]sx?|go|java|kt|kts|py|rb|php|cs|c|cc|cpp|h|hpp|rs|swift)$"
LEVELS = ("low", "medium", "high")
TITLE_CHARS, MESSAGE_CHARS, MOST_ANNOTATIONS = 255, 64_000, 50


@dataclass(frozen=True)
class Policy:
    """What a repository asks of its reviews."""

    language: str = "en"
    blocking: bool = False
    max_inline: int = 10
    minimum_confidence: dict[str, float] = field(default_factory=dict)
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    rules: tuple[tuple[str, str, str, str, bool], ...] = ()
    warnings: tuple[str, ...] = ()


def _policy_of(root: dict, max_inline: int) -> Policy:
    if root.get("version", 1) != 1:
        raise ValueError("unsupported version")
    review = root.get("review") if isinstance(root.get("review"), dict) else {}
    language, most = review.get("language", "en"), review.get("maxInlineComments", max_inline)
    if language not in LANGUAGES:
        raise ValueError("language must be en or zh")
    if isinstance(most, bool) or not isinstance(most, int) or not 0 <= most <= MOST_COMMENTS:
        raise ValueError(f"maxInlineComments must be between 0 and {MOST_COMMENTS}")
    least = {}
    for name, value in (review.get("minimumConfidence") or {}).items():
        number = float(value)
        if name not in SEVERITIES or not math.isfinite(number) or not 0 <= number <= 1:
            raise ValueError("minimumConfidence needs a severity and a number from 0 to 1")
        least[name] = number
    strings = lambda key: tuple(str(x) for x in root.get(key) or () if isinstance(x, str) and x.strip())
    rules = []
    for item in root.get("rules") or ():
        if isinstance(item, dict):
            name, text = str(item.get("id", item.get("key", ""))), str(item.get("description", item.get("content", "")))
            if not name.strip() or not text.strip():
                raise ValueError("a rule needs an id and a description")
            rules.append((name, str(item.get("scope", "")), str(item.get("severity", "")), text, item.get("enabled") is not False))
    return Policy(language, review.get("blocking") is True, most, least, strings("include") or ("**/*",), strings("exclude"), tuple(rules))


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("true", "false", "null", "~", ""):
        return {"true": True, "false": False}.get(text)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """The value of the lines from ``at`` on that are indented by ``indent``: a map or a list, and where it ends."""
    if at >= len(lines) or lines[at][0] < indent:
        return None, at
    listed = lines[at][1].startswith("- ") or lines[at][1] == "-"
    out: list | dict = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("-") == listed):
        text = lines[at][1]
        if listed:
            rest = text[1:].strip()
            if rest.endswith(":") or (": " in rest and rest[0] not in "\"'["):  # a map begins on the dash's line
                inner = indent + len(text) - len(text[1:].lstrip())
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
            continue
        key, colon, rest = text.partition(":")
        if not colon:
            raise ValueError("a line is neither a key nor a list item")
        if rest.strip():
            value, at = _scalar(rest), at + 1
        elif at + 1 < len(lines) and (lines[at + 1][0] > indent or (lines[at + 1][0] == indent and lines[at + 1][1].startswith("-"))):
            value, at = _block(lines, at + 1, lines[at + 1][0])
        else:
            value, at = None, at + 1
        out[_scalar(key)] = value
    if at < len(lines) and lines[at][0] > indent:
        raise ValueError("indentation doesn't fit")
    return out, at


def read_yaml(text: str):
    """The maps, lists and scalars of a policy file: the block style of YAML, flow lists of scalars, and comments."""
    lines = []
    for line in text.splitlines():
        cut = line if line.strip()[:1] not in ("#",) else ""
        quote = ""
        for k, c in enumerate(cut):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and cut[:k].rstrip()[-1:] in ("", ":", "-", "[", ","):  # a quote opens where a scalar begins
                quote = c
            elif c == "#" and k and cut[k - 1] == " ":
                cut = cut[:k]
                break
        if "\t" in cut[: len(cut) - len(cut.lstrip())]:
            raise ValueError("tabs can't indent")
        if cut.strip() and cut.strip() != "---":
            lines.append((len(cut) - len(cut.lstrip()), cut.strip()))
    if not lines:
        return None
    out, at = _block(lines, 0, lines[0][0])
    if at != len(lines):
        raise ValueError("indentation doesn't fit")
    return out


def parse_policy(text: str | None, max_inline: int = 10) -> Policy:
    """The policy of a file; without one, or where it breaks a rule, the defaults, in the second case with a warning."""
    try:
        if text is None:
            return Policy(max_inline=max_inline)
        if len(text) > MOST_CHARS:
            raise ValueError("too long")
        root = read_yaml(text)
        return _policy_of(root if isinstance(root, dict) else {}, max_inline)
    except (ValueError, TypeError, AttributeError) as error:
        return Policy(max_inline=max_inline, warnings=(f"policy ignored: {error}",))


def policies(files: DataFrame, max_inline: int = 10) -> DataFrame:
    """``files`` (key, text) with the fields of their policies as columns, and ``policy_hash``. One row a repository; the parser is a row-wise function."""
    schema = "language string, blocking boolean, max_inline int, minimum_confidence map<string,double>, include array<string>, exclude array<string>, rules array<struct<id:string,scope:string,severity:string,description:string,enabled:boolean>>, warnings array<string>"
    parsed = F.udf(lambda t: asdict(parse_policy(t, max_inline)), schema)
    out = files.withColumn("__p", parsed("text")).select(*[c for c in files.columns if c != "text"], "__p.*")
    return out.withColumn("policy_hash", F.sha2(F.to_json(F.struct("blocking", "exclude", "include", "language", "max_inline", F.array_sort(F.map_entries("minimum_confidence")).alias("minimum_confidence"), "rules")), 256))


def policy_hash(policy: Policy) -> str:
    """A hash of a policy's content: JSON with sorted keys, without warnings."""
    import hashlib

    fields = {k: v for k, v in asdict(policy).items() if k != "warnings"}
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def title_identity(rule_id: Column, title: Column) -> Column:
    """The rule's id, or, without one, the title in lower case with dashes for all but letters and digits."""
    return F.coalesce(F.nullif(rule_id, F.lit("")), F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_]+", "-"))


def fingerprint_claim(rule_id: Column, path: Column, line: Column, claim: Column) -> Column:
    return F.sha2(F.concat_ws("|", rule_id, path, line.cast("string"), claim), 256)


def fingerprint_titled(category: Column, path: Column, line: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("\n", category, path, line.cast("string"), title), 256)


def admitted(candidates: DataFrame, added: DataFrame) -> DataFrame:
    """Candidates of a model that can be checked: known category and severity, a confidence from 0 to 1, on an added line that holds the excerpt.

    ``candidates`` (category, severity, confidence, path, line, title, excerpt), ``added`` (path, right_line, content). They get
    the whole line as excerpt and the fingerprint of category, place and title. Others vanish; an empty excerpt fits any line.
    """
    lines = added.groupBy("path", F.col("right_line").alias("line")).agg(F.max_by("content", "pos").alias("__line") if "pos" in added.columns else F.max("content").alias("__line"))
    known = F.col("category").isin(*CATEGORIES) & F.col("severity").isin(*SEVERITIES) & F.col("confidence").between(0, 1)
    said = F.trim(F.coalesce("excerpt", F.lit("")))
    rows = candidates.filter(known).join(lines, ["path", "line"]).filter((said == "") | F.contains(F.trim("__line"), said))
    return rows.withColumn("excerpt", F.col("__line")).withColumn("fingerprint", fingerprint_titled(F.col("category"), F.col("path"), F.col("line"), F.col("title"))).drop("__line")


def merged(groups: list[DataFrame], order: str) -> DataFrame:
    """The findings of all groups, of each fingerprint the first: by group, then by ``order``."""
    rows = groups[0].withColumn("__g", F.lit(0))
    for k, group in enumerate(groups[1:], 1):
        rows = rows.unionByName(group.withColumn("__g", F.lit(k)))
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy("__g", order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n", "__g")


def highest(*levels: Column) -> Column:
    """The highest of risk levels; a null one counts for nothing."""
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).when(c == "low", 0).otherwise(-1)
    top = F.greatest(*[rank(c) for c in levels], F.lit(0))
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), top + 1)


def finding_level(severity: Column, publishable: Column) -> Column:
    """An aggregate: high with a published critical or high finding, medium with a medium one, else low."""
    top = F.max(F.when(publishable, severity_rank(severity)).otherwise(0))
    return F.when(top >= 3, "high").when(top == 2, "medium").otherwise("low")


def conclusion(risk: Column, blocking: Column, trial: bool = False) -> Column:
    if trial:
        return F.lit("neutral")
    return F.when(risk == "high", F.when(blocking, "failure").otherwise("neutral")).otherwise("success")


def change_summary(files: DataFrame, group: str, order: str, limit: int = 100, variant: str = "plain") -> DataFrame:
    """A group's totals over its first ``limit`` files, the reasons for care (joined by commas), and the risk they make.

    ``plain``: sensitive paths, no test among more than 50 changed lines, more than 1,000 lines. ``script`` and ``source`` ask
    for tests where files of their kind change, and name a cut list. Sensitive paths or a large change make a high risk, any
    other reason a medium one.
    """
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = files.withColumn("__n", n)
    use = F.col("__n") <= limit
    count = lambda c: F.sum(F.when(use, c).otherwise(0)).cast("long")
    out = rows.groupBy(group).agg(
        F.count("*").alias("total_files"), F.least(F.count("*"), F.lit(limit)).alias("reviewed_files"), count(F.col("additions")).alias("additions"), count(F.col("deletions")).alias("deletions"),
        F.count_if(use & is_high_risk_path(F.col("path"))).alias("sensitive"), F.count_if(use & is_test_path(F.col("path"))).alias("tests"), F.count_if(use & F.col("path").rlike(SCRIPT_FILES if variant == "script" else SOURCE_FILES)).alias("sources"),
    )
    lines = F.col("additions") + F.col("deletions")
    untested = (F.col("tests") == 0) & ((lines > 50) if variant == "plain" else (F.col("sources") > 0))
    checks = [("sensitive", F.col("sensitive") > 0), ("untested", untested), ("large", lines > 1000)] + ([] if variant == "plain" else [("truncated", F.col("total_files") > limit)])
    reasons = F.array_join(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull()), ",")
    risk = F.when((F.col("sensitive") > 0) | (lines > 1000), "high").when(F.col("reasons") != "", "medium").otherwise("low")
    return out.withColumn("reasons", reasons).withColumn("risk", risk).drop("tests", "sources")


def annotations(findings: DataFrame, group: str, order: str, most: int = MOST_ANNOTATIONS) -> DataFrame:
    """A group's first published findings as notes on lines: level by severity, title and message within their limits."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    level = F.when(F.col("severity").isin("critical", "high"), "failure").when(F.col("severity") == "medium", "warning").otherwise("notice")
    rows = findings.filter("publishable").withColumn("__n", n).filter(F.col("__n") <= min(most, MOST_ANNOTATIONS))
    title = F.substring(F.concat(F.upper("severity"), F.lit(": "), F.coalesce("title", F.lit(""))), 1, TITLE_CHARS)
    message = F.substring(F.concat(F.coalesce("claim", F.lit("")), F.lit("\n\nSuggestion: "), F.coalesce("suggestion", F.lit(""))), 1, MESSAGE_CHARS)
    return rows.select(group, "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), level.alias("level"), title.alias("title"), message.alias("message"))


def report(summaries: DataFrame, files: DataFrame, findings: DataFrame, group: str, order: str) -> DataFrame:
    """``group``, markdown: risk, totals, files, reasons and published findings of a group as one text; lists in ``order``."""
    line = lambda text: F.struct(F.col(order).alias("k"), text.alias("text"))
    listed = lambda rows, text, name: rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line(text))), lambda x: x["text"]), "\n").alias(name))
    named = listed(files, F.concat(F.lit("- `"), "path", F.lit("` ("), F.coalesce("status", F.lit("modified")), F.lit(")")), "__files")
    found = listed(findings.filter("publishable"), F.concat(F.lit("- **"), F.upper("severity"), F.lit("** `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` "), "rule_id", F.lit(" (`"), F.substring("fingerprint", 1, 12), F.lit("`)")), "__found")
    rows = summaries.join(named, group, "left").join(found, group, "left")
    text = F.concat(
        F.lit("## Review\n\n**Risk: "), F.upper("risk"), F.lit("**\n\n"), F.col("reviewed_files").cast("string"), F.lit(" of "), F.col("total_files").cast("string"), F.lit(" files, +"), F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"),
        F.lit("\n\n### Files\n\n"), F.coalesce("__files", F.lit("none")), F.lit("\n\n### Risk signals\n\n"), F.when(F.col("reasons") == "", "none").otherwise(F.concat(F.lit("- "), F.replace(F.col("reasons"), F.lit(","), F.lit("\n- ")))), F.lit("\n\n### Findings\n\n"), F.coalesce("__found", F.lit("none")), F.lit("\n"),
    )
    return rows.select(group, text.alias("markdown"))
