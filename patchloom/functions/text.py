"""Column functions on paths, names and secrets. All run inside the JVM; patterns avoid what RE2 lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, lists and constants that results depend on.
TEST_PATH = r"(?i)(^|/)(__tests__|test|tests|spec)(/|\.|$)|(^|/)([^/]*\.(test|spec)\.[jt]sx?|[^/]*_test\.go)$"
HIGH_RISK_PATH = r"(?i)(^|/)(auth|payment|billing|security|migration|database|permission)(/|\.|$)"
LANGUAGES = (
    ("go", r"\.go$"), ("typescript", r"\.(ts|tsx|mts|cts)$"), ("javascript", r"\.(js|jsx|mjs|cjs)$"), ("java", r"\.java$"), ("kotlin", r"\.(kt|kts)$"), ("python", r"\.(py|pyi|pyw)$"), ("csharp", r"\.cs$"),
    ("c", r"\.(c|h)$"), ("cpp", r"\.(cc|cpp|cxx|hh|hpp|hxx)$"), ("rust", r"\.rs$"), ("php", r"\.(php|phtml)$"), ("ruby", r"\.(rb|rake)$"), ("swift", r"\.swift$"),
)
ROLES = (
    ("test", r"(^|/)(test|tests|__tests__|src/test)(/|$)|(test|spec)\.[^.]+$"),
    ("build", r"(^|/)(pom\.xml|build\.gradle(\.kts)?|settings\.gradle(\.kts)?|package\.json|go\.mod|cargo\.toml)$"),
    ("documentation", r"\.(md|adoc|rst|txt)$"),
    ("configuration", r"\.(ya?ml|toml|json|properties|conf|ini|xml)$"),
    ("source", r"\.(java|kt|kts|ts|tsx|js|jsx|go|rs|py|cs|cpp|c|h|hpp)$"),
)
PLAIN_REDACTIONS = (
    (r"-----BEGIN [^-]+-----[\s\S]*?-----END [^-]+-----", "[REDACTED_PEM]"),
    (r"(?i)bearer\s+[a-z0-9._~+/-]{8,}", "Bearer [REDACTED]"),
    (r"(?i)(api[_-]?key|token|secret|password|private[_-]?key)(\s*[:=]\s*)[^\s,;]+", "$1$2[REDACTED]"),
)
VENDOR_REDACTIONS = (
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[REDACTED GITHUB TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED AWS ACCESS KEY]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}\b", "Bearer [REDACTED]"),
    (r"""(?i)(\b(?:password|passwd|api[_-]?key|secret|access[_-]?token)\b\s*[:=]\s*['"]?)[^'"\s,;]{8,}(['"]?)""", "$1[REDACTED]$2"),
)
SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
Z95 = 1.959963984540054


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` with every ``\b`` as a boundary of ``\w`` (ASCII), as in RE2, Go and JavaScript: Java's, before 19, also counts letters such as é."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def _first(value: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(table):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def language_of_path(path: Column) -> Column:
    """Language by extension, else null."""
    return _first(F.lower(path), LANGUAGES)


def file_role(path: Column) -> Column:
    """test, build, documentation, configuration, source or other, in that order of precedence."""
    return F.coalesce(_first(F.lower(path), ROLES), F.lit("other"))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_high_risk_path(path: Column) -> Column:
    return path.rlike(HIGH_RISK_PATH)


def redact(value: Column, rules=PLAIN_REDACTIONS) -> Column:
    """Secrets replaced, rule after rule; null gives an empty text."""
    return reduce(lambda v, r: F.regexp_replace(v, ascii_bounds(r[0]), r[1]), rules, F.coalesce(value, F.lit("")))


def is_clean(value: Column) -> Column:
    """Whether ``redact`` leaves a text as it is (null as empty). Texts without a sign that each rule needs are clean without its patterns."""
    text = F.coalesce(value, F.lit(""))
    may = text.contains(":") | text.contains("=") | text.contains("-----BEGIN ") | F.lower(text).contains("bearer")
    return ~may | (redact(text) == text)


def is_safe_path(path: Column) -> Column:
    """Relative, with forward slashes, without a drive, NUL, or empty, ``.`` or ``..`` segments."""
    segments = F.split(path, "/")
    bad = F.exists(segments, lambda s: (s == "") | (s == ".") | (s == ".."))
    return F.coalesce(~(path.contains("\\") | path.contains("\0") | path.rlike("^[A-Za-z]:") | bad), F.lit(False))


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    out, k = "", 0
    while k < len(glob):
        for sign, pattern in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(sign, k):
                out, k = out + pattern, k + len(sign)
                break
        else:
            c = glob[k]
            out, k = out + ("\\" + c if c in r"\.[]{}()+-^$|" else c), k + 1
    return f"^{out}$"


def path_included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Matched by any include (or there is none to match) and by no exclude."""
    hit = lambda globs: reduce(lambda a, g: a | path.rlike(glob_pattern(g)), globs, F.lit(False))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def name_tokens(name: Column) -> Column:
    """Distinct lower-case parts of a name, cut at case changes and other characters, of three letters and more."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def simple_name(qualified: Column) -> Column:
    """The last part of a qualified name, lower-case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(qualified, r"[.#:$]+$", ""), r"[.#:$]"), -1))


def severity_rank(severity: Column) -> Column:
    return reduce(lambda out, x: F.when(severity == x[0], x[1]).otherwise(out), SEVERITIES.items(), F.lit(0))


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, to 4 decimals; 0 to 1 without cases."""
    side = lambda x, none: F.when(total == 0, F.lit(none)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4))
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total.cast("double"))
    p = hits.cast("double") / safe
    centre = (p + Z95 * Z95 / (2 * safe)) / (1 + Z95 * Z95 / safe)
    margin = Z95 * F.sqrt((p * (1 - p) + Z95 * Z95 / (4 * safe)) / safe) / (1 + Z95 * Z95 / safe)
    return side(centre - margin, 0.0), side(centre + margin, 1.0)


def evaluation_category(category: Column, rule_id: Column) -> Column:
    """The category with underscores, else what the rule's id says."""
    by_rule = F.when(rule_id.startswith("human/"), F.regexp_replace(rule_id, "^human/", "")).otherwise(F.split_part(rule_id, F.lit("/"), F.lit(1)))
    return F.regexp_replace(F.coalesce(F.nullif(category, F.lit("")), by_rule), "-", "_")


def evidence_id(value: Column, most: int = 300) -> Column:
    """A short id as it is, a longer one as its hash."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.lit("evidence:sha256:"), F.sha2(value, 256)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """All before the last slash, empty without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension_of(path: Column) -> Column:
    """The last dot of the last part and what follows, lower-case; empty without one, or where the dot begins the part."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def canonical_digest(fields: dict[str, Column]) -> Column:
    """The hash of fields as JSON, keys in order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def embedded_json(text: Column) -> Column:
    """What stands in the first fenced block, of JSON or without a name, else the whole text, trimmed."""
    fenced = F.regexp_extract(text, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)
    return F.regexp_replace(F.when(text.rlike(r"(?i)```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(text), r"^\s+|\s+$", "")


def scope_hash(paths: Column) -> Column:
    """The hash of an array of paths, whatever its order."""
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)
