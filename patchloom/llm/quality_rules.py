"""Line-first quality rules with DataFrame functions only: no Python runs on the executors.

Rules on punctuation, navigation and boilerplate are evaluated line by line, failing lines are removed, and a
document that loses too much of its text is rejected. Every step works on one row, so the plan is a scan and
projections: no shuffle, and nothing to skew. A very long text costs time in proportion to n log n words.

Nulls and empty texts have no words and no lines; they fail the base rule on length. Rows that share a doc_id
are judged one by one. Only ``doc_id`` and ``text`` are read; other columns pass through ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"
_SHOUT = r"[!?]{2}([\x20\x09-\x0D]|$)"
_ANY_MARK, _MARK = r"[|»›·•→>/]", r"^[|»›·•→>/]$"

#: Fixed values. Phrases of cookie bars, legal lines, share bars and script warnings.
BOILERPLATE = (
    r"(?i)(^|[^a-z])(all rights reserved|cookie (policy|settings|consent)|we use cookies|privacy policy|terms of (use|service)"
    r"|lorem ipsum|enable javascript|subscribe to our newsletter|click here to|share (this|on) (facebook|twitter)"
    r"|alle rechte vorbehalten|datenschutzerklärung|tous droits réservés|todos los derechos reservados)([^a-z]|$)"
)

#: A document fails with fewer words than this.
MIN_WORDS = 50
#: Per cent of words in repeated 3-word windows above which a document fails.
MAX_REPEATED = 50
#: Symbols a word above which a line fails.
LINE_SYMBOLS = 0.25
#: Share of words that end in doubled exclamation or question marks above which a line fails.
LINE_SHOUTS = 0.3
#: Bars, arrows and dots between entries that make a line navigation, when they are a quarter of its words.
NAV_MARKS = 3
#: Share of a document's characters in words that must be left.
MIN_LEFT = 0.6


def _size_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """True if a line breaks a rule; a line without words never does, as it holds no text to lose."""
    chars = F.length(line)
    words = F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _SPACE + "+"))
    symbols = chars - _size_without(line, _SYMBOL)
    shouts = (chars - F.length(F.regexp_replace(line, _SHOUT, "$1"))) / 2
    marks = F.when(line.rlike(_ANY_MARK), F.size(F.filter(F.split(line, " "), lambda w: w.rlike(_MARK)))).otherwise(0)
    return (
        (symbols > LINE_SYMBOLS * words)
        | (shouts > LINE_SHOUTS * words)
        | ((marks >= NAV_MARKS) & (4 * marks >= words))
        | line.rlike(BOILERPLATE)
        | ~line.rlike(r"\p{L}|\p{N}")
    ) & line.rlike(_WORD)


def repeated_words(words: Column, ranked: Column) -> Column:
    """How many words lie in a 3-word window found twice or more.

    ``ranked`` holds (hash, place) of every window in order. Windows of one 64-bit hash stand side by side, and their
    words are compared: unequal windows are never taken for equal. A repeated one could be missed only where windows of other
    words share its hash and stand between all of its places.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (words[a["i"]] == words[b["i"]]) & (words[a["i"] + 1] == words[b["i"] + 1]) & (words[a["i"] + 2] == words[b["i"] + 2])

    n = F.size(ranked)
    again = F.filter(ranked, lambda x, k: F.when(k > 0, same(x, F.get(ranked, k - 1))).otherwise(False) | F.when(k < n - 1, same(x, F.get(ranked, k + 1))).otherwise(False))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def rule_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and verdicts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines_removed, left_chars, kept; helper columns are dropped again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    helpers = ["__words", "__lines", "__good", "__ranked", "__again"]
    counted = (
        docs.withColumn("__words", F.filter(F.split(text, _SPACE + "+"), lambda x: x != ""))
        .withColumn("__lines", lines)
        .withColumn("__good", F.filter("__lines", lambda x: ~line_fails(x)))
    )
    size = F.size("__words")
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i"))))
    counted = counted.withColumn("__ranked", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    counted = counted.withColumn("__again", repeated_words(F.col("__words"), F.col("__ranked")))
    covered = F.aggregate(F.transform("__again", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("__again", k + 1) - v, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = counted.select(
        *docs.columns,
        size.cast("long").alias("n_words"),
        _size_without(text, _SPACE + "+").cast("long").alias("word_chars"),
        (F.length(text) - _size_without(text, _SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (F.size("__lines") - F.size("__good")).cast("long").alias("n_lines_removed"),
        F.aggregate("__good", F.lit(0).cast("long"), lambda a, x: a + _size_without(x, _SPACE + "+")).alias("left_chars"),
        F.array_join("__good", "\n").alias("__clean"),
        F.monotonically_increasing_id().alias("__number"),
    )
    assert not set(helpers) & set(counted.columns)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("left_chars") >= MIN_LEFT * F.col("word_chars")))


def quality_report(docs: DataFrame) -> DataFrame:
    """A row for each document: its counts, whether the base rules fail it, and whether it is kept."""
    return rule_columns(docs.select("doc_id", "text")).drop("text", "__clean", "__number")


def clean_documents(docs: DataFrame, drop_lines: bool = False) -> DataFrame:
    """The kept documents with their own columns; with ``drop_lines`` their failing lines are gone too."""
    judged = rule_columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text"))
    # a filter on a numbered row stays above the counts: below them each test would count the words anew
    judged = judged.filter(F.col("kept") & (F.col("__number") >= 0))
    row = F.col("__row")
    if drop_lines:
        row = row.withField("text", F.when(F.col("n_lines_removed") > 0, F.col("__clean")).otherwise(F.col("text")))
    return judged.select(row.alias("__row")).select("__row.*")
