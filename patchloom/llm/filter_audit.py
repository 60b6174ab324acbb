"""How filters of documents act on each other: in every order of them, what each step removes, repeats and costs.

A scan task reads each Arrow batch's text buffer as bytes. Tables of byte classes and prefix sums over them give words,
capitals, symbols and code points of all documents of a slice at once; the word hashes of each document are sorted and
equal neighbours compared byte by byte, which gives its distinct words. A document leaves the scan as a mask of the filters
that it fails, its label bits and a SHA-256 of its text; everything after that is counts of masks. Documents of one text meet by
that hash after they have been added up by part and labels, so a text that a third of all documents share is a few rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.textbatch import buffer_of, release, slices, span_hashes, word_spans
from patchloom.sources.saved import saved

#: Fewest words; least distinct words and most capitals in a hundred words or code points; characters that aren't allowed.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
#: The filters by letter: short, repetitive, shouting, with symbols, copies. A filter's bit is its place.
LETTERS = "ABCDE"
#: Bytes of text whose words are hashed at once, and bytes of words compared at once.
HASH_BYTES, COMPARE_BYTES = 1 << 20, 1 << 21

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_MASKS = "doc_id long, part string, mask int, digest binary"


def _totals(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked, by prefix sums."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word; a long text goes in runs of words, so its hashes are all that is held."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    cuts = [0, *(np.flatnonzero(np.diff(starts // HASH_BYTES)) + 1).tolist(), len(starts)]
    for a, b in itertools.pairwise(cuts):
        low, high = starts[a], stops[b - 1]
        out[a:b] = span_hashes(raw[low:high], starts[a:b] - low, stops[a:b] - low)
    return out


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of spans of ``size`` bytes from ``a`` and ``b`` on differ in a byte."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARE_BYTES, "right")))
        n = size[at:upto]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unequal = raw[np.repeat(a[at:upto], n) + step] != raw[np.repeat(b[at:upto], n) + step]
        out[at + np.unique(np.repeat(np.arange(len(n)), n)[unequal])] = True
        at = upto
    return out


def distinct_words(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each text; text i has the words ``first[i]`` up to ``first[i + 1]``.

    Hashes are sorted within their text and equal neighbours verified. A text in which two words share a hash is counted
    again word by word, so the result doesn't depend on the hash.
    """
    n_words = np.diff(first)
    n, size = len(n_words), stops - starts
    hashes = _hashes(raw, starts, stops) if hashes is None else hashes
    text = np.repeat(np.arange(n), n_words)
    order = np.lexsort((hashes, text)) if n >= 1 << 20 else np.argsort(text.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    left, right = order[:-1], order[1:]
    equal = (text[left] == text[right]) & (hashes[left] >> np.uint64(20) == hashes[right] >> np.uint64(20))
    left, right = left[equal], right[equal]
    clash = size[left] != size[right]
    same = np.flatnonzero(~clash)
    clash[same] = _differ(raw, starts[left[same]], starts[right[same]], size[left[same]])
    out = n_words - np.bincount(text[left], minlength=n)
    for t in np.unique(text[left[clash]]):
        words = range(first[t], first[t + 1])
        out[t] = len({raw[starts[w] : stops[w]].tobytes() for w in words})
    return out


def masks_of(column: pa.Array, symbols: str = SYMBOLS) -> tuple[np.ndarray, list[bytes]]:
    """The first four filters' bits of each text, and its SHA-256; a null is an empty text."""
    raw, offsets = buffer_of(column)
    starts, stops, first = word_spans(raw, offsets)
    n_words = np.diff(first)
    symbol = np.zeros(256, bool)
    symbol[list(symbols.encode("ascii"))] = True
    capitals, signs, points = (_totals(table[raw], offsets) for table in (_CAPITAL, symbol, _FIRST_BYTE))
    fails = (n_words < MIN_WORDS, 100 * distinct_words(raw, starts, stops, first) < MIN_DISTINCT * n_words, 100 * capitals > MAX_CAPITALS * points, signs > 0)
    mask = sum(bad.astype(np.int32) << bit for bit, bad in enumerate(fails))
    view = memoryview(raw)
    return mask, [hashlib.sha256(view[a:b]).digest() for a, b in itertools.pairwise(offsets.tolist())]


def filter_masks(documents: DataFrame) -> DataFrame:
    """doc_id, part (lang, a null as the empty string), mask (bits of A to D), digest (SHA-256 of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                mask, digest = masks_of(rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])
        release()

    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, _MASKS)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, E included, and how many have each label.

    E is a text that a smaller doc_id has too. Documents without a doc_id have nothing before them and no label; those that
    share doc_id and text are not before each other. A label counts if any row of ``labels`` for that doc_id has it.
    """
    rows = masks.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_bare"))
    least = F.min("low").over(Window.partitionBy("digest"))
    fresh = F.col("n_bare") + F.when(F.col("low") == least, F.col("n_low")).otherwise(0)
    copy = 1 << LETTERS.index("E")
    both = texts.withColumn("fresh", fresh).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("one"))
    kept = both.select("part", "good", "toxic", "one.*").filter("n > 0")
    return kept.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def steps_of(letters: str) -> list[dict]:
    """Every order of the filters, step by step: its name, the step, the bits of the filters before it and its own."""
    out = []
    for order in itertools.permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "bit": bit})
            before |= bit
    return out


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and what the step does, for every order of ``letters``; ``counts`` has part, mask, n, good, toxic.

    A part has two to the power of the letters masks at most, and each mask meets each step once. ``shapley``: a document that
    fails k filters is removed by each of them in a k-th of all orders.
    """
    n_orders = len(set(itertools.permutations(letters)))
    steps = F.from_json(F.lit(json.dumps(steps_of(letters))), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    rows = counts.select("*", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    earlier, own = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    n = F.col("n")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~own, n).alias("kept"), total(~earlier & own, n).alias("removed"), total(earlier & own, n).alias("redundant"), total(F.col("mask") == F.col("bit"), n).alias("unique_fails"),
        total(~earlier & own, F.col("good")).alias("good_lost"), total(~earlier & own, F.col("toxic")).alias("toxic_lost"), total(own, n * F.lit(n_orders) / F.bit_count("mask")).alias("shapley"),
    )


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, zeros included; no documents give no rows.

    ``documents`` (doc_id, text, lang), ``labels`` (doc_id, quality, toxic); other columns don't matter. A null text is empty, a null
    lang the empty string, a null label none. Every row of ``documents`` counts, repeated rows too.
    """
    return interactions(mask_counts(saved(filter_masks(documents), "filter_masks"), labels))
