"""Quality scores by positive-unlabelled learning: a linear model that minimises the non-negative unbiased risk.

Positives are trusted documents (label 1); unlabelled are web texts without a trusted label. Documents with label 0 take no part:
neither the risk nor the scale of scores learns from them. The risk is the one of du Plessis, Niu and Sugiyama with the
correction of Kiryo and others: with class prior p and logistic loss l,

    p * mean over positives of l(f) + max(0, mean over unlabelled of l(-f) - p * mean over positives of l(-f)),

and where the second term is negative the step goes against it. The prior is estimated by Elkan and Noto's way: a first
model tells positives from unlabelled; a positive's odds there are the sizes' ratio divided by the prior, so the mean score of
held-back positives gives it. Last, scores are shifted so that their mean over the unlabelled is the prior.

Fitting takes a bounded sample (``SAMPLE`` rows of each kind, those with the smallest hashes of doc_id) to the driver as
features, never as text; scoring is a map over all documents. Features are of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.textbatch import buffer_of, lowered, slices, span_hashes, word_spans

#: Rows of each kind (positive, unlabelled) that a fit may take, at most.
SAMPLE = 4000
#: Buckets of hashed word endings.
BUCKETS = 512
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3
N_PLAIN = 15

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>^~\\@_=+{}[]")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain features by text, and hashed word endings as (text, bucket, share of words)."""
    raw, offsets = buffer_of(column)
    starts, stops, first = word_spans(raw, offsets)
    n = len(offsets) - 1
    size, words = np.maximum(np.diff(offsets), 1), np.diff(first)
    many = np.maximum(words, 1)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    word_of = np.repeat(np.arange(n), words)
    per = lambda flags: np.bincount(text_of, weights=flags, minlength=n)
    by_word = lambda flags: np.bincount(word_of, weights=flags, minlength=n) / many
    low = span_hashes(lowered(raw), starts, stops)
    pairs = low[:-1] * np.uint64(3) + low[1:] * np.uint64(7) if len(low) > 1 else low[:0]
    distinct, distinct_pairs = np.zeros(n), np.zeros(n)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        distinct[k] = len(np.unique(low[a:b])) / max(b - a, 1)
        distinct_pairs[k] = len(np.unique(pairs[a : b - 1])) / max(b - 1 - a, 1) if b - a > 1 else 1
    length = stops - starts
    last = raw[stops - 1] if len(stops) else raw[:0]
    lines = per(raw == 10) + 1
    letters = np.maximum(per(_LETTER[raw]), 1)
    plain = np.stack(
        [
            np.ones(n), np.log1p(words) / 5, (words < 50).astype(float), per(_SYMBOL[raw]) / many, per(_MARK[raw]) / many, per(_STOP[raw]) / many, per(_UPPER[raw]) / letters,
            per(_DIGIT[raw]) / size, by_word(length) / 10, distinct, distinct_pairs, by_word(_SYMBOL[last]), by_word(_MARK[last]), by_word((length == 1) & _SYMBOL[last]), np.minimum(words / lines, 200) / 50,
        ],
        axis=1,
    )
    ends = span_hashes(raw, np.maximum(starts, stops - 3), stops) % np.uint64(BUCKETS)
    cell, count = np.unique(word_of * BUCKETS + ends.astype(np.int64), return_counts=True)
    return plain, cell // BUCKETS, cell % BUCKETS, count / many[cell // BUCKETS]


def _dense(plain: np.ndarray, rows: np.ndarray, buckets: np.ndarray, shares: np.ndarray) -> np.ndarray:
    out = np.zeros((len(plain), N_PLAIN + BUCKETS))
    out[:, :N_PLAIN] = plain
    out[rows, N_PLAIN + buckets] = np.sqrt(shares)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def non_negative_risk(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, decay: float = 1e-3) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk by Adam on the whole sample."""
    xp, xu = x[positive], x[unlabelled]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        fp, fu = _sigmoid(xp @ w), _sigmoid(xu @ w)
        right = -prior * xp.T @ (1 - fp) / len(xp)
        wrong = xu.T @ fu / len(xu) - prior * xp.T @ fp / len(xp)
        negative = -np.log1p(-np.minimum(fu, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(fp, 1 - 1e-12)).mean()
        g = right + (wrong if negative >= 0 else -wrong) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, decay: float, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + decay * np.eye(len(w)), x.T @ (y - p) - decay * w)
    return w


def class_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, by a model of which rows carry the positive label."""
    train = np.concatenate([positive[::2], unlabelled[::2]])
    w = logistic(x[train], np.isin(train, positive).astype(float), 1.0)
    c = float(np.clip(_sigmoid(x[positive[1::2]] @ w).mean(), 1e-3, 1 - 1e-3)) if len(positive) > 1 else 0.5
    return float(np.clip(len(positive[::2]) / len(unlabelled[::2]) * (1 - c) / c, 0.05, 0.95))


def _shift(f: np.ndarray, prior: float) -> float:
    """What to add to ``f`` so that the mean score is ``prior``."""
    low, high = -40.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(f + middle).mean() < prior else (low, middle)
    return (low + high) / 2


def fit(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a score from features and labels (1: positive, -1: unlabelled; others take no part).

    Without positives or without unlabelled rows every score is one half.
    """
    positive, unlabelled = np.flatnonzero(label == 1), np.flatnonzero(label == -1)
    if not len(positive) or not len(unlabelled):
        return np.zeros(x.shape[1])
    prior = class_prior(x, positive, unlabelled)
    w = non_negative_risk(x, positive, unlabelled, prior)
    w[0] += _shift(x[unlabelled] @ w, prior)
    return w


def _feature_rows(docs: DataFrame, *extra: str) -> DataFrame:
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = _dense(*features(part.column("text"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), pa.array([r.tobytes() for r in x], pa.binary())], names=[*extra, "x"])

    return docs.select("text", *extra).mapInArrow(run, kinds + ", x binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` documents of each kind, none of them held out.

    Labels other than 0 and 1, and null ones, count as none; a document with two labels counts by the larger, and a doc_id with
    several texts is learned from by the first of them in the order of bytes.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    open_labels = known.filter(~held_out(F.col("doc_id")))
    chosen = open_labels.filter("label = 1").orderBy(order, "doc_id").limit(sample)
    free = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").join(known, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(-1).alias("label"))
    picked = F.broadcast(chosen.unionByName(free))  # 2 * sample rows at most
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = _feature_rows(texts, "doc_id", "label").toArrow()
    if not rows.num_rows:
        return np.zeros(N_PLAIN + BUCKETS)
    rows = rows.sort_by("doc_id")
    x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in rows.column("x")]).astype(np.float64)
    return fit(x, np.asarray(rows.column("label")))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on): one row for each row of ``docs``.

    Null and empty texts are scored as texts without words. Rows that share a doc_id are scored one by one.
    """
    w, key = train(docs, labels, sample), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                plain, rows, buckets, shares = features(part.column("text"))
                f = plain @ w[:N_PLAIN] + np.bincount(rows, weights=np.sqrt(shares) * w[N_PLAIN + buckets], minlength=len(plain))
                score = _sigmoid(f)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {key}, held_out boolean, score double, predicted int")
