import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from patchloom.llm import gru
from patchloom.llm.lm_scoring import score_documents
from patchloom.llm.saved import saved


def test_gradients_equal_differences():
    lay = gru.Layout(np.array([30, 20, 10, 8, 5, 4, 2, 1]))
    rng = np.random.default_rng(1)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in gru.fresh(lay).items()}
    lengths = np.array([6, 4, 3])
    ids, starts = rng.integers(0, 8, 13).astype(np.int32), np.array([0, 6, 10])
    trainer = gru.Trainer(p, lay, 0.0, lanes=3)
    before = {k: v.copy() for k, v in trainer.sum.items()}
    trainer.learn(ids, starts, lengths)
    full = 3 * gru.WINDOW
    loss = lambda q: -float(gru.score(q, lay, ids, starts, lengths).astype(np.float64).sum()) / full
    for name in ("wx", "wh", "wc", "wo", "bo", "embed"):
        at = np.unravel_index(int(np.argmax(trainer.sum[name])), p[name].shape)
        q, r = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        q[name][at] += 0.01
        r[name][at] -= 0.01
        slope = (loss(q) - loss(r)) / 0.02
        assert math.sqrt(trainer.sum[name][at] - before[name][at]) == pytest.approx(abs(slope), rel=0.05), name


def test_probabilities_sum_to_one():
    lay = gru.Layout(np.array([9, 5, 5, 3, 1]))
    p = gru.fresh(lay)
    total = sum(math.exp(gru.score(p, lay, np.array([2, k], np.int32), np.array([0]), np.array([2]))[1]) for k in range(5))
    assert total == pytest.approx(1, abs=1e-5)


def test_scores(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    kinds = [[f"{c}{k}" for k in range(300)] for c in "xy"]
    docs = [(100 + k, " ".join(rng.choice(kinds[k % 2], 60, p=np.arange(300, 0, -1) / 45150))) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows = score_documents(frame).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in frame.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, n_end = Counter(), 0
    for i, words in texts:
        if not held(i):
            c.update(words)
            n_end += 1
    n, v = sum(c.values()) + n_end, len(c) + 1
    base = lambda words: sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in words), n_end])
    want = Counter((i, held(i), len(w) + 1, sum(x in c for x in w) + 1, n, round(base(w), 5)) for i, w in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    own = [r for r in rows if r.held_out and (r.doc_id or 0) >= 100]
    assert own and all(np.isfinite(r.score) for r in rows) and sum(r.score for r in own) > sum(r.base_score for r in own)
    assert score_documents(no_docs).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    text = lambda k: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) + "." for _ in range(4))
    clean = [(k, text(k)) for k in range(12)]
    passage = " ".join(f"shared{k}" for k in range(12))
    rows = [(k, t + ("\n" + passage if k in (2, 5) else "") + ("\nWrite to me@x.example.com now." if k == 7 else "")) for k, t in clean]
    rows += [(20, rows[1][1]), (21, "too short"), (22, " ".join(f"w{k}### v{k}$$$" for k in range(80))), (23, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, got = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        got[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "best_fit_packing" or docs.columns == columns
    assert set(got["quality_rules"]) == {*range(12), 20} and set(got["minhash_near_dedup"]) == set(range(12))
    cut = {i: r.text for i, r in got["suffix_array_dedup"].items()}
    assert passage in cut[2] and "shared5" not in cut[5] and cut[0] == rows[0][1]
    assert got["pii"][7].text.endswith("<email> now.") and got["pii"][7].n_chars == len(got["pii"][7].text)
    assert set(got["best_fit_packing"]) == set(range(12))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(12))
