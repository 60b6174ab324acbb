import random

import numpy as np
import pytest

import corpus_pipeline
from patchloom.llm import gru, lm_scoring
from patchloom.llm import html_text
from patchloom.llm.html_text import blocks_of, extract_main_text, texts_of
from patchloom.llm.near_duplicates import link_components, matches_at, near_at
from patchloom.llm.pii import spans_of, trained
from tests.llm.test_dedup import near_copies, shingles


def components_at(rows, percent):
    sets, up = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_components_at_80_equal_brute_force(spark):
    rnd, rows = random.Random(3), near_copies(8)
    for k in range(60):  # pairs about the bound
        words = [f"p{k}w{x}" for x in range(104)]
        rows.append((2000 + 2 * k, " ".join(words)))
        for at in rnd.choice(([20, 60], [20, 60, 80], [20, 24], [30], [5, 40, 70, 90])):
            words[at] += "x"
        rows.append((2001 + 2 * k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (80, 85):
        assert {r.doc_id: r.component_id for r in link_components(frame, percent).collect()} == components_at(rows, percent)
    assert (matches_at(85), near_at(85), matches_at(80)) == (38, 40, 34)
    with pytest.raises(ValueError):
        link_components(frame, 79)


def test_pipeline_drops_copies_at_80(spark, tmp_path):
    words = [f"w{k}" for k in range(104)]
    copy = [w + "x" if k in (20, 60) else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, "quite another text than the two others")]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 80 <= 100 * len(a & b) / len(a | b) < 85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_every_window_is_learned_from():
    lay = gru.Layout(np.array([30, 20, 10, 8]))
    trainer = gru.Trainer(gru.fresh(lay), lay, 0.1, lanes=1)
    before = trainer.sum["embed"].copy()
    ids = np.repeat(np.arange(4), gru.WINDOW).astype(np.int32)  # each window has words of its own
    trainer.learn(ids, np.array([0]), np.array([len(ids)]))
    assert (trainer.sum["embed"] > before)[:4].any(axis=1).all()
    assert (lm_scoring.WORDS, lm_scoring.CLUSTERS) == (2000, 256)


def test_repeats_inside_articles_go():
    notice = "this story is brought to you by the friends of our paper"
    page = "<nav>menu</nav><article><p>unique text {0} of page {0} and more {0}</p><div>{1}</div></article>"
    got = texts_of([blocks_of(page.format(k, notice)) for k in range(30)])
    assert got == [f"unique text {k} of page {k} and more {k}" for k in range(30)]
    quoted = texts_of([blocks_of(page.format(k, notice if k < 4 else f"other {k}")) for k in range(30)])
    assert quoted[0].endswith(notice)  # a quotation on few pages stays


def test_runs_go_on_over_short_blocks():
    menu = "".join(f"<li>{w}</li>" for w in "Home News Sport Contact About Terms Privacy Login".split())
    page = "<ul class=links>{1}</ul><div>page {0} says {0} in its own words {0}</div><div>(c) Our Paper</div><div>All rights reserved here and there</div>"
    assert texts_of([blocks_of(page.format(k, menu)) for k in range(5)]) == [f"page {k} says {k} in its own words {k}" for k in range(5)]


def test_repeats_count_over_the_whole_host(spark, monkeypatch):
    notice = "one notice of the section that stands on six pages"
    rows = [(k, f"https://h.example.com/{k}", f"<div>page {k} says {k} of its own {k}</div>" + (f"<div>{notice}</div>" if k % 10 == 0 else "")) for k in range(60)]
    monkeypatch.setattr(html_text, "GROUP_PAGES", 4)
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(k, f"page {k} says {k} of its own {k}") for k in range(60)}


def test_secrets_without_digits_are_found():
    w = np.array(trained())
    text = "the password: correct-horse-battery was set. Then token=abcdefGHIJKL came. Later they typed correct-horse-battery, and abcdefGHIJKL again."
    found = [text[a:b] for a, b in spans_of(text, w)[4]]
    assert found == ["password: correct-horse-battery", "token=abcdefGHIJKL", "correct-horse-battery", "abcdefGHIJKL"]
    for clean in ("the key role of a password reset", "a secret garden and the token economy, key principles", "key: value", "no secret is well-established here"):
        assert spans_of(clean, w)[4] == [], clean
