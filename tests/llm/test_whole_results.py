"""Results of whole queries against plain versions: nothing hangs on partitions, groups or blocks."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import gru, html_text, lm_scoring
from patchloom.llm.html_text import ARTICLE, OTHER, blocks_of, extract_main_text
from patchloom.llm.lm_scoring import score_documents
from patchloom.llm.near_duplicates import link_components
from patchloom.llm.packing import BestFit
from patchloom.llm.quality_classifier import score_quality
from tests.llm.test_dedup import brute_components

FOLDER = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


# --- language model ---


def test_scores_dont_hang_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.5, int(rng.integers(0, 200))) % 5000)) for k in range(300)] + [(None, "no id"), (7, "an id twice"), (400, " ".join(f"w{k % 50}" for k in range(9000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("patchloom.llm.lm_scoring.BLOCK_BYTES", 20_000)  # several blocks, several copies
    one, eight = ({(r.doc_id, r.n_tokens): r for r in score_documents(x).collect()} for x in (docs.coalesce(1), docs.repartition(8, "text")))
    assert set(one) == set(eight) and len(one) == len(rows)
    for k, r in one.items():
        assert eight[k].base_score == pytest.approx(r.base_score, rel=1e-9) and eight[k].score == pytest.approx(r.score, rel=1e-4)


def test_lanes_hold_every_document_once():
    rng = np.random.default_rng(2)
    for mixed in (False, True):
        lengths = np.concatenate([rng.integers(1, 60, 300), [5000, 1]])
        lane, place, filled = gru.lanes_of(lengths, 16, mixed)
        seen = Counter()
        for k in range(16):
            own = np.flatnonzero(lane == k)
            own = own[np.argsort(place[own])]
            assert place[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist() and lengths[own].sum() == filled[k]
            seen.update(own.tolist())
        assert set(seen.values()) == {1} and len(seen) == len(lengths) and (np.diff(filled) <= 0).all() and filled[0] == 5000


def plain_log_probs(p, lay, ids):
    """One token after the other: log-probabilities of a document's ids, and the last state."""
    p, d = {k: v.astype(np.float64) for k, v in p.items()}, gru.WIDTH
    h, last, out = np.zeros(d), lay.n, []
    softmax_at = lambda x, k: x[k] - np.log(np.exp(x).sum())
    for word in ids.tolist():
        x = p["embed"][last] @ p["wx"] + p["b"]
        r, z = np.split(1 / (1 + np.exp(-x[: 2 * d] - h @ p["wh"][:, : 2 * d])), 2)
        n = np.tanh(x[2 * d :] + (r * h) @ p["wh"][:, 2 * d :])
        h = (1 - z) * n + z * h
        c = lay.of[word]
        lo, hi = lay.first[c], lay.last[c]
        out.append(softmax_at(h @ p["wc"] + p["bc"], c) + softmax_at(p["wo"][lo:hi] @ h + p["bo"][lo:hi], word - lo))
        last = word
    return np.array(out), h


def test_scores_and_states_equal_a_plain_loop_over_whole_documents():
    rng = np.random.default_rng(4)
    lay = gru.Layout(np.sort(rng.integers(1, 500, 60))[::-1])
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in gru.fresh(lay).items()}
    lengths = np.array([3000, 1, 40, 700, 17, 16, 900])
    ids, starts = rng.integers(0, 60, lengths.sum()).astype(np.int32), np.cumsum(lengths) - lengths
    got = gru.score(p, lay, ids, starts, lengths)
    for a, n in zip(starts, lengths, strict=True):
        want, _ = plain_log_probs(p, lay, ids[a : a + n])
        assert np.abs(got[a : a + n] - want).max() < 1e-3
    trainer, states = gru.Trainer(p, lay, 0.0, lanes=1), []
    window = trainer._window
    trainer._window = lambda *x: (states.append(window(*x)), states[-1])[1]
    trainer.learn(ids[:3000], starts[:1], lengths[:1])
    assert len(states) == -(-3000 // gru.WINDOW)
    assert np.abs(states[-1][0] - plain_log_probs(p, lay, ids[:3000])[1]).max() < 1e-4  # carried from the first token on


# --- pages ---


def plain_texts(pages):
    """Main texts of one host's pages by counting every run of tokens in a dictionary."""
    run, least, long_run, many = html_text.RUN, html_text.PAGES, html_text.ARTICLE_RUN, html_text.ARTICLE_PAGES
    streams = [[(w, kind, b) for b, (kind, text) in enumerate(page) for w in text.split(" ")] for page in pages]
    where, outside = defaultdict(set), set()
    for n, s in enumerate(streams):
        for k in range(len(s) - run + 1):
            key = tuple(x[0] for x in s[k : k + run])
            where[key].add(n)
            if s[k][1] != ARTICLE:
                outside.add(key)
    out = []
    for n, (page, s) in enumerate(zip(pages, streams, strict=True)):
        keys = [tuple(x[0] for x in s[k : k + run]) if k + run <= len(s) else None for k in range(len(s))]
        count = [len(where[x]) if x else 0 for x in keys]

        def covered(kind, limit):
            inside, any_ = [False] * len(s), [False] * len(s)
            for k, c in enumerate(count):
                if c >= limit:
                    for i in range(k, k + run):
                        any_[i] = True
                        inside[i] |= s[k][2] == s[k + run - 1][2]
            bare = {x[2] for x, hit in zip(s, any_, strict=True) if not hit}
            gone = [(i or x[2] not in bare) and x[1] == kind for i, x in zip(inside, s, strict=True)]
            return [False] * len(s) if sum(gone) > html_text.COPY_SHARE * sum(x[1] == kind for x in s) else gone

        gone = [a or b for a, b in zip(covered(OTHER, least), covered(ARTICLE, many), strict=True)]
        known = [c >= least and k in outside and x[1] == ARTICLE for c, k, x in zip(count, keys, s, strict=True)]
        k = 0
        while k < len(s):
            end = k
            while end < len(s) and known[end]:
                end += 1
            if end > k and end - k + run - 1 >= long_run:
                for i in range(k, end + run - 1):
                    gone[i] |= s[i][1] == ARTICLE
            k = max(end, k + 1)
        kept, wanted = defaultdict(list), ARTICLE if any(kind == ARTICLE for kind, _ in page) else OTHER
        for x, g in zip(s, gone, strict=True):
            if x[1] == wanted and not g:
                kept[x[2]].append(x[0])
        out.append("\n".join(" ".join(kept[b]) for b in sorted(kept)))
    return out


def made_pages(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    shared = [" ".join(word() for _ in range(rnd.randint(6, 40))) for _ in range(6)]
    pages = []
    for k in range(70):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 7))]
        tags = rnd.choice((("<article>", "</article>"), ("<div>", "</div>")))
        html = "".join(f"<{t}>{p}</{t}>" for p in parts[:-1] for t in (rnd.choice(("p", "li", "div")),))
        pages.append((k // 2 if k % 9 == 0 else k, f"https://{rnd.choice(('a', 'a', 'a', 'b'))}.example.com/{k % 50}", f"<div>{parts[-1]}</div>{tags[0]}{html}{tags[1]}"))
    return pages + [(900, None, None), (901, "", ""), (902, "nothing", "<p>x</p>"), (902, "nothing", "<p>x</p>")]


def by_host(rows):
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        hosts[(url or "").split("/")[2] if "://" in (url or "") else ""].append((page_id, url, html))
    want = Counter()
    for own in hosts.values():
        want.update(zip([r[0] for r in own], [r[1] for r in own], plain_texts([blocks_of(r[2] or "") for r in own]), strict=True))
    return want


@pytest.mark.parametrize("group", [2048, 10])
def test_texts_equal_counting_all_runs(spark, monkeypatch, group):
    """Whatever the groups of a large host, runs are those of all its pages; rows that repeat a page and url are pages of their own."""
    monkeypatch.setattr(html_text, "GROUP_PAGES", group)
    monkeypatch.setattr(html_text, "PACK_BYTES", 2000)
    rows = made_pages(group)
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == by_host(rows) and all(r.n_chars == len(r.text) for r in got)


@with_tables
def test_texts_of_the_table_equal_counting_all_runs(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = by_host([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert Counter((r.page_id, r.url, r.text) for r in extract_main_text(pages).collect()) == want


def test_a_very_long_page(spark):
    html = "<article>" + "".join(f"<p>{' '.join(f'u{k}x{i}' for i in range(50))}</p>" for k in range(4000)) + "</article>"
    row = extract_main_text(spark.createDataFrame([(1, "https://h.example.com/1", html)], "page_id long, url string, html string")).first()
    assert row.text.count("\n") == 3999 and row.n_chars == len(row.text)
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- the others ---


def test_best_fit_equals_a_plain_one():
    rnd = random.Random(4)
    for limit in (1, 5, 1000):
        fit, bins, open_ = BestFit(64, limit), [], []
        for _ in range(600):
            n = rnd.randint(1, 64)
            number, at = fit.place(n)
            fitting = [b for b in open_ if 64 - bins[b] >= n]
            if fitting:  # the fullest that has room, whichever of equals
                assert number in fitting and bins[number] == max(bins[b] for b in fitting) == at
            else:
                assert number == len(bins) and at == 0
                bins.append(0)
                open_.append(number)
            bins[number] += n
            if bins[number] == 64:
                open_.remove(number)
            if len(open_) > limit:  # one of the fullest closes; see which by what the operator holds open
                held = {b for stack in fit.stacks for b in stack}
                (closed,) = set(open_) - held
                assert bins[closed] == max(bins[b] for b in open_)
                open_.remove(closed)


@with_tables
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


@with_tables
def test_all_links_of_the_table_are_found(spark):
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in link_components(docs).collect()} == want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_long_texts_and_clashing_names(spark, tmp_path):
    rng = np.random.default_rng(6)
    text = lambda n: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) + "." for _ in range(n))
    rows = [(1, text(3000), 1, "a", 2), (2, text(4), 3, None, 4), (2, text(4), 5, "b", None), (None, text(4), 6, "c", 7), (5, None, 8, "d", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, block long, gone string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "block", "gone", "n_words"]
    kept = docs.collect()
    assert sorted((r.block, r.gone, r.n_words) for r in kept if r.block != 3) == [(1, "a", 2), (5, "b", None), (6, "c", 7)] and len(kept) == 4
    pieces = corpus_pipeline.run(spark, str(tmp_path)).filter("doc_id = 1").collect()
    assert len(pieces) > 10 and sorted(r.piece for r in pieces) == list(range(len(pieces)))


def test_one_copy_learns_from_several_blocks(spark, monkeypatch):
    """Blocks that learn together are one copy: no fewer documents, and not a copy a block."""
    monkeypatch.setattr("patchloom.llm.lm_scoring.BLOCK_BYTES", 4_000)
    rng, seen = np.random.default_rng(6), []
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 40))) for k in range(300)], "doc_id long, text string")
    own = lm_scoring.train

    def train(encoded, layout, blocks):
        seen.append((blocks, {r.block for r in encoded.select("block").collect()}))
        parts = encoded.select(F.expr(f"block div {lm_scoring.TOGETHER}").alias("copy"), "block", "held", "lengths", "ids")
        rows = parts.groupBy("copy").applyInArrow(lm_scoring._lessons, lm_scoring._ddl(lm_scoring._LESSONS)).collect()
        seen.append((len(rows), sorted(n for r in rows for n in np.frombuffer(r.lengths, np.int64).tolist())))
        return own(encoded, layout, blocks)

    monkeypatch.setattr(lm_scoring, "train", train)
    got = score_documents(docs).collect()
    (blocks, numbers), (rows, lengths) = seen
    assert blocks > 2 * lm_scoring.TOGETHER and numbers <= set(range(blocks))
    assert rows == lm_scoring.ROUNDS * len({k // lm_scoring.TOGETHER for k in numbers})
    assert lengths == [41] * sum(not r.held_out for r in got)
