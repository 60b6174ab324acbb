import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from patchloom.llm import quality_classifier
from patchloom.llm.quality_classifier import fit, score_quality
from patchloom.llm.quality_rules import clean_documents, line_fails, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many, hit = Counter(windows), [False] * len(words)
    for k, w in enumerate(windows):
        if many[w] > 1:
            hit[k] = hit[k + 1] = hit[k + 2] = True
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, again, sum(hit)


def test_base_counts_equal_brute_force(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(20, "a b c a b c d\na b c\na b c\n\n\n \n"), (21, "a|b <x> #1 $$\x0bq\x0cz"), (22, "x x x x"), (23, " lead trail ")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_report(docs).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_report(no_docs).count() == 0


def test_junk_goes_and_clean_text_stays(spark):
    clean = "\n".join(" ".join(f"Word{k * 31 + j * 7}" for j in range(12)) + ", which is fine." for k in range(8))
    symbols = " ".join(f"word{k}### other{k}$$$" for k in range(60))
    nav = "Start.\n" + " | ".join(f"entry{k}" for k in range(80))
    shout = " ".join(f"BUY{k}!! NOW{k}!!" for k in range(40))
    mixed = clean + "\nHome | News | Sport | Contact\nWe use cookies on this site.\n\nLast line of text."
    docs = spark.createDataFrame([(1, clean, 0), (2, symbols, 0), (3, nav, 0), (4, shout, 0), (5, mixed, 0)], "doc_id long, text string, left_chars int")
    assert {r.doc_id for r in clean_documents(docs).collect()} == {1, 5}
    left = {r.doc_id: r.text for r in clean_documents(docs, drop_lines=True).collect()}
    assert left[1] == clean and "cookies" not in left[5] and "Sport" not in left[5] and "Last line" in left[5]


def test_lines_are_judged_by_their_words(spark):
    cases = [("wow!!!! it is all so very fine here", False), ("wow!!!! fine?!?", True), ("a b!! c", True), ("a b!!c d", False), ("a!! b c d", False), ("a!!! b\tc d", False), ("!!!!!! one two three", False), ("\t a!! b c", True), ("\ta# b c\x0b", True), ("\ta# b c d ", False)]
    frame = spark.createDataFrame(cases, "line string, fails boolean")
    assert [r.line for r in frame.filter(line_fails(F.col("line")) != F.col("fails")).collect()] == []


def test_classifier_on_documents(spark, odd_docs, no_docs):
    good = [(k, " ".join(f"w{(k * 31 + j * 17) % 400}er" for j in range(80)) + ".") for k in range(200)]
    bad = [(1000 + k, " ".join(f"w{(k * 31 + j * 17) % 400}###" for j in range(80))) for k in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 1000 else 0) for k, _ in good + bad if k % 3] + [(None, 1), (5000, None)], "doc_id long, quality int")
    rows = score_quality(docs, labels, sample=150).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and held and sum(r.predicted == (r.doc_id < 1000) for r in held) >= 0.97 * len(held)
    odd = score_quality(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert score_quality(no_docs, labels).count() == 0


def test_no_positives_score_one_half():
    import numpy as np

    assert (fit(np.ones((3, 2)), np.array([0, -1, 0])) == 0).all()


def test_class_prior_of_made_data():
    rng = np.random.default_rng(2)
    for share in (0.25, 0.6, 0.85):
        n = int(8000 * share)
        x = np.concatenate([rng.normal(2.0, 1, (8000 + n, 3)), rng.normal(-2.0, 1, (8000 - n, 3))])
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        assert abs(quality_classifier.class_prior(x, np.arange(8000), 8000 + rng.permutation(8000)) - share) < 0.06


def test_negative_labels_teach_nothing():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((300, 1)), rng.normal(0, 1, (300, 4))], axis=1)
    label = np.repeat([1, -1, 0], 100)
    flipped = x.copy()
    flipped[200:] *= -7
    assert np.array_equal(quality_classifier.fit(x, label), quality_classifier.fit(flipped, label))
    assert not quality_classifier.fit(x[100:200], label[100:200]).any()  # no positive


def test_scores_at_the_threshold(spark):
    """Rows that tie at the threshold, as all do without positives if it is one half, are predicted to be good."""
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.score_quality(docs, labels).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)] * 3


def test_a_shared_doc_id_is_learned_from_by_its_first_text(spark):
    from patchloom.llm.quality_classifier import train

    rows = [(k, f"plain text number {k} with words " * (1 + k % 3)) for k in range(40)] + [(k, f"zzz other {k} !!! ###") for k in range(40)] + [(3, None), (4, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 40, 3)], "doc_id long, quality int")
    first = {}
    for k, text in rows:
        if text is not None:
            first[k] = min(first.get(k, text), text)
    want = train(spark.createDataFrame(sorted(first.items()), "doc_id long, text string"), labels)
    for parts in (1, 5):
        got = train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels)
        assert (got == want).all()
    assert (train(spark.createDataFrame(rows, "doc_id long, text string"), labels.filter("false")) == train(spark.createDataFrame(sorted(first.items()), "doc_id long, text string"), labels.filter("false"))).all()
