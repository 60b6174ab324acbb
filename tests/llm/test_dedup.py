import hashlib
import random

import numpy as np

from patchloom.llm.components import components
from patchloom.llm.near_duplicates import first_of_each, link_components
from patchloom.llm.suffix_dedup import _merged, longest_previous_factors, nearest_smaller, remove_repeats


def brute_repeats(rows):
    """By document: bytes, removed bytes, runs and what remains, from a table of all 50-byte strings."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(3, 12)))
    common = [" ".join(word() for _ in range(rnd.randint(6, 14))) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = [rnd.choice(common) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(0, 6))]
        docs.append((k, " ".join(parts)))
    docs += [(60 + k, docs[k][1]) for k in range(10)] + [(70, "a" * 400), (71, "b" + "a" * 120), (72, None), (73, ""), (None, docs[3][1]), (5, "another text of the same document"), (74, docs[1][1][:49])]
    return docs


def test_repeats_equal_brute_force(spark, odd_docs, no_docs):
    for wide in (2000, 3):
        rows = passages(wide)
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), wide=wide).collect()
        assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
    odd = odd_docs.select("doc_id", "text")
    assert sorted(map(tuple, remove_repeats(odd).collect()), key=str) == brute_repeats([tuple(r) for r in odd.collect()])
    assert remove_repeats(no_docs.select("doc_id", "text")).count() == 0


def test_spans_of_documents_dont_merge():
    got = _merged(np.array([0, 0, 1]), np.array([0, 5, 2]), np.array([5, 9, 4]))
    assert [x.tolist() for x in got] == [[0, 1], [0, 2], [9, 4]]


def shingles(text):
    words = [w for w in text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).split() if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets, up = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed):
    """Families whose members were made from members, so that many are linked through others only."""
    rnd = random.Random(seed)
    rows, number = [], 0
    for family in range(4):
        members = [[f"f{family}w{rnd.randrange(10**6)}" for _ in range(rnd.choice((60, 140)))]]
        for _ in range(70):
            words = list(rnd.choice(members[: rnd.choice((1, 5, 70))]))
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(words))
                change = rnd.random()
                if change < 0.4:
                    words[k] = f"new{rnd.randrange(10**6)}"
                elif change < 0.7 and len(words) > 20:
                    del words[k]
                else:
                    words = words[: max(20, len(words) - rnd.randint(0, 6))]
            members.append(words)
        for words in members:
            rows.append((number, " ".join(words).title() if rnd.random() < 0.2 else " ".join(words)))
            number += 1
    rnd.shuffle(rows)
    return rows + [(number, "short text"), (number + 1, "Short  text"), (number + 2, ""), (number + 3, None)]


def test_components_equal_brute_force(spark, no_docs):
    rows = near_copies(8)
    got = {r.doc_id: r for r in link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and all(r.kept == (i == r.component_id) for i, r in got.items())
    assert link_components(no_docs).count() == 0


def test_odd_documents_and_the_ones_that_stay(odd_docs):
    got = link_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 5, 7)} == {(1, 1), (2, 2), (5, 5), (7, 3)}
    stay = first_of_each(odd_docs)
    assert stay.columns == odd_docs.columns and sorted(str(r.doc_id) for r in stay.collect()) == ["1", "2", "3", "3", "4", "5", "6", "None"]


def test_a_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_longest_previous_factors_equal_brute_force():
    rng = np.random.default_rng(4)
    for n, letters, docs in ((0, 2, 1), (1, 2, 1), (200, 2, 5), (300, 3, 300), (150, 1, 4)):
        suffixes, owner = rng.integers(97, 97 + letters, (n, 10)).astype(np.uint8), rng.integers(0, docs, n)
        order, factor = longest_previous_factors(suffixes, owner)
        assert sorted(order.tolist()) == list(range(n))
        for k, found in zip(order.tolist(), factor.tolist(), strict=True):
            shared = [next((i for i in range(10) if suffixes[k, i] != suffixes[x, i]), 10) for x in range(n) if owner[x] < owner[k]]
            assert found == max(shared, default=0)


def test_nearest_smaller_documents():
    docs, lcp = np.array([3, 3, 1, 2, 2, 5, 0, 4]), np.array([0, 9, 4, 7, 8, 2, 6, 5])
    at, common = nearest_smaller(docs, lcp)
    assert at.tolist() == [-1, -1, -1, 2, 2, 4, -1, 6] and common.tolist() == [0, 0, 0, 7, 7, 2, 0, 5]
    falling = np.arange(1000)[::-1]
    assert (nearest_smaller(falling, np.zeros(1000, np.int64))[0] == -1).all()


def test_far_apart_documents_with_a_common_passage_meet_by_rare_shingles(spark):
    """Many documents share a passage and little else; two of them are near copies, and links of different texts are all found."""
    rnd = random.Random(3)
    passage = [f"common{k}" for k in range(60)]
    rows = []
    for k in range(120):
        own = [f"own{rnd.randrange(10**6)}" for _ in range(rnd.randint(45, 70))]
        rows.append((k, " ".join(passage + own)))
        if k % 10 == 0:
            own[3] = "changed"
            rows.append((1000 + k, " ".join(passage + own)))
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and sum(c != i for i, (_, c) in got.items()) == 12


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, "x"), (2, "a b c d e f g", 6, "y"), (3, "other", 7, "z")], "doc_id long, text string, gone int, gone_ string")
    assert sorted(r.gone for r in first_of_each(docs).collect()) == [5, 7]


def plain_nearest(docs, lcp):
    at, common, stack = [], [], []  # of (place, common prefix with the one below it)
    for i, d in enumerate(docs):
        c = lcp[i]
        while stack and docs[stack[-1][0]] >= d:
            c = min(c, stack.pop()[1])
        at.append(stack[-1][0] if stack else -1)
        common.append(c if stack else 0)
        stack.append((i, c))
    return at, common


def test_nearest_smaller_of_any_order():
    rnd = np.random.default_rng(5)
    shapes = [np.concatenate([np.arange(3000), [0], np.arange(3000)[::-1]]), np.append(np.arange(2000), 1), np.arange(500)[::-1], np.zeros(700, np.int64), rnd.integers(0, 3, 5000), rnd.integers(0, 10_000, 5000), np.tile(np.arange(200), 20), np.repeat(np.arange(300)[::-1], 9), np.array([], np.int64), np.array([4])]
    for docs in shapes:
        lcp = rnd.integers(0, 60, len(docs))
        at, common = nearest_smaller(docs, lcp)
        want = plain_nearest(docs.tolist(), lcp.tolist())
        assert at.tolist() == want[0] and common.tolist() == want[1]


def test_nearest_smaller_does_not_grow_with_the_square():
    import time

    half = np.arange(500_000)
    docs = np.concatenate([half + 1, half[::-1]])
    began = time.process_time()
    at, _ = nearest_smaller(docs, np.full(len(docs), 9))
    assert time.process_time() - began < 20 and at[-1] == -1 and at[500_000] == 499_997
