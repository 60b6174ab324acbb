"""Inference of the skip-chain field against all labellings, and what its nodes and kinds are."""

import itertools

import numpy as np

from patchloom.llm.pii import beliefs, find_personal_data, spans_of, trained


def exact(own, ties, strength):
    out = np.zeros_like(own)
    for labels in itertools.product(range(own.shape[1]), repeat=len(own)):
        weight = np.exp(sum(own[k, x] for k, x in enumerate(labels)) + sum(s for (a, b), s in zip(ties, strength, strict=True) if labels[a] == labels[b]))
        for k, x in enumerate(labels):
            out[k, x] += weight
    return out / out.sum(axis=1, keepdims=True)


def shares(total):
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(1)
    for labels in (2, 4):
        own = rng.normal(0, 1.5, (7, labels))
        ties = np.array([(0, 1), (1, 2), (1, 3), (3, 4), (3, 5), (5, 6)])
        strength = rng.uniform(0, 3, len(ties))
        assert np.allclose(shares(beliefs(own, ties, strength, 80)), exact(own, ties.tolist(), strength), atol=1e-6)


def test_messages_choose_the_likely_labels_on_loops():
    rng = np.random.default_rng(2)
    right = total = 0
    for _ in range(40):
        own, ties, strength = rng.normal(0, 2, (6, 3)), np.array([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]), rng.uniform(0, 2, 7)
        want = exact(own, ties.tolist(), strength)
        sure = np.sort(want, axis=1)[:, -1] > 0.6
        right += (beliefs(own, ties, strength).argmax(axis=1) == want.argmax(axis=1))[sure].sum()
        total += sure.sum()
    assert right >= 0.98 * total


def found(text):
    return {(kind, text[a:b]) for kind, spans in zip(("email", "ip", "card", "phone", "secret"), spans_of(text, np.array(trained())), strict=True) for a, b in spans}


def test_all_kinds_are_labels():
    text = "call +49 30 1234567 or 030 1234567; card 4111 1111 1111 1111 and 4111.1111.1111.1111, mail joe@x.org, joe(at)x.org. Order 30 7654321 came"
    assert found(text) == {("phone", "+49 30 1234567"), ("phone", "030 1234567"), ("card", "4111 1111 1111 1111"), ("card", "4111.1111.1111.1111"), ("email", "joe@x.org"), ("email", "joe(at)x.org")}


def test_cues_and_far_names():
    text = "password: hunterhunter " + "x " * 90 + "password = correcthorsebattery api_key = ABCDEFGHIJKLMNOPQRSTUVWXYZ " + "y" * 200 + " hunterhunter"
    assert found(text) == {("secret", "password: hunterhunter"), ("secret", "password = correcthorsebattery"), ("secret", "api_key = ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("secret", "hunterhunter")}
    assert found("build 0123456789abcdef0123 of version 4f") == set()


def test_base_spans_stay(spark):
    text = "from +49 30 1234567 and 030 1234567"
    row = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_phone == 1 and row.spans == "phone:5:19,phone:24:35"
