"""Hard negatives, web archives and the filter audit against brute force, with the defined results for odd rows."""

import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import filter_audit, hard_negatives, warc
from patchloom.llm.textbatch import buffer_of, word_spans

# --- hard negatives ----------------------------------------------------------------------------------------------------


def whole(row):
    key, vector, label = row
    ok = key is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    return (key, [math.floor(256 * float(np.float32(x))) for x in vector], label) if ok else None


def plain_negatives(rows, is_anchor, n_positives=5, n_negatives=3):
    use = [x for x in map(whole, rows) if x]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for key, vector, label in (x for x in use if is_anchor(x[0])):
        scored = [(-dot(vector, v), k, other) for k, v, other in use if k != key]
        for score, positive, _ in sorted(x for x in scored if x[2] == label)[:n_positives]:
            band = sorted(x for x in scored if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score)
            out += [(key, positive, rank, k, -score, -s) for rank, (s, k, _) in enumerate(band[:n_negatives], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(rows, anchors="vec_id % 5 = 0"):
    return sorted(tuple(r[c] for c in NAMES) for r in hard_negatives.mine(rows, F.expr(anchors), F.col("label")).collect())


def clustered(rnd, n, width=6, labels=4):
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(k, [c + rnd.gauss(0, 0.5) for c in centres[(k + rnd.randrange(2)) % labels]], k % labels) for k in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "CHUNK_BLOCKS", 3)
    monkeypatch.setattr(hard_negatives, "SEED_ROWS", 40)
    rows = clustered(random.Random(1), 400)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain_negatives(rows, lambda k: k % 5 == 0)


def test_negatives_of_odd_rows(spark):
    rnd = random.Random(2)
    rows = clustered(rnd, 60)
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 2), (None, [1.0] * 6, 1), (104, [1.0] * 6, None), (105, [], 1), (106, [0.5, 0.5], 3), (110, [0.25] * 9, 0)]
    rows += [(200 + k, [1.0] * 6, k % 2) for k in range(30)]  # equal vectors: ties by the smaller id
    rows += [(215, [0.9] * 6, 1), (215, [0.8] * 6, 0), (201, [0.7] * 6, 1)]  # shared ids, anchors among them
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", id string, anchor int")
    assert mined(frame) == plain_negatives(rows, lambda k: k % 5 == 0)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame(rows, SCHEMA), "false") == []
    assert mined(spark.createDataFrame([(5, [1.0], 1), (6, [1.0], 1)], SCHEMA)) == []


def test_bounds_leave_blocks_out_and_lose_nothing(spark, monkeypatch):
    """Far clusters: most blocks can't serve most groups, and aren't sent to them."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 4)
    sent = []
    plain = hard_negatives.saved
    monkeypatch.setattr(hard_negatives, "saved", lambda frame, name, *a: sent.append((name, x := plain(frame, name, *a))) or x)
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        axis = k % 6
        rows.append((k, [(3.0 if i == axis else 0.0) + rnd.gauss(0, 0.05) for i in range(6)], k % 2))
    assert mined(spark.createDataFrame(rows, SCHEMA).coalesce(2), "vec_id % 7 = 0") == plain_negatives(rows, lambda k: k % 7 == 0)
    count = Counter()
    for name, frame in sent:
        count[name] += frame.count()
    groups, blocks = dict(sent)["anchors"].count(), dict(sent)["blocks"].count()
    assert count["pairs"] < 0.7 * 2 * groups * blocks


def test_space_bounds_hold():
    rnd = np.random.default_rng(4)
    values = rnd.integers(-300, 300, (200, 5)).astype(np.int32)
    most = int((values.astype(np.int64) ** 2).sum(axis=1).max())
    space = hard_negatives.Space(np.arange(200), np.zeros(200, np.int64), values, most, 7)
    to_rows, to_anchors, scores = space.of_rows(values), space.of_anchors(values), hard_negatives.scores_of(values, values)
    for a in range(0, 200, 9):
        distance = space.at_score(np.repeat(values[a : a + 1], 200, axis=0), scores[a].astype(float))
        for p in range(len(space.pivots)):
            assert (np.abs(to_anchors[a, p] - to_rows[:, p]) <= distance + space.slack).all() and (distance <= to_anchors[a, p] + to_rows[:, p] + space.slack).all()
    with pytest.raises(OverflowError):
        hard_negatives.scores_of(np.full((1, 1), 2**31 - 1), np.full((1, 3), 2**31))


# --- archives ----------------------------------------------------------------------------------------------------------

PAGES = [
    (3, "http://Example.com:80/b?x=1#top", "<p>one</p>"), (1, "https://m.example.com/a", "<p>one</p>"), (2, None, None), (9, "http://example.com/é ü", ""), (None, "nonsense", "<p>one</p>"), (None, None, "only here"),
    (None, None, "only here"), (7, "http://u@h:8080", "x" * 70_000 + "\r\n\r\nWARC/1.1\r\n中文😀\x00"), (7, "http://u@h:8080", "x" * 70_000 + "\r\n\r\nWARC/1.1\r\n中文😀\x00"), (4, "http://e.org/", "<p>one</p>"), (5, "http://e.org/", "<p>two</p>"),
]


def plain_records(pages, least=0):
    groups = {}
    for page, _, html in pages:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        first = min(known) if known and len(groups[html or ""]) > 1 and len(body) >= least else None
        again = first is not None and page != first
        out.append((page, len(body), warc.base32_sha1(body), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11])
def test_archived_pages(spark, least):
    frame = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, text string, first int").repartition(3)
    got = warc.archived_pages(frame, min_bytes=least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain_records(PAGES, least)
    ordered = sorted(got, key=lambda r: (r.range_no, r.place))
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0, r.archive, r.record_offset) for r in ordered]
    assert keys == sorted(keys) and len({(r.archive, r.record_offset) for r in got}) == len(PAGES)


def test_archives_are_plain_gzip(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "a"), F.lit(951_782_400))  # 29 February 2000
    raw = b"".join(p.read_bytes() for p in sorted(Path(tmp_path / "a").glob("part-*")))
    text = gzip.decompress(raw)
    assert text.count(b"WARC-Date: 2000-02-29T00:00:00Z") == len(PAGES) and b"WARC-Target-URI: http://example.com/%C3%A9%20%C3%BC\r\n" in text
    rows = warc.read_records(spark, str(tmp_path / "a")).collect()
    assert sorted(((r.page_id, r.payload.decode()) for r in rows if r.record_type == "response"), key=str) == sorted(((p, h or "") for (p, _, h), (_, _, _, kind, _) in zip(sorted(PAGES, key=lambda x: str((x[0], len((x[2] or "").encode())))), plain_records(PAGES), strict=True) if kind == "response"), key=str)
    assert {r.captured for r in rows} == {951_782_400}
    for offset, length, record in warc.records_in(raw):
        assert gzip.decompress(raw[offset : offset + length]) == record


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_members_end_with_a_zero_byte():
    for size in (0, 5, 1 << 24, (1 << 24) + 3):
        member = warc.member_of(b"a" * size)
        assert member[-1] == 0 and gzip.decompress(member) == b"a" * size
    long = warc.member_of(warc.record_of(1, "u", 0, b"b" * (1 << 24), None, False)) + warc.member_of(warc.record_of(2, "u", 0, b"", None, False))
    found = list(warc.records_in(long))
    assert [len(warc.capture_of(r)[1]) for _, _, r in found] == [1 << 24, 0] and sum(n for _, n, _ in found) == len(long)


def test_untrue_records_are_errors():
    record = warc.record_of(1, "http://e.org/", 5, b"abc", None, False)
    assert warc.capture_of(record)[1] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.capture_of(record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    with pytest.raises(ValueError, match="whole"):
        warc.capture_of(record[:-3])
    with pytest.raises(ValueError, match="inside"):
        list(warc.records_in(warc.member_of(record)[:-9]))


def test_url_keys_and_dates():
    assert [warc.url_key(x) for x in ("https://WWW.Example.com:443/A?b#c", "http://h:443/", "//h", None, "plain#x", "http://[::1]/")] == ["com,example,www)/A?b", "h:443)/", "h)/", "", "plain", warc.url_key("http://[::1]/")]
    for seconds in (0, 951_782_400, 951_868_799, 4_107_542_400, 253_402_300_799):
        assert warc._seconds(warc._date(seconds)) == seconds
    assert warc._date(951_782_400) == "2000-02-29T00:00:00Z" and warc._date(253_402_300_799) == "9999-12-31T23:59:59Z"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rnd = random.Random(k)
    runs = [sorted(bytes([rnd.randrange(4)]) * rnd.randrange(3) for _ in range(rnd.randrange(12))) for _ in range(k)]
    order = list(warc.LoserTree(runs))
    assert [runs[r][i] for r, i in order] == sorted(itertools.chain(*runs)) and len(set(order)) == sum(map(len, runs))
    assert all(a[0] <= b[0] for a, b in itertools.pairwise(order) if runs[a[0]][a[1]] == runs[b[0]][b[1]]), "equal keys keep the order of their runs"


def test_a_hot_url_spans_ranges(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://hot.example/").otherwise(F.concat(F.lit("http://e.org/"), F.col("id").cast("string"))).alias("url"), F.lit("same").alias("html"))
    got = warc.archived_pages(pages).select("url_key", "page_id", "range_no", "place", "refers_to").collect()
    ordered = sorted(got, key=lambda r: (r.range_no, r.place))
    assert [(r.url_key, r.page_id) for r in ordered] == sorted((r.url_key, r.page_id) for r in got) and len(got) == 3000
    assert len({r.range_no for r in got if r.url_key.startswith("example,hot")}) > 1 and {r.refers_to for r in got} == {None, 0}


# --- the filter audit --------------------------------------------------------------------------------------------------


def plain_audit(documents, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    rows = []
    for key, text, part in documents:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        earlier = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in documents)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": earlier}
        rows.append((part or "", {k for k, bad in fails.items() if bad}, key in good, key in toxic))
    out = []
    for part in sorted({r[0] for r in rows}):
        own, shapley = [r for r in rows if r[0] == part], Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left_now = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                steps.append([part, "".join(order), step, len(left_now), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
                left = left_now
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark):
    rnd = random.Random(8)
    kinds = ["", "a b c", "A B C D " * 40, " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k % 70}" for k in range(120)), "X " + " ".join(f"é{k}" for k in range(150)), " ".join(f"w{k}" for k in range(120)) + " #", "中文 😀 " * 80, "T" * 5000, " \n\t\x0b\x0c\r "]
    documents = [(k if k % 17 else None, rnd.choice(kinds) if k % 11 else None, rnd.choice(("en", "de", None, ""))) for k in range(150)]
    documents += [(3, "same", "en"), (3, "same", "en"), (3, "same", "de"), (2, "same", "en"), (4, "other", "en"), (4, "another", "en")]
    labels = [(k, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for k in range(0, 150, 2)] + [(None, 1, 1), (4, 0, 1), (4, 1, 0), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "m") for d in documents], "doc_id long, text string, lang string, n int, mask string").repartition(4)
    got = filter_audit.audit_filters(frame, spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, n int"))
    assert sorted(tuple(r[c] for c in AUDIT) for r in got.collect()) == plain_audit(documents, labels)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], "doc_id long, text string, lang string"), empty).count() == 0
    one = filter_audit.audit_filters(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), empty).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)


def test_distinct_words_don_t_hang_on_the_hash(monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(("a", "b", "cc", "dd", "e" * 40, "é")) for _ in range(rnd.randrange(60))) for _ in range(40)] + ["", None, "z " * 3000]
    raw, offsets = buffer_of(pa.array(texts))
    starts, stops, first = word_spans(raw, offsets)
    want = [len(set((t or "").split())) for t in texts]
    assert filter_audit.distinct_words(raw, starts, stops, first).tolist() == want
    assert filter_audit.distinct_words(raw, starts, stops, first, np.zeros(len(starts), np.uint64)).tolist() == want  # all hashes clash
    monkeypatch.setattr(filter_audit, "HASH_BYTES", 7)
    monkeypatch.setattr(filter_audit, "COMPARE_BYTES", 3)
    assert filter_audit.distinct_words(raw, starts, stops, first).tolist() == want
    mask, digest = filter_audit.masks_of(pa.array(texts))
    assert digest == [hashlib.sha256((t or "").encode()).digest() for t in texts] and len(mask) == len(texts)
