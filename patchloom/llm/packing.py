"""Best-fit packing of tokenised documents into fixed windows.

Two steps. Each scan task tokenises its documents and cuts those longer than a window; only one short
row a piece (no text) is dealt out evenly by a running number. Each packing task then runs bounded-space
online best-fit over its pieces: a fixed number of open bins, held in stacks by free space with one bitset
of the spaces in use; a piece goes to the open bin with the least room that holds it, and when too many
are open, the fullest closes. Tasks are independent, so a lost executor costs its own tasks only, and the
order inside a task is fixed by the running number, so a repeated task packs the same way.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.textbatch import mix, release, slices

#: Tokens in a sequence.
WINDOW = 2048
#: Bins that a packing task keeps open.
OPEN_BINS = 4096
#: Words whose ids a worker remembers; the memory is emptied when full.
WORD_MEMORY = 400_000
#: Python's split() cuts at these, the tokenizer does not: such texts are encoded as a whole.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTER = [""] * 256
for _n, _b in enumerate(_PRINTABLE + [b for b in range(256) if b not in _PRINTABLE]):
    _BYTE_LETTER[_b] = chr(_b if _n < len(_PRINTABLE) else 256 + _n - len(_PRINTABLE))


def _lower(text: str) -> str:
    """The text in lower case where that changes nothing for the tokenizer, which lower-cases too: it leaves fewer distinct words."""
    if "<|" in text:
        return text
    low = text.lower()
    if text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
        return low
    return text


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of words as bytes; a word that isn't held yet is encoded when it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_MEMORY:
            self.clear()
        core = word.rstrip(string.punctuation)
        low = core.lower()
        if not low.isalpha() or not (core.isascii() or (unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", low) and "Σ" not in core)):
            ids = self.whole(word)
        elif low == word:  # letters are one pre-token, so the model alone is asked
            found = self.tokenize(low if low.isascii() else "".join([_BYTE_LETTER[x] for x in low.encode()]))
            ids = pack_ids([t.id for t in found])
        else:  # letters and closing punctuation
            tail = word[len(core) :]
            ids = self[low] + (self.tail(tail) if tail else b"")
        self[word] = ids
        return ids

    def tail(self, tail: str) -> bytes:
        if (ids := self.get(tail)) is None:
            ids = self[tail] = self.whole(tail)
        return ids


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokenizer never joins characters across white space and drops the white space, so
    the ids of a text are those of its words, end to end. Words are encoded once and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordIds(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.words.__getitem__
        return [self.words.whole(t) if any(c in t for c in _NOT_SPACE) else b"".join(map(get, _lower(t).split())) for t in texts]


@cache
def encoder_of(path: str) -> WordEncoder:
    """The encoder that a worker process keeps from task to task."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, turn[, ids].

    A null text counts as empty; every document ends with ``end_id``, so none is without a piece. Rows that
    share a doc_id are separate documents; a null doc_id stays null. Only ``doc_id`` and ``text`` are read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long, turn long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, task, at = encoder_of(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        step = 4 * window
        for batch in batches:
            for part in slices(batch, "text"):
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), step)):
                        one = ids[a : a + step]
                        rows.append(k)
                        piece.append(n)
                        start.append(a // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if with_ids:
                            kept.append(one)
                with np.errstate(over="ignore"):
                    turn = mix(np.arange(at, at + len(rows), dtype=np.uint64) + (np.uint64(task) << np.uint64(40)))
                at += len(rows)
                out = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(turn.view(np.int64))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "turn"]
                if with_ids:
                    out.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best-fit. ``place`` gives the bin's number and the place in it."""

    def __init__(self, window: int, open_bins: int):
        self.window, self.limit = window, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]
        self.bits, self.open, self.bins = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.stacks[free]
            number = stack.pop()
            self.open -= 1
            if not stack:
                self.bits ^= 1 << free
        else:
            free, number = self.window, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.stacks[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                stack = self.stacks[fullest]
                stack.pop(0)
                self.open -= 1
                if not stack:
                    self.bits ^= 1 << fullest
        return number, self.window - free


def pack(rows: DataFrame, window: int = WINDOW, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length`` (1 to ``window``) and ``turn``; drops ``turn``.

    Numbers of sequences are unique, not consecutive. An empty input gives no rows.
    """
    names = [c for c in rows.columns if c != "turn"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "turn") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(window, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([fit.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(placed[:, 0] + first), pa.array(placed[:, 1])], names=[*names, "sequence_id", "offset"])

    return rows.repartition(F.col("turn")).sortWithinPartitions("turn").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` tokens."""
    return pack(pieces(docs, tokenizer_path, window, end_id, with_ids), window, open_bins)
