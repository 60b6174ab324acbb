"""SentencePiece encoding and decoding for merge-type vocabularies, in Arrow batches.

The encoder is the score-ordered agenda: all adjacent symbol pairs that make a piece wait in a heap, best
score first and then leftmost; taking one joins its symbols and enters the two new pairs beside it. Two
characters that stand side by side in no piece are never joined, so a text falls there into chunks whose ids
don't depend on each other: before a run of space marks, at line ends, before most punctuation. A worker
encodes each distinct chunk once and remembers it. Against the sentencepiece library it checks every new chunk that
begins a word and, in each Arrow batch, whole texts; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from patchloom.llm.textbatch import release, slices

MARK = "▁"
#: Words, and parts of words, that a worker remembers; the memory is emptied when full.
WORD_MEMORY, PART_MEMORY = 500_000, 300_000
#: Symbols up to which the agenda is a plain list, whose smallest entry is as fast to find as in a heap.
SHORT = 48
_NEVER = 1 << 60
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Words(dict):
    """Ids, comma-joined, of what stands between spaces; what isn't held yet is encoded when it is asked for.

    A mark precedes a word unless it begins with a line end.
    """

    def __init__(self, codec: PieceCodec):
        self.codec = codec

    def __missing__(self, word: str) -> str:
        if len(self) >= WORD_MEMORY:
            self.clear()
        known, part = self.codec.parts.get, self.codec._part
        ids = self[word] = ",".join([known(x) or part(x) for x in self.codec._cut(word if word.startswith("\n") else MARK + word)])
        return ids


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)) or any(MARK in p.lstrip(MARK) or "\n" in p for p, s in zip(names, special, strict=True) if not s):
            raise ValueError("not a vocabulary whose chunks are independent")
        ordered = sorted({self.library.get_score(i) for i in range(size)}, reverse=True)
        rank = {x: k for k, x in enumerate(ordered)}
        #: Place of a piece in the order of scores, best first, and its id.
        self.ranks = {p: rank[self.library.get_score(i)] for i, p in enumerate(names) if not special[i]}
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.bytes_id = {int(p[3:5], 16): i for i, p in enumerate(names) if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.raw = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.check = check
        self.new: list[str] = []
        #: Ids, comma-joined: by what stands between spaces, and by the parts of that.
        self.words = Words(self)
        self.parts: dict[str, str] = {}
        #: Parts that don't decode to themselves, with what they decode to.
        self.other: dict[str, str] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already, by the agenda."""
        symbols = list(text)
        if len(symbols) > 1:
            (self._merge_short if len(symbols) <= SHORT else self._merge_long)(symbols)
        ids: list[int] = []
        for s in symbols:
            if s:
                found = self.ids.get(s)
                ids.extend([found] if found is not None else [self.bytes_id[x] for x in s.encode()] if self.bytes_id else [self.unknown])
        return ids

    def _merge_short(self, symbols: list[str]) -> None:
        rank = self.ranks.get
        agenda = [rank(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while (best := min(agenda)) != _NEVER:
            k = agenda.index(best)
            symbols[k] += symbols.pop(k + 1)
            del agenda[k]
            if not agenda:
                return
            if k:
                agenda[k - 1] = rank(symbols[k - 1] + symbols[k], _NEVER)
            if k < len(agenda):
                agenda[k] = rank(symbols[k] + symbols[k + 1], _NEVER)

    def _merge_long(self, symbols: list[str]) -> None:
        n, rank = len(symbols), self.ranks.get
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(r, k, k + 1, 2) for k in range(n - 1) if (r := rank(symbols[k] + symbols[k + 1], _NEVER)) != _NEVER]
        heapify(heap)
        while heap:
            _, a, b, size = heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y >= 0 and (r := rank(symbols[x] + symbols[y], _NEVER)) != _NEVER:
                    heappush(heap, (r, x, y, len(symbols[x]) + len(symbols[y])))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put in front goes."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _cut(self, chunk: str) -> list[str]:
        """The chunk cut wherever no piece has the two characters side by side."""
        beside, a, out = self.beside, 0, []
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in beside:
                out.append(chunk[a:k])
                a = k
        out.append(chunk[a:])
        return out

    def _part(self, part: str) -> str:
        if len(self.parts) >= PART_MEMORY:
            self.parts.clear()
        ids = self.merge(part)
        if (decoded := b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")) != part.replace(MARK, " "):
            self.other[part] = decoded
        joined = self.parts[part] = ",".join(map(str, ids))
        if self.check:
            self.new.append(part)
        return joined

    def verify(self, text: str) -> None:
        """Compares whole ``text`` and the new parts that begin a word with the library."""
        new, self.new = [x[1:] for x in self.new if x[0] == MARK and x != MARK], []
        for part, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            if ",".join(map(str, ids)) != (self.parts.get(MARK + part) or ",".join(map(str, self.merge(MARK + part)))):
                raise AssertionError(f"the agenda and the library differ on {part!r}")
        own, ids = self.encode_joined(text), self.library.encode(text)
        if own != (",".join(map(str, ids)), self.library.decode(ids)):
            raise AssertionError(f"the agenda and the library differ on {text[:200]!r}")

    def encode_joined(self, text: str) -> tuple[str, str]:
        """Decimal ids of a whole text, joined by commas, and what they decode to."""
        if not text:
            return "", ""
        if not (text[0] == " " or "  " in text or MARK in text):
            joined = ",".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
            if not self.other:  # every part decodes to itself
                return joined, text
        parts = [x for chunk in _CHUNK.findall(MARK + text.replace(" ", MARK)) for x in self._cut(chunk)]
        return ",".join([self.parts.get(x) or self._part(x) for x in parts]), "".join([self.other.get(x) or x.replace(MARK, " ") for x in parts])[1:]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text)[0].split(",") if x]


@cache
def codec_of(path: str) -> PieceCodec:
    """The codec that a worker process keeps from task to task."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded string] of every text.

    A null text counts as empty: no ids, the hash of the empty string. Rows that share a doc_id, null keys and
    other columns make no difference; one row comes out for each that goes in.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                joined = [codec.encode_joined(t) for t in texts]
                if codec.check:
                    codec.verify(min(texts, key=len))
                    codec.verify(texts[len(texts) // 2])
                out = [
                    part.column("doc_id"),
                    pa.array([a.count(",") + 1 if a else 0 for a, _ in joined], pa.int64()),
                    pa.array([hashlib.sha256(a.encode()).hexdigest() for a, _ in joined], pa.string()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in joined], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array([[int(x) for x in a.split(",") if x] for a, _ in joined], pa.list_(pa.int32())), pa.array([b for _, b in joined], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
