"""Exact removal of byte strings that an earlier document holds too, by longest previous factors.

A byte goes if some ``LENGTH``-byte string over it also starts in a document with a smaller doc_id. Suffix arrays over
blocks of suffixes decide that; which suffixes meet in a block is settled so that equal strings always do:

1. Documents are dealt into blocks of a few MB by a hash of doc_id and text (a shuffle that all later steps reuse). In every
   LENGTH-byte string the smallest of its KMER-byte strings' hashes is an anchor: equal strings have equal anchors.
2. About every sixteenth anchor begins a segment, which reaches LENGTH bytes into the next. Blocks send 128-bit hashes of
   their distinct segments; a segment that a smaller document has too is covered as a whole. That settles the
   inside of copies cheaply: strings inside covered segments take no further part, as their first holder still does.
3. Each block sends the distinct anchors of its other strings, 32 bits each, in packed rows by hash range, and hears
   which of them other documents hold. Documents without such anchors are done.
4. Blocks send the surroundings of those anchors, each distinct one once a block with its smallest document; later
   documents of the same block are settled at once. An anchor in very many documents has its surroundings sent as
   single LENGTH-byte strings dealt by their own hash, so a passage in a third of all documents makes no large task.
5. A range orders its suffixes (as far as LENGTH bytes, ties in document order). In that order the previous and next
   smaller document of each are found, and the longer of the common prefixes with them is its longest previous factor: from
   LENGTH bytes on the bytes are covered. Suffixes whose hash occurs once have no match and are left out first; bytes decide.
6. Covered spans return to the blocks, which merge and cut them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.textbatch import buffer_of, mix, release

#: Bytes of a string that counts as repeated, and of the strings whose hashes are anchors.
LENGTH, KMER = 50, 25
REACH = LENGTH - KMER
SURROUND = LENGTH + REACH
#: Bytes of text in a block and in what one range orders, and the least number of either.
BLOCK_BYTES, RANGE_BYTES, LEAST = 6 << 20, 12 << 20, 16
#: Documents that hold an anchor from which on it is dealt string by string (at least; a block counts up to 255).
WIDE = 2000
#: UTF-8 has no such byte: it stands around every document.
PAD = 0xFF
_SLICE = 1 << 18
#: One anchor in so many begins a segment.
SEGMENT = 16
#: Surroundings whose suffixes are ordered together, about.
_PART = 30_000

_rng = np.random.default_rng(505)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1, 2**63, 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pass(x: np.ndarray, size: int, step) -> np.ndarray:
    """``step`` (minimum or maximum) over every ``size`` neighbours, by doubling."""
    have = 1
    while 2 * have <= size:
        x = step(x[:-have], x[have:])
        have *= 2
    return step(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def rolling(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte strings, by doubling: the code of 2n bytes from two codes of n."""
    with np.errstate(over="ignore"):
        base, codes, power, have = np.uint64(0x9E3779B97F4A7C15), _CODE[x], None, 1
        power = base
        total, length = None, 0
        while True:
            if size & have:
                if total is None:
                    total, length = codes, have
                else:  # what is there, then ``codes`` behind it
                    n = len(x) - (length + have) + 1
                    total = total[:n] * power + codes[length : length + n]
                    length += have
            if 2 * have > size:
                break
            n = len(x) - 2 * have + 1
            codes = codes[:n] * power + codes[have : have + n]
            power = np.uint64(pow(int(power), 2, 2**64))
            have *= 2
        return mix(total)


class Block:
    """The documents of a block in order of doc_id, with padding between them."""

    def __init__(self, table: pa.Table):
        self.table = table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
        text = table.column("text").combine_chunks() if table.column("text").num_chunks != 1 else table.column("text").chunk(0)
        self.raw, self.offsets = buffer_of(text)
        ids = table.column("doc_id")
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(pc.fill_null(ids.cast(pa.int64()), 0))

    def padded(self):
        """Slices of whole documents: first document, offsets of each in the padded bytes, and those bytes."""
        sizes = np.diff(self.offsets)
        part = np.cumsum(sizes) // _SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own, low = sizes[a:b], self.offsets[a]
            begins = self.offsets[a:b] - low + LENGTH * np.arange(1, b - a + 1)
            x = np.full(int(own.sum()) + LENGTH * (b - a + 1), PAD, np.uint8)
            shift = np.repeat(begins - (self.offsets[a:b] - low), own)
            x[np.arange(int(own.sum())) + shift] = self.raw[low : self.offsets[b]]
            for k in np.flatnonzero(~self.known[a:b]):
                x[begins[k] : begins[k] + own[k]] = PAD
            yield a, begins, x


def anchors(x: np.ndarray, done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in padded bytes, and their hashes; ``done`` marks starts of strings that take no part."""
    if len(x) < SURROUND:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    real = x != PAD
    hashes = rolling(x, KMER) | np.uint64(1)
    hashes[~(real[: len(hashes)] & real[KMER - 1 :])] = np.iinfo(np.uint64).max
    least = _pass(hashes, REACH + 1, np.minimum)
    least[~(real[: len(least)] & real[LENGTH - 1 :])] = 0
    if done is not None:
        least[done[: len(least)]] = 0
    edge = np.zeros(REACH, np.uint64)
    most = _pass(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    places = np.flatnonzero(most == hashes)
    return places, hashes[places]


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})


def _distinct(rows: np.ndarray, order: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bytes, the number of the first equal row in order of documents, and that row's document."""
    n = len(rows)
    wide = np.zeros((n, 80), np.uint8)
    wide[:, : rows.shape[1]] = rows
    with np.errstate(over="ignore"):
        codes = mix((mix(wide.view(np.uint64)) * _FACTORS).sum(axis=1, dtype=np.uint64))
    by = np.lexsort((order, codes))
    starts = np.flatnonzero(np.concatenate([[True], codes[by][1:] != codes[by][:-1]])) if n else np.zeros(0, np.int64)
    first = np.empty(n, np.int64)
    first[by] = np.repeat(by[starts], np.diff(np.append(starts, n)))
    wrong = np.flatnonzero((rows != rows[first]).any(axis=1))  # equal hashes of other bytes: compared one by one
    seen: dict[bytes, int] = {}
    for k in wrong[np.argsort(order[wrong], kind="stable")]:
        first[k] = seen.setdefault(rows[k].tobytes(), k)
    return first, docs[first]


_SEGMENTS = {"range": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "codes": pa.binary(), "docs": pa.binary(), "numbers": pa.binary(), "starts": pa.binary(), "ends": pa.binary()}
_SPANS = {"block": pa.int64(), "numbers": pa.binary(), "starts": pa.binary(), "ends": pa.binary()}


def _add(out: dict[str, list], **row) -> None:
    for name, value in row.items():
        out[name].append(value.astype(np.int32).tobytes() if isinstance(value, np.ndarray) and name in ("numbers", "starts", "ends") else value.tobytes() if isinstance(value, np.ndarray) else value)


def _send_segments(bits: int):
    """By block: hashes of distinct segments by range, each with its smallest document; kind -1: spans settled here."""

    def run(key, table):
        number, block, out = key[0].as_py(), Block(table), {k: [] for k in _SEGMENTS}
        codes, docs, starts, ends = [], [], [], []
        for first, begins, x in block.padded():
            places, hashes = anchors(x)
            places = places[(hashes >> np.uint64(20)) % np.uint64(SEGMENT) == 0]
            stops = begins + np.diff(block.offsets)[first : first + len(begins)]
            heads = np.sort(np.concatenate([begins, places]))
            heads = heads[np.concatenate([[True], heads[1:] != heads[:-1]])]
            doc = np.searchsorted(begins, heads, "right") - 1
            last = np.concatenate([doc[1:] != doc[:-1], [True]])
            tails = np.where(last, stops[doc], np.minimum(np.append(heads[1:], 0) + LENGTH, stops[doc]))
            use = (tails - heads >= LENGTH) & block.known[first + doc]
            heads, tails, doc = heads[use], tails[use], doc[use]
            data = x.tobytes()
            codes += [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(heads.tolist(), tails.tolist(), strict=True)]
            docs.append(first + doc)
            starts.append(heads - begins[doc])
            ends.append(tails - begins[doc])
        if not codes:
            return _rows(out, _SEGMENTS)
        codes = np.frombuffer(b"".join(codes), np.uint64).reshape(-1, 2)
        docs, starts, ends = np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)
        ids = block.ids[docs]
        late = ids > _least(codes, ids)
        if late.any():
            n, a, z = _merged(docs[late], starts[late], ends[late])
            _add(out, range=number % (1 << bits), block=number, kind=-1, codes=b"", docs=b"", numbers=n, starts=a, ends=z)
        codes, docs, starts, ends, ids = (x[~late] for x in (codes, docs, starts, ends, ids))
        for r, own in _dealt(codes[:, 0] >> np.uint64(64 - bits)):
            _add(out, range=r, block=number, kind=0, codes=codes[own], docs=ids[own], numbers=docs[own], starts=starts[own], ends=ends[own])
        return _rows(out, _SEGMENTS)

    return run


def _least(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each pair of 64-bit codes the smallest id of an equal pair."""
    by = np.lexsort((ids, codes[:, 1], codes[:, 0]))
    fresh = np.concatenate([[True], (codes[by][1:] != codes[by][:-1]).any(axis=1)])
    out = np.empty(len(ids), ids.dtype)
    out[by] = ids[by][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return out


def _dealt(to: np.ndarray):
    """The ranges that occur, with the numbers of their rows."""
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1], [True]])) if len(to) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(to[by[a]]), by[a:b]


def _settle_segments(key, table):
    """By range: spans of segments that a smaller document has, by block."""
    out, kinds = {k: [] for k in _SPANS}, np.asarray(table.column("kind"))
    for k in np.flatnonzero(kinds == -1):
        for name in _SPANS:
            out[name].append(table.column(name)[int(k)].as_py())
    use = np.flatnonzero(kinds == 0)
    if len(use):
        get = lambda name, kind: [np.frombuffer(table.column(name)[int(k)].as_buffer(), kind) for k in use]
        docs = get("docs", np.int64)
        late = np.concatenate(docs) > _least(np.concatenate(get("codes", np.uint64)).reshape(-1, 2), np.concatenate(docs))
        at = 0
        for k, own, numbers, starts, ends in zip(use, docs, get("numbers", np.int32), get("starts", np.int32), get("ends", np.int32), strict=True):
            hit = late[at : at + len(own)]
            at += len(own)
            if hit.any():
                _add(out, block=table.column("block")[int(k)].as_py(), numbers=numbers[hit], starts=starts[hit], ends=ends[hit])
    return _rows(out, _SPANS)


def _spans_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All spans of a table's rows, merged."""
    return _merged(*(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in table.column(name))]) for name in ("numbers", "starts", "ends")))


def _done(spans: tuple, first: int, begins: np.ndarray, size: int) -> np.ndarray:
    """Marks the starts of strings that lie inside spans, in a slice's padded bytes."""
    numbers, starts, ends = spans
    own = (numbers >= first) & (numbers < first + len(begins)) & (ends - starts >= LENGTH)
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, begins[numbers[own] - first] + starts[own], 1)
    np.add.at(steps, begins[numbers[own] - first] + ends[own] - LENGTH + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _send_anchors(bits: int):
    """By block: each range's distinct anchors, as their 32 bits below the range's, and how many documents hold it.

    One row more (kind -1) takes the block's covered spans along.
    """

    def run(key, table, covered):
        if not table.num_rows:
            return _rows({k: [] for k in _ANCHORS}, _ANCHORS)
        block, codes, docs, spans = Block(table), [], [], _spans_of(covered)
        for first, begins, x in block.padded():
            places, hashes = anchors(x, _done(spans, first, begins, len(x)))
            codes.append(hashes >> np.uint64(32 - bits))
            docs.append(first + np.searchsorted(begins, places, "right") - 1)
        codes, docs = np.concatenate([np.zeros(0, np.uint64), *codes]), np.concatenate([np.zeros(0, np.int64), *docs])
        by = np.argsort(codes, kind="stable")
        codes, ids = codes[by], block.ids[docs[by]]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        other = np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)]  # a code's documents are in order
        other[starts] = True
        holders = np.minimum(np.add.reduceat(other, starts, dtype=np.int64), 255).astype(np.uint8) if len(codes) else np.zeros(0, np.uint8)
        codes = codes[starts]
        low = (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out, number = {k: [] for k in _ANCHORS}, key[0].as_py()
        for r, own in _dealt(codes >> np.uint64(32)):
            _add(out, range=r, block=number, kind=0, codes=low[own], holders=holders[own], numbers=b"", starts=b"", ends=b"")
        _add(out, range=number % (1 << bits), block=number, kind=-1, codes=b"", holders=b"", numbers=spans[0], starts=spans[1], ends=spans[2])
        return _rows(out, _ANCHORS)

    return run


_ANCHORS = {"range": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "codes": pa.binary(), "holders": pa.binary(), "numbers": pa.binary(), "starts": pa.binary(), "ends": pa.binary()}
_REPLIES = {"range": pa.int64(), "block": pa.int64(), "codes": pa.binary(), "broad": pa.binary(), "numbers": pa.binary(), "starts": pa.binary(), "ends": pa.binary()}


def _shared_anchors(limit: int):
    """By range: for each block, those of its anchors that other documents hold too; apart, those in ``limit`` documents and more."""

    def run(key, table):
        out, kinds, number = {k: [] for k in _REPLIES}, np.asarray(table.column("kind")), key[0].as_py()
        for k in np.flatnonzero(kinds == -1).tolist():
            _add(out, range=number, codes=b"", broad=b"", **{name: table.column(name)[k].as_py() for name in ("block", "numbers", "starts", "ends")})
        use = np.flatnonzero(kinds == 0).tolist()
        if use:
            own = [np.frombuffer(table.column("codes")[k].as_buffer(), np.uint32) for k in use]
            holders = np.concatenate([np.frombuffer(table.column("holders")[k].as_buffer(), np.uint8) for k in use])
            values, place = np.unique(np.concatenate(own), return_inverse=True)
            count = np.bincount(place, weights=holders, minlength=len(values))
            again, wide = count > 1, count >= limit
            at = 0
            for k, x in zip(use, own, strict=True):
                flags, many = again[place[at : at + len(x)]], wide[place[at : at + len(x)]]
                at += len(x)
                if flags.any():
                    _add(out, range=number, block=table.column("block")[k].as_py(), codes=x[flags & ~many], broad=x[flags & many], numbers=b"", starts=b"", ends=b"")
        return _rows(out, _REPLIES)

    return run


_SENT = {"range": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "strings": pa.binary(), "docs": pa.binary(), "numbers": pa.binary(), "places": pa.binary()}


def _edges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many padding bytes stand in front of each row's text and behind it."""
    real = rows != PAD
    return real.argmax(axis=1), real[:, ::-1].argmax(axis=1)


def _send_surroundings(bits: int):
    """By block: the surroundings of shared anchors by range, and the spans that are settled here (kind -1)."""

    def run(key, table, replies):
        number = key[0].as_py()
        out: dict[str, list] = {k: [] for k in _SENT}
        if not table.num_rows or not replies.num_rows:
            return _rows(out, _SENT)
        ranges, spans = np.asarray(replies.column("range")), _spans_of(replies)

        def known(name: str) -> np.ndarray:
            found = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) | (np.uint64(r) << np.uint64(32)) for r, x in zip(ranges, replies.column(name), strict=True)]
            return np.sort(np.concatenate(found))

        wanted = {0: known("codes"), 1: known("broad")}
        block, got = Block(table), {0: [], 1: []}
        for first, begins, x in block.padded():
            places, hashes = anchors(x, _done(spans, first, begins, len(x)))
            codes = hashes >> np.uint64(32 - bits)
            for kind, names in wanted.items():
                if not len(names):
                    continue
                hit = names[np.minimum(np.searchsorted(names, codes), len(names) - 1)] == codes
                at, to = places[hit] - REACH, codes[hit] >> np.uint64(32)
                if kind:  # all strings over the anchor, one by one
                    at = np.unique((at[:, None] + np.arange(REACH + 1)).ravel())
                    at = at[(x[at] != PAD) & (x[at + LENGTH - 1] != PAD)]
                rows = np.lib.stride_tricks.sliding_window_view(x, LENGTH if kind else SURROUND)[at]
                if kind:
                    rows = np.concatenate([rows, np.full((len(rows), REACH), PAD, np.uint8)], axis=1)
                    to = rolling(rows.reshape(-1), LENGTH)[:: SURROUND][: len(rows)] >> np.uint64(64 - bits) if len(rows) else at.astype(np.uint64)
                doc = np.searchsorted(begins, at + (0 if kind else REACH), "right") - 1
                got[kind].append((rows, first + doc, at - begins[doc], to))
        settled: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [spans]
        for kind, parts in got.items():
            if not parts:
                continue
            rows, docs, at, to = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids = block.ids[docs]
            _, least = _distinct(rows, ids, ids)
            late = ids > least
            front, back = _edges(rows[late])
            settled.append((docs[late], at[late] + front, at[late] + SURROUND - back))
            rows, docs, at, to, ids = (x[~late] for x in (rows, docs, at, to, ids))
            for r, own in _dealt(to):
                for name, value in (("range", r), ("block", number), ("kind", kind), ("strings", rows[own].tobytes()), ("docs", ids[own].tobytes()), ("numbers", docs[own].astype(np.int32).tobytes()), ("places", at[own].astype(np.int32).tobytes())):
                    out[name].append(value)
        docs, starts, ends = _merged(*(np.concatenate(x) for x in zip(*settled, strict=True)))
        if len(docs):
            for name, value in (("range", number % (1 << bits)), ("block", number), ("kind", -1), ("strings", starts.astype(np.int32).tobytes()), ("docs", b""), ("numbers", docs.astype(np.int32).tobytes()), ("places", ends.astype(np.int32).tobytes())):
                out[name].append(value)
        release()
        return _rows(out, _SENT)

    return run


def _merged(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one."""
    by = np.lexsort((starts, docs))
    docs, starts, ends = docs[by], starts[by].astype(np.int64), ends[by].astype(np.int64)
    if not len(docs):
        return docs, starts, ends
    shift = docs.astype(np.int64) << 33  # each document's own stretch, so that a running maximum doesn't leave it
    most = np.maximum.accumulate(ends + shift)
    new = np.concatenate([[True], (starts + shift)[1:] > most[:-1]])
    first = np.flatnonzero(new)
    return docs[first], starts[first], (most - shift)[np.append(first[1:], len(docs)) - 1]


#: Places whose smallest document and common prefix are held together, for what jumps don't settle.
MINIMA = 64


def nearest_smaller(docs: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller document (-1: none), and the common prefix with it.

    ``lcp`` is each suffix's common prefix with the one before. All places jump at once: from one whose document isn't smaller
    to where that one has got to. Some orders, such as documents that rise and then fall, would need a jump for each place; what
    is open after some jumps is found by minima over blocks and over runs of blocks, in rounds that don't grow but by the logarithm.
    """
    at, common = np.arange(-1, len(docs) - 1), lcp.copy()
    open_ = np.flatnonzero((at >= 0) & (docs[at] >= docs))
    for _ in range(2 * len(docs).bit_length()):
        if not len(open_):
            break
        over = at[open_]
        common[open_] = np.minimum(common[open_], common[over])
        at[open_] = at[over]
        open_ = open_[(at[open_] >= 0) & (docs[at[open_]] >= docs[open_])]
    if len(open_):
        at[open_], common[open_] = _by_minima(docs, lcp, docs[open_], at[open_], common[open_])
    common[at < 0] = 0
    return at, common


def _by_minima(docs: np.ndarray, lcp: np.ndarray, own: np.ndarray, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the search of ``nearest_smaller`` ends for places with the documents ``own`` that have got to ``at``, which isn't smaller, with ``common``."""
    n_blocks = -(-len(docs) // MINIMA)
    pad = n_blocks * MINIMA - len(docs)
    most = np.iinfo(np.int64).max
    least = [np.pad(x.astype(np.int64), (0, pad), constant_values=most).reshape(n_blocks, MINIMA).min(axis=1) for x in (docs, lcp)]
    tables = [tuple(least)]  # of runs of 1, 2, 4 ... blocks that end at a block
    while 2 << len(tables) - 1 <= n_blocks:
        width = 1 << len(tables) - 1
        tables.append(tuple(np.minimum(t, np.concatenate([np.full(width, most), t[:-width]])) for t in tables[-1]))

    def walk(todo: np.ndarray, stop_at_edge: bool) -> np.ndarray:
        """Moves down place by place; which have come to the last place of a block without an end."""
        edge = []
        while len(todo):
            common[todo] = np.minimum(common[todo], lcp[at[todo]])
            at[todo] -= 1
            todo = todo[at[todo] >= 0]
            todo = todo[docs[at[todo]] >= own[todo]]
            if stop_at_edge:
                last = at[todo] % MINIMA == MINIMA - 1
                edge.append(todo[last])
                todo = todo[~last]
        return np.concatenate(edge) if edge else todo

    far = walk(np.arange(len(own)), True)
    block = at[far] // MINIMA
    for k in range(len(tables) - 1, -1, -1):
        there = block - (1 << k) + 1 >= 0
        docs_of, lcp_of = tables[k]
        skip = there & (docs_of[block] >= own[far])
        common[far[skip]] = np.minimum(common[far[skip]], lcp_of[block[skip]])
        block[skip] -= 1 << k
    at[far] = np.where(block < 0, -1, block * MINIMA + MINIMA - 1)
    near = far[block >= 0]
    walk(near[docs[at[near]] >= own[near]], False)
    return at, common


def longest_previous_factors(suffixes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long suffixes (rows of bytes), and in that order how long a prefix an earlier document has, too.

    That is the longer of the common prefixes with the previous and with the next smaller document in suffix order.
    """
    n, length = suffixes.shape
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = suffixes
    words = wide.view(">u8")
    order = np.lexsort((docs, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    docs, rows = docs[order], suffixes[order]
    other = rows[1:] != rows[:-1]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(other.any(axis=1), other.argmax(axis=1), length)
    before = nearest_smaller(docs, lcp)[1]
    after = nearest_smaller(docs[::-1], np.append(lcp[1:], 0)[::-1])[1][::-1]
    return order, np.maximum(before, after)


def covered_strings(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct surroundings, first and last start of a LENGTH-byte string that a smaller document has (-1: none).

    Those are the suffixes (as far as LENGTH bytes) whose longest previous factor is LENGTH bytes.
    """
    low, high = np.full(len(rows), REACH + 1), np.full(len(rows), -1)
    # equal strings have an anchor in common, so surroundings meet by the bytes of their anchor, a part of them at a time
    wide = np.zeros((len(rows), 32), np.uint8)
    wide[:, :KMER] = rows[:, REACH : REACH + KMER]
    with np.errstate(over="ignore"):
        anchor = mix((mix(wide.view(np.uint64)) * _FACTORS[:4]).sum(axis=1, dtype=np.uint64))
    by = np.argsort(anchor, kind="stable")
    fresh = np.concatenate([[True], anchor[by][1:] != anchor[by][:-1]]) if len(rows) else np.zeros(0, bool)
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(rows)))
    group, by = np.repeat(np.cumsum(sizes * (sizes > 1)), sizes), by[np.repeat(sizes > 1, sizes)]
    group = group[np.repeat(sizes > 1, sizes)] // _PART
    for part in np.split(by, np.flatnonzero(np.diff(group)) + 1) if len(by) else ():
        low[part], high[part] = _covered_part(rows[part], docs[part])
    return low, high


def _covered_part(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(len(rows), REACH + 1), np.full(len(rows), -1)
    flat = rows.reshape(-1)
    codes = rolling(flat, LENGTH)
    codes = np.lib.stride_tricks.as_strided(codes, (len(rows), REACH + 1), (SURROUND * 8, 8)).copy()
    front, back = _edges(rows)
    starts = np.arange(REACH + 1)
    whole = (starts >= front[:, None]) & (starts <= REACH - back[:, None])
    row, start = np.nonzero(whole)
    codes = codes[row, start]
    ordered = np.sort(codes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return low, high
    may = twice[np.minimum(np.searchsorted(twice, codes), len(twice) - 1)] == codes
    row, start = row[may], start[may]
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[row * SURROUND + start])
    order, factor = longest_previous_factors(suffixes, docs[row])
    found = order[factor >= LENGTH]
    np.minimum.at(low, row[found], start[found])
    np.maximum.at(high, row[found], start[found])
    return low, high


def _settle(key, table):
    """By range: the spans that longest previous factors cover, by block."""
    kinds, blocks = np.asarray(table.column("kind")), np.asarray(table.column("block"))
    out: dict[str, list] = {k: [] for k in _SPANS}
    spans: list[tuple] = []

    def column(name: str, k: int, kind) -> np.ndarray:
        return np.frombuffer(table.column(name)[k].as_buffer(), kind)

    for k in np.flatnonzero(kinds == -1):
        for name, value in (("block", blocks[k]), ("numbers", table.column("numbers")[k].as_py()), ("starts", table.column("strings")[k].as_py()), ("ends", table.column("places")[k].as_py())):
            out[name].append(value)
    for kind in (0, 1):
        use = np.flatnonzero(kinds == kind)
        if not len(use):
            continue
        rows = np.concatenate([column("strings", k, np.uint8) for k in use]).reshape(-1, SURROUND)
        docs, numbers, at = (np.concatenate([column(name, k, t) for k in use]) for name, t in (("docs", np.int64), ("numbers", np.int32), ("places", np.int32)))
        block = np.repeat(blocks[use], [len(column("docs", k, np.int64)) for k in use])
        first, least = _distinct(rows, docs, docs)
        late = docs > least
        front, back = _edges(rows[late])
        spans.append((block[late], numbers[late], at[late] + front, at[late] + SURROUND - back))
        if kind:
            continue
        heads = np.unique(first)  # each distinct surroundings once, with its smallest document
        low, high = covered_strings(rows[heads], docs[heads])
        head = np.searchsorted(heads, first)
        part = ~late & (high[head] >= 0)
        spans.append((block[part], numbers[part], at[part] + low[head[part]], at[part] + high[head[part]] + LENGTH))
    if spans:
        block, numbers, starts, ends = (np.concatenate(x) for x in zip(*spans, strict=True))
        by = np.argsort(block, kind="stable")
        names, cuts = np.unique(block[by], return_index=True)
        for b, a, z in zip(names, cuts, [*cuts[1:], len(by)], strict=len(by) > 0):
            own = by[a:z]
            n, s, e = _merged(numbers[own], starts[own], ends[own])
            for name, value in (("block", b), ("numbers", n.astype(np.int32).tobytes()), ("starts", s.astype(np.int32).tobytes()), ("ends", e.astype(np.int32).tobytes())):
                out[name].append(value)
    release()
    return _rows(out, _SPANS)


def _cut(with_text: bool):
    """By block: what is left of each document."""

    def run(key, table, spans):
        block = Block(table)
        n = len(block.ids)
        docs, starts, ends = _spans_of(spans)
        by_doc = np.searchsorted(docs, np.arange(n + 1))
        removed, count, sha, left = [], [], [], []
        for k in range(n):
            text, a, pieces = block.raw[block.offsets[k] : block.offsets[k + 1]], 0, []
            for s in range(by_doc[k], by_doc[k + 1]):
                pieces.append(text[a : starts[s]])
                a = ends[s]
            pieces.append(text[a:])
            kept = b"".join(x.tobytes() for x in pieces)
            removed.append(len(text) - len(kept))
            count.append(int(by_doc[k + 1] - by_doc[k]))
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                left.append(kept.decode("utf-8", "ignore"))
        own = {"doc_id": block.table.column("doc_id"), "n_bytes": pa.array(np.diff(block.offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            own["text"] = pa.array(left, pa.string())
            for c in block.table.column_names:
                if c.startswith("row_"):
                    own[c] = block.table.column(c)
        release()
        return pa.table(own)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256[, text] of each row of ``docs``.

    Strings are judged on the input, as UTF-8 bytes; a null text is empty and never matches. Matches need a smaller
    doc_id: rows that share one don't remove from each other, and rows without one neither remove nor lose. ``text`` is
    what remains, without bytes of characters that were cut in two; with it the column ``row_rest`` passes through.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST, total // BLOCK_BYTES + 1)
    bits = (max(LEAST, total // RANGE_BYTES + 1) - 1).bit_length()
    rest = ["row_rest"] if with_text and "row_rest" in docs.columns else []
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long").alias("block"), F.col("doc_id"), F.col("text"), *rest).repartition(blocks, "block")
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    ddl = lambda kinds: ", ".join(f"{k} {names[t]}" for k, t in kinds.items())
    by_block = dealt.groupBy("block")
    by_range = lambda frame: frame.repartition(1 << bits, "range").groupBy("range")  # noqa: E731 (tasks grow in number with the ranges)
    segments = by_range(by_block.applyInArrow(_send_segments(bits), ddl(_SEGMENTS))).applyInArrow(_settle_segments, ddl(_SPANS))
    sent = by_block.cogroup(segments.groupBy("block")).applyInArrow(_send_anchors(bits), ddl(_ANCHORS))
    replies = by_range(sent).applyInArrow(_shared_anchors(wide), ddl(_REPLIES))
    strings = by_block.cogroup(replies.groupBy("block")).applyInArrow(_send_surroundings(bits), ddl(_SENT))
    spans = by_range(strings).applyInArrow(_settle, ddl(_SPANS))
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", text string" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(_cut(with_text), schema)
