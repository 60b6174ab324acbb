"""Main text of web pages: structure first, then suffix arrays over the pages of a host.

1. Each page is read once, from front to back, into blocks of text with what its elements say of them: in an article
   or main element, in a menu, header, footer, sidebar, notice, advert, form or comment, or neither.
2. Pages of a host meet. Their token streams are laid end to end, a suffix array orders them, and runs of ``RUN`` tokens and
   more that stand on ``PAGES`` distinct pages are boilerplate; what they cover goes from blocks that no article holds, and
   unique runs stay. A page that is covered nearly whole is a copy of another page, not boilerplate, and stays whole.
   A host with more than ``GROUP_PAGES`` pages has a suffix array for each group of about so many; groups first send some
   leading bits of their runs' hashes (about a byte a run) to ranges of the hash and hear which others may have, then of these the
   whole hashes with their page counts, and are told what the whole host has. So the result doesn't hang on the groups.
   Pages travel packed, as compressed lists of words and numbers in them.
3. An article is evidence for main text: inside one, runs go that stand on ``ARTICLE_PAGES`` pages and more, and stretches of
   ``ARTICLE_RUN`` tokens and more whose runs stand on ``PAGES`` pages and outside articles, too.

Where a page has text in an article, that is its main text; else what is left of its other blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.textbatch import mix, release, slices, span_hashes

#: Pages in a group of a large host, and bytes of html that a task packs together.
GROUP_PAGES, PACK_BYTES = 2048, 4 << 20
RUN, PAGES, ARTICLE_RUN, ARTICLE_PAGES = 8, 3, 24, 10
#: Share of a page's tokens that, if covered, shows a copy of another page.
COPY_SHARE = 0.8
#: Hosts with more pages than a group up to which their list is broadcast.
BROADCAST_HOSTS = 50_000

#: Elements by what they are to main text.
DROPPED = frozenset("nav footer aside form noscript template iframe svg button select textarea dialog menu object canvas head label option datalist map audio video".split())
RAW = frozenset("script style title textarea noscript xmp".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split())
#: Elements that are followed as they open and close; the others end where the next block begins.
HELD = frozenset("article aside div dialog footer form head header main menu nav section table ul ol svg object button select noscript template iframe fieldset figure details label canvas map audio video datalist".split())
#: Words in class, id and role that name what isn't main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead comment comments discussion disqus reply replies share sharing social related recommended recommendations promo promotion sponsor sponsored newsletter subscribe subscription"
    " signup login search searchbox widget toolbar pagination pager alert complementary contentinfo dialog hidden".split()
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z][^\s/>]*", re.I)
#: Up to the end of a tag: quotes open after = alone, and whatever they hold belongs to the value; without a second one they are plain.
_TO_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_WORDS = re.compile(r"[a-z]+")

ARTICLE, OTHER, OUT = 0, 1, 2

_PLACES = np.random.default_rng(31).integers(1, 2**63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _unwanted(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element isn't main text, by its name and attributes."""
    if name in DROPPED or (name == "header" and not in_main):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key in ("class", "id", "role"):
            words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", (m[2] or "")).lower()))
            if words & NAMES or (not in_main and "header" in words):
                return True
    return False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """Blocks of a page in order: what holds them (ARTICLE, OTHER or OUT), and their text, white space as one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    #: Open elements: name, kind inside.
    stack: list[tuple[str, int]] = []
    kind, at, size = OTHER, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((kind, text))

    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            parts.append(page[at:])
            break
        if tag > at:
            parts.append(page[at:tag])
        after = page[tag + 1 : tag + 2]
        if after in ("!", "?"):
            end = page.find("-->", tag + 4) + 2 if page.startswith("<!--", tag) else page.find(">", tag)
            if end < 2:
                break
            at = end + 1
            continue
        closing = after == "/"
        m = _NAME.match(page, tag + 1 + closing)
        if not m:
            parts.append("<")
            at = tag + 1
            continue
        end = _TO_END.match(page, m.end()).end()
        if end >= size:  # cut off inside a tag
            break
        name, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        if name in RAW and not closing:
            close = re.compile(f"</{name}[\\s>]", re.I).search(page, at)
            if not close:
                break
            at = page.find(">", close.start()) + 1 or size
            continue
        if name in BLOCKS or name in HELD:
            flush()
        elif name in ("br", "img", "input", "wbr"):
            parts.append(" ")
        if name not in HELD or attributes.endswith("/"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    kind = stack[k][1]
                    del stack[k:]
                    break
        else:
            stack.append((name, kind))
            if kind == OUT and not (name in MAIN and stack[-2:-1] and stack[-2][0] in ("nav", "header", "head")):
                continue
            if _unwanted(name, attributes, kind == ARTICLE):
                kind = OUT
            elif name in MAIN:
                kind = ARTICLE
    flush()
    return out


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first tokens (at least ``depth`` of them), and each suffix's rank by these, by doubling."""
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    n = len(tokens)
    while have < depth:
        step = min(have, depth - have)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return np.argsort(rank, kind="stable"), rank


def repeated(tokens: np.ndarray, pages: np.ndarray, length: int, least: int) -> np.ndarray:
    """Which places start a run of ``length`` tokens that stands on ``least`` distinct pages or more.

    Pages are numbered in order and separated by tokens of their own, so that no repeated run spans two.
    """
    order, rank = suffix_order(tokens, length)
    ranks, owners = rank[order], pages[order]
    fresh = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (owners[1:] != owners[:-1])])
    distinct = np.bincount(ranks[fresh])
    return distinct[rank] >= least


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    steps = np.zeros(len(starts) + length + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps)[: len(starts)] > 0


def _pressed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _opened(data, size: int):
    return pa.Codec("zstd").decompress(data, size)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of their places, compressed; the first 16 bytes give their number and width."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    parts = [((x >> (8 * k)) & 0xFF).astype(np.uint8).tobytes() for k in range(width)]
    return np.array([len(x), width], np.int64).tobytes() + _pressed(b"".join(parts))


def _from_planes(data) -> np.ndarray:
    data = memoryview(data)
    n, width = np.frombuffer(data[:16], np.int64).tolist()
    out = np.zeros(n, np.int64)
    if n and width:
        flat = np.frombuffer(_opened(data[16:], n * width), np.uint8).reshape(width, n)
        for k in range(width):
            out |= flat[k].astype(np.int64) << (8 * k)
    return out


_PARTS = ("words", "ids", "sizes", "kinds", "blocks")


def packed(pages: list[list[tuple[int, str]]]) -> dict[str, bytes]:
    """Pages as a list of words and numbers in it, with the blocks' sizes and kinds and the pages' numbers of blocks."""
    words: dict[str, int] = {}
    ids, sizes, kinds = [], [], []
    for page in pages:
        for kind, text in page:
            own = text.split(" ")
            ids += [words.setdefault(w, len(words)) for w in own]
            sizes.append(len(own))
            kinds.append(kind)
    listed = " ".join(words).encode()
    arrays = (ids, sizes, kinds, [len(x) for x in pages])
    return {"words": np.int64(len(listed)).tobytes() + _pressed(listed), **{k: _planes(np.array(x, np.int64)) for k, x in zip(_PARTS[1:], arrays, strict=True)}}


class Group:
    """Pages of one host that are held together, from their packed rows: token streams end to end, a token of its own behind each page.

    Only page ends are such tokens, so runs go on from block to block of a page.
    """

    def __init__(self, rows: list[dict[str, bytes]]):
        self.words: list[str] = []
        names, local, sizes, kinds, counts = [], [], [], [], []
        for row in rows:
            data = memoryview(row["words"])
            listed = bytes(_opened(data[8:], int(np.frombuffer(data[:8], np.int64)[0])))
            raw = np.frombuffer(listed, np.uint8)
            cuts = np.flatnonzero(raw == 32)
            if len(raw):
                names.append(span_hashes(raw, np.concatenate([[0], cuts + 1]), np.append(cuts, len(raw))))
            local.append(_from_planes(row["ids"]) + len(self.words))
            sizes.append(_from_planes(row["sizes"]))
            kinds.append(_from_planes(row["kinds"]))
            counts.append(_from_planes(row["blocks"]))
            self.words += listed.decode().split(" ") if listed else []
        empty = [np.zeros(0, np.int64)]
        names = np.concatenate([np.zeros(0, np.uint64), *names])
        self.local, self.sizes, block_kinds, self.counts = (np.concatenate(empty + x) for x in (local, sizes, kinds, counts))
        self.block_kinds = block_kinds
        word_hashes, number = np.unique(names, return_inverse=True)
        n, pages, blocks = len(self.local), len(self.counts), len(self.sizes)
        page_of_block = np.repeat(np.arange(pages), self.counts)
        tokens = np.zeros(pages, np.int64)
        np.add.at(tokens, page_of_block, self.sizes)
        own = np.repeat(page_of_block, self.sizes)
        self.at = np.arange(n) + own  # where each token stands
        self.ends = np.ones(n + pages, bool)
        self.ends[self.at] = False
        self.owner, self.kinds, self.block = np.repeat(np.arange(pages), tokens + 1), np.full(n + pages, -1), np.full(n + pages, -1)
        self.kinds[self.at] = np.repeat(block_kinds, self.sizes)
        self.block[self.at] = np.repeat(np.arange(blocks), self.sizes)
        self.block[self.ends] = blocks + np.arange(pages)
        self.ids = np.empty(n + pages, np.int64)
        self.ids[self.at] = number[self.local]
        self.ids[self.ends] = len(word_hashes) + np.arange(pages)
        self.hashes = np.zeros(n + pages, np.uint64)
        self.hashes[self.at] = names[self.local]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of ``RUN`` tokens of one page starts, and hashes of these runs, the same in all groups."""
        n = len(self.ids) - RUN + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = self.hashes[:n] * _PLACES[0]
            for k in range(1, RUN):
                sums += self.hashes[k : n + k] * _PLACES[k]
            sums = mix(sums)
        whole = np.flatnonzero((self.owner[:n] == self.owner[RUN - 1 :]) & ~self.ends[RUN - 1 :])
        return whole, sums[whole]

    def counted(self, places: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, on how many pages each stands, and whether it stands outside articles somewhere."""
        by = np.lexsort((places, codes))
        codes, places = codes[by], places[by]
        fresh = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
        page = np.concatenate([[True], (codes[1:] != codes[:-1]) | (self.owner[places[1:]] != self.owner[places[:-1]])])[: len(codes)]
        heads = np.flatnonzero(fresh)
        if not len(heads):
            return codes, np.zeros(0, np.int64), np.zeros(0, bool)
        return codes[heads], np.add.reduceat(page.astype(np.int64), heads), np.logical_or.reduceat(self.kinds[places] != ARTICLE, heads)


class Runs:
    """By a suffix array over a group's pages: of each run of ``RUN`` tokens on how many pages it stands, and if outside articles."""

    def __init__(self, group: Group):
        self.group, self.owner, self.kinds, self.block = group, group.owner, group.kinds, group.block
        order, self.rank = suffix_order(group.ids, RUN)
        ranks, owners = self.rank[order], self.owner[order]
        fresh = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (owners[1:] != owners[:-1])])
        self.pages = np.bincount(ranks[fresh])
        self.outside = np.zeros(len(self.pages), bool)
        self.outside[self.rank[self.kinds != ARTICLE]] = True

    def told(self, codes: np.ndarray, pages: np.ndarray, outside: np.ndarray) -> None:
        """Takes over what the whole host has of runs (sorted hashes)."""
        places, own = self.group.codes()
        if len(codes) and len(own):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = codes[at] == own
            ranks = self.rank[places[hit]]
            self.pages[ranks], self.outside[ranks] = pages[at[hit]], outside[at[hit]]

    def _gone(self, starts: np.ndarray, kind: int) -> np.ndarray:
        """Which tokens of blocks of a kind the runs cover: runs inside one block, and those across blocks if a block is covered whole."""
        last = np.minimum(np.arange(len(self.rank)) + RUN - 1, len(self.rank) - 1)
        gone = _covered(starts & (self.block == self.block[last]), RUN)
        bare = np.bincount(self.block[~_covered(starts, RUN)], minlength=int(self.block.max()) + 1)
        return (gone | (bare[self.block] == 0)) & (self.kinds == kind)

    def _without_copies(self, gone: np.ndarray, kind: int) -> np.ndarray:
        """``gone`` without pages that are covered nearly whole."""
        own = self.kinds == kind
        total, part = np.bincount(self.owner[own], minlength=self.owner[-1] + 1), np.bincount(self.owner[own & gone], minlength=self.owner[-1] + 1)
        return gone & ~(part > COPY_SHARE * total)[self.owner]

    def boilerplate(self) -> np.ndarray:
        """Which tokens go."""
        pages, outside = self.pages[self.rank], self.outside[self.rank]
        gone = self._without_copies(self._gone(pages >= PAGES, OTHER), OTHER)
        gone |= self._without_copies(self._gone(pages >= ARTICLE_PAGES, ARTICLE), ARTICLE)
        # long stretches in articles: each run in them repeats and stands outside articles, too
        known = (pages >= PAGES) & outside & (self.kinds == ARTICLE)
        cut = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
            if b - a + RUN - 1 >= ARTICLE_RUN:
                gone[a : b + RUN - 1] |= self.kinds[a : b + RUN - 1] == ARTICLE
        return gone


def main_texts(group: Group, runs: Runs | None = None) -> list[str]:
    """Main texts of the pages of one group of a host."""
    if not len(group.counts):
        return []
    keep = ~(runs or Runs(group)).boilerplate()[group.at]
    page_of_block = np.repeat(np.arange(len(group.counts)), group.counts)
    article = np.zeros(len(group.counts), bool)
    article[page_of_block[group.block_kinds == ARTICLE]] = True
    wanted = group.block_kinds == np.where(article[page_of_block], ARTICLE, OTHER)
    block_of = np.repeat(np.arange(len(group.sizes)), group.sizes)
    keep &= wanted[block_of]
    left = np.bincount(block_of[keep], minlength=len(group.sizes))
    words, ids, at = group.words, group.local[keep].tolist(), 0
    lines: list[list[str]] = [[] for _ in group.counts]
    for page, n in zip(page_of_block[left > 0].tolist(), left[left > 0].tolist(), strict=True):
        lines[page].append(" ".join([words[k] for k in ids[at : at + n]]))
        at += n
    return ["\n".join(x) for x in lines]


def texts_of(pages: list[list[tuple[int, str]]]) -> list[str]:
    """Main texts of all pages of one small host, from their blocks."""
    return main_texts(Group([packed(pages)]))


#: Bits of a run's hash that are exchanged first, beside the bits that number the groups.
_FIRST_BITS = 26


def _cut_codes(codes: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The leading bits of sorted distinct hashes that are exchanged first, each once, their ranges, and the bits that are left out."""
    drop = np.uint64(64 - min(64, _FIRST_BITS + (more + 1).bit_length()))
    heads = np.unique(codes >> drop)
    return heads, ((heads << drop) >> np.uint64(32)) * np.uint64(more // 4 + 1) >> np.uint64(32), int(drop)


def _by_range(ranges: np.ndarray):
    """The ranges of sorted hashes, with where each begins and ends."""
    cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(ranges) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(ranges[a]), a, b


def _rows_of(table: pa.Table) -> list[dict[str, bytes]]:
    return [{k: table.column(k)[row].as_buffer() for k in _PARTS} for row in range(table.num_rows)]


def _bits(mask: np.ndarray) -> bytes:
    return np.int64(len(mask)).tobytes() + _pressed(np.packbits(mask).tobytes())


def _from_bits(data) -> np.ndarray:
    data = memoryview(data)
    n = int(np.frombuffer(data[:8], np.int64)[0])
    return np.unpackbits(np.frombuffer(_opened(data[8:], (n + 7) // 8), np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


_SKETCH = {"host": pa.string(), "part": pa.int64(), "range": pa.int64(), "data": pa.binary()}
_ASKED = {"host": pa.string(), "part": pa.int64(), "range": pa.int64(), "codes": pa.binary(), "pages": pa.binary(), "outside": pa.binary()}
_DDL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_DDL[t]}" for k, t in kinds.items())


class _Out:
    """Rows to send."""

    def __init__(self, kinds: dict[str, pa.DataType]):
        self.kinds, self.columns = kinds, {k: [] for k in kinds}

    def add(self, **row) -> None:
        for name, value in row.items():
            self.columns[name].append(value)

    def table(self) -> pa.Table:
        release()
        return pa.table({k: pa.array(v, self.kinds[k]) for k, v in self.columns.items()})


def _sketch(key, table):
    """By group of a large host: the leading bits of its runs' hashes, by range."""
    out, more = _Out(_SKETCH), table.column("more")[0].as_py()
    if more:
        heads, ranges, _ = _cut_codes(Group(_rows_of(table)).codes()[1], more)
        for r, a, b in _by_range(ranges):
            out.add(host=key[0].as_py(), part=key[1].as_py(), range=r, data=_planes(np.diff(heads[a:b], prepend=np.uint64(0)).astype(np.int64)))
    return out.table()


def _shared(key, table):
    """By range of a host: for each group, which of its heads other groups have too."""
    out = _Out(_SKETCH)
    heads = [np.cumsum(_from_planes(x.as_buffer())) for x in table.column("data")]
    values, place, count = np.unique(np.concatenate(heads), return_inverse=True, return_counts=True)
    at = 0
    for k, x in enumerate(heads):
        out.add(host=key[0].as_py(), part=table.column("part")[k].as_py(), range=key[1].as_py(), data=_bits(count[place[at : at + len(x)]] > 1))
        at += len(x)
    return out.table()


def _ask(key, table, replies):
    """By group: hashes of the runs that other groups may have, with the group's pages, by range."""
    out = _Out(_ASKED)
    if table.num_rows and replies.num_rows:
        more, group = table.column("more")[0].as_py(), Group(_rows_of(table))
        places, codes = group.codes()
        heads, _, drop = _cut_codes(codes, more)
        order = np.argsort(np.asarray(replies.column("range")))
        wanted = heads[np.concatenate([_from_bits(replies.column("data")[int(k)].as_buffer()) for k in order])]
        if len(wanted):
            own = codes >> np.uint64(drop)
            use = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
            codes, pages, outside = group.counted(places[use], codes[use])
            for r, a, b in _by_range((codes >> np.uint64(32)) * np.uint64(more // 4 + 1) >> np.uint64(32)):
                out.add(host=key[0].as_py(), part=key[1].as_py(), range=r, codes=codes[a:b].tobytes(), pages=_planes(pages[a:b]), outside=_bits(outside[a:b]))
    return out.table()


def _tell(key, table):
    """By range of a host: to each group its runs that stand on enough pages of the whole host."""
    out = _Out(_ASKED)
    codes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("codes")]
    values, place = np.unique(np.concatenate(codes), return_inverse=True)
    pages, outside = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    np.add.at(pages, place, np.concatenate([_from_planes(x.as_buffer()) for x in table.column("pages")]))
    np.logical_or.at(outside, place, np.concatenate([_from_bits(x.as_buffer()) for x in table.column("outside")]))
    at = 0
    for k, x in enumerate(codes):
        where = place[at : at + len(x)]
        where = where[pages[where] >= PAGES]
        at += len(x)
        if len(where):
            out.add(host=key[0].as_py(), part=table.column("part")[k].as_py(), range=key[1].as_py(), codes=values[where].tobytes(), pages=_planes(pages[where]), outside=_bits(outside[where]))
    return out.table()


def _finish(key, table, told):
    """By group: its pages' texts."""
    group = Group(_rows_of(table))
    runs = Runs(group) if len(group.counts) else None
    if runs and told.num_rows:
        codes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in told.column("codes")])
        pages = np.concatenate([_from_planes(x.as_buffer()) for x in told.column("pages")])
        outside = np.concatenate([_from_bits(x.as_buffer()) for x in told.column("outside")])
        order = np.argsort(codes)
        runs.told(codes[order], pages[order], outside[order])
    text = main_texts(group, runs)
    flat = lambda name: pa.concat_arrays([c.flatten() for c in table.column(name).chunks]) if table.num_rows else table.column(name).combine_chunks().flatten()
    out = pa.table({"page_id": flat("page_ids"), "url": flat("urls"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})
    release()
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages`` (page_id, url, html).

    Character references are decoded, white space in a block is one space, blocks are joined by line ends in page order.
    A null or empty page has an empty text. Pages without a url, or with one that names no host, are taken as those of
    one host. Rows that share a page_id, a url or both are pages of their own; other columns are not read.
    """
    key, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    large = pages.select(host.alias("host")).groupBy("host").agg((F.count("*") / GROUP_PAGES).cast("long").alias("more")).filter("more > 0")
    if large.count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    groups = pages.count() // GROUP_PAGES + int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs pages by group; a large host's groups take its pages in turn, as they come in a task."""
        turn, held, size = TaskContext.get().partitionId(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn, size
            table = pa.Table.from_batches([x.select(["page_id", "url"]) for x, _ in held])
            found = [page for _, part in held for page in part]
            by_host: dict[str, list[int]] = {}
            for k, name in enumerate(pa.chunked_array([x.column("host") for x, _ in held]).to_pylist()):
                by_host.setdefault(name, []).append(k)
            more = pa.chunked_array([x.column("more") for x, _ in held]).to_pylist()
            for name, own in by_host.items():
                rows, data = table.take(pa.array(own, pa.int64())).combine_chunks(), packed([found[k] for k in own])
                ids, urls = (pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), rows.column(c).chunk(0)) for c in ("page_id", "url"))
                parts = more[own[0]] + 1
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([turn % parts], pa.int64()), pa.array([parts - 1], pa.int64()), ids, urls, *(pa.array([data[k]], pa.binary()) for k in _PARTS)], names=["host", "part", "more", "page_ids", "urls", *_PARTS])
            turn, size = turn + 1, 0
            held.clear()

        for batch in batches:
            for part in slices(batch, "html"):
                held.append((part.drop_columns(["html"]), [blocks_of(t or "") for t in part.column("html").to_pylist()]))
                size += part.column("html").nbytes
                if size >= PACK_BYTES:
                    yield from flush()
        if held:
            yield from flush()
        release()

    packs = pages.select("page_id", "url", "html", host.alias("host")).join(large, "host", "left").select("page_id", "url", "html", "host", F.coalesce("more", F.lit(0)).alias("more"))
    packs = packs.mapInArrow(parse, f"host string, part long, more long, page_ids array<{key}>, urls array<{url}>, " + ", ".join(f"{k} binary" for k in _PARTS))
    dealt = packs.repartition(groups, "host", "part").groupBy("host", "part")
    sketches = dealt.applyInArrow(_sketch, _ddl(_SKETCH)).groupBy("host", "range").applyInArrow(_shared, _ddl(_SKETCH))
    asked = dealt.cogroup(sketches.groupBy("host", "part")).applyInArrow(_ask, _ddl(_ASKED))
    told = asked.groupBy("host", "range").applyInArrow(_tell, _ddl(_ASKED))
    return dealt.cogroup(told.groupBy("host", "part")).applyInArrow(_finish, f"page_id {key}, url {url}, text string, n_chars long")
