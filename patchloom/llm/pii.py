"""Personal data: four exact patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find e-mail and IP addresses, card and telephone numbers. The field labels all of these and secrets. Its
nodes are the patterns' spans, whose labels are known; tokens that could be secrets (those with digits, those that hold or
follow a word such as "password", and all that are like one of these); and numbers and addresses that the patterns
don't match but that are written like one they do (no plus sign, other gaps, "(at)"). Each token has features of its own form
and of the words before it; neighbours, and distant nodes that are the same or similar, share potentials. Loopy message
passing over a whole document makes their labels agree, so a secret that is named once, or a number that is written out
once, is found wherever it is repeated. The field's weights are fitted here, by pseudo-likelihood on sentences made from
a fixed seed; no document is needed for that.

Work is row by row: no shuffle, no skew. A very long text costs time in proportion to its length; each node is tied to
the last one like it only, so a token repeated a thousand times makes a thousand ties.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.textbatch import slices

#: The base patterns, in the order in which kinds are listed.
#: (Written so that no text takes more than linear time: an address is looked for from its @, a number from its first digit.)
EMAIL_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_AFTER = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that announce a secret.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "key", "bearer", "passwort", "contraseña")

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MAYBE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")
_CUE = re.compile(r"(?i)(?<![a-z])(" + "|".join(CUES) + r")(?![a-z])[\"']?$")
_ASSIGNED = re.compile(r"(?i)^[\"'(\[{]*([a-z_-]*(?:" + "|".join(CUES) + r"))[\"']?[=:]+[\"']?(.+)$")
_ANY_CUE = re.compile(r"(?i)(?<![a-z])(?:" + "|".join(CUES) + r")(?![a-z])")
_SIGNS = ("=", ":", "=>", ":=")
_NUMBER = re.compile(r"[0-9]+([.,:/-][0-9]+)*")
_RUN = re.compile(r"\+?[0-9][0-9\x20().-]*[0-9]")
_SPELLED = re.compile(r"\x20?[(\[{](?:at|AT)[)\]}]\x20?")
#: The log-odds of a node that is written like a known number or address, before its ties speak; digits that must agree.
WRITTEN_ALIKE, SAME_DIGITS = -1.0, 8
#: Rounds of message passing, and the share of a new message that is taken over.
ROUNDS, TAKEN = 12, 0.7
N_FEATURES = 15


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each base kind: leftmost matches that don't overlap, without those that fail their test."""
    email: list[tuple[int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_BEFORE:
            start -= 1
        if start < at and (m := EMAIL_AFTER.match(text, at + 1)):
            end = m.end()
            email.append((start, end))
        at = text.find("@", max(at + 1, end))
    ip, card = [], []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            ip.append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return [email, ip, card, phone]


def _core(token: str) -> str:
    return token.strip("\"'.,;:!?()[]{}<>#$%&*|`")


def features(token: str, before: list[str]) -> tuple[np.ndarray, str]:
    """Features of a token after ``before`` (the words in front, nearest last), and its value without name and quotes."""
    assigned = _ASSIGNED.match(token)
    value = _core(assigned[2] if assigned else token)
    sign = bool(before) and before[-1] in _SIGNS
    name = before[-2] if sign and len(before) > 1 else before[-1] if before else ""
    named = bool(_CUE.search(name.rstrip(":=")))
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
    long, mixed = len(value) >= 12, digits >= 2 and letters >= 2
    signed, bare = sign or name.endswith((":", "=")), digits == 0
    odd = len(value) >= 8 and (any(not c.isalnum() for c in value[1:-1]) or any(a.islower() and b.isupper() for a, b in zip(value, value[1:], strict=False)))
    x = (
        1.0, long, mixed and long, turns >= 4 and long, bool(assigned) and digits > 0, named and digits > 0, signed and named and long and not bare,
        mixed and long and value.upper() == value and value.isalnum(), bool(_NUMBER.fullmatch(value)), "://" in token or "@" in token or "." in value.strip("."), len(value) < 8,
        bare, bare and (bool(assigned) or (named and signed)), bare and (bool(assigned) or (named and signed)) and len(value) >= 9, bare and odd and (bool(assigned) or (named and signed)),
    )
    return np.array(x, np.float64), value


def _alike(value: str) -> set[str]:
    """What the values of similar tokens share."""
    return {value, re.sub(r"[^0-9a-z]", "", value.lower())} - {""} if len(value) >= 8 else set()


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that may be secrets, in order."""
    found = {m.start(): m.end() for m in _MAYBE.finditer(text)}
    keys: set[str] = set()
    done = 0
    for m in _ANY_CUE.finditer(text):
        start = m.start()
        if start < done:
            continue
        while start and text[start - 1] not in "\x20\t\n\v\f\r":
            start -= 1
        token = _TOKEN.match(text, start)
        done = token.end()
        if not _ASSIGNED.match(token.group()):
            if not _CUE.search(token.group().rstrip(":=")):
                continue
            token = _TOKEN.search(text, token.end())
            if token and token.group() in _SIGNS:
                token = _TOKEN.search(text, token.end())
        if token and token.start() not in found:
            found[token.start()] = token.end()
            assigned = _ASSIGNED.match(token.group())
            keys |= _alike(_core(assigned[2] if assigned else token.group()))
    if keys:
        for m in _TOKEN.finditer(text):
            if m.start() not in found and m.end() - m.start() >= 8 and _alike(_core(m.group())) & keys:
                found[m.start()] = m.end()
    return sorted(found.items())


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def written_alike(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, str]]:
    """Start, end, kind and what they share of numbers and addresses that are written like one of ``base`` but match no pattern."""
    found = []
    if base[2] or base[3]:
        ends = {}
        for kind in (2, 3):
            for a, b in base[kind]:
                own = _digits(text[a:b])
                for k in range(SAME_DIGITS, len(own) + 1):
                    ends.setdefault(own[-k:], (kind, own))
        for m in _RUN.finditer(text):
            own = _digits(m.group()).lstrip("0")
            if own in ends:
                kind, known = ends[own]
                if kind == 3 or own == known:  # a card's number is whole
                    found.append((*m.span(), kind, known))
    if base[0]:
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start and text[start - 1] in EMAIL_BEFORE:
                start -= 1
            after = EMAIL_AFTER.match(text, m.end())
            if start < m.start() and after:
                found.append((start, after.end(), 0, f"{text[start : m.start()]}@{after.group()}".lower()))
    taken = sorted(s for spans in base for s in spans)
    starts = [a for a, _ in taken]
    out = []
    for a, b, kind, shared in sorted(found):
        k = bisect_right(starts, a) - 1
        if not (k >= 0 and taken[k][1] > a) and not (k + 1 < len(taken) and taken[k + 1][0] < b) and not (out and out[-1][1] > a):
            out.append((a, b, kind, shared))
    return out


class Graph:
    """The nodes of one document in order: their spans, what they could be (a kind of ``KINDS``), if known, features and ties."""

    def __init__(self, text: str, base: list[list[tuple[int, int]]] | None = None):
        base = base or [[], [], [], []]
        other = written_alike(text, base)
        tokens = candidates(text)
        held = sorted([s for spans in base for s in spans] + [(a, b) for a, b, _, _ in other])
        if held and tokens:  # tokens inside other nodes are none of their own
            starts, most = [a for a, _ in held], np.maximum.accumulate([b for _, b in held])
            tokens = [(a, b) for a, b in tokens if not ((k := bisect_right(starts, a) - 1) >= 0 and most[k] >= b)]
        words = [m.span() for m in _TOKEN.finditer(text)] if tokens else []
        begins = [a for a, _ in words]
        self.spans: list[tuple[int, int]] = []
        self.kinds: list[int] = []
        self.known: list[bool] = []
        rows, self.values, places = [], [], []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        last: dict[str, int] = {}

        def tie(keys: set[str], k: int) -> None:
            for key in keys:
                if key in last and (last[key], k) not in self.skip[-2:]:
                    self.skip.append((last[key], k))
                last[key] = k

        nodes = [(a, b, kind, True, "") for kind, spans in enumerate(base) for a, b in spans] + [(a, b, kind, False, shared) for a, b, kind, shared in other] + [(a, b, 4, False, "") for a, b in tokens]
        for start, stop, kind, known, shared in sorted(nodes):
            k = len(rows)
            if kind < 4:
                shared = shared or (text[start:stop].lower() if kind < 2 else _digits(text[start:stop]))
                rows.append(np.zeros(N_FEATURES))
                self.values.append(shared)
                places.append(-2)
                self.spans.append((start, stop))
                tie({f"{kind}:{shared}"}, k)
            else:
                number = bisect_left(begins, start)
                before = [text[a:b] for a, b in words[max(0, number - 2) : number]]
                x, value = features(text[start:stop], before)
                rows.append(x)
                self.values.append(value)
                places.append(start)
                if x[5] or (x[12] and not _ASSIGNED.match(text[start:stop])):  # its name goes with it
                    start = words[number - 2 if before[-1] in _SIGNS and len(before) > 1 else number - 1][0]
                self.spans.append((start, stop))
                if k and self.kinds[-1] == 4 and places[k] - self.spans[k - 1][1] <= 1:
                    self.chain.append((k - 1, k))
                tie(_alike(value), k)
            self.kinds.append(kind)
            self.known.append(known)
        self.rows = np.array(rows).reshape(-1, N_FEATURES)


def beliefs(own: np.ndarray, ties: np.ndarray, strength: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log-potentials of nodes by label, with the messages of all ties: (from, to) pairs whose equal labels weigh e**strength more.

    Messages run both ways along every tie at once; on a tree enough rounds give the exact marginals (as logs, up to a constant).
    """
    if not len(ties):
        return own
    a, b, pull = np.concatenate([ties[:, 0], ties[:, 1]]), np.concatenate([ties[:, 1], ties[:, 0]]), np.expm1(np.concatenate([strength, strength]))[:, None]
    back = np.concatenate([np.arange(len(ties)) + len(ties), np.arange(len(ties))])
    sent = np.zeros((len(a), own.shape[1]))
    for _ in range(rounds):
        total = own.copy()
        np.add.at(total, b, sent)
        q = total[a] - sent[back]
        q = np.exp(q - q.max(axis=1, keepdims=True))
        new = np.log(q.sum(axis=1, keepdims=True) + pull * q)
        new -= new.mean(axis=1, keepdims=True)
        sent += TAKEN * (new - sent)
    total = own.copy()
    np.add.at(total, b, sent)
    return total


def labels_of(graph: Graph, weights: np.ndarray) -> np.ndarray:
    """The most likely kind of each node, -1 for none, by loopy message passing. A known node keeps its kind."""
    kinds, known = np.array(graph.kinds), np.array(graph.known)
    ties = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    tied = np.zeros(len(kinds), bool)
    tied[ties.ravel()] = True
    labels = np.array(sorted({4, *kinds[tied].tolist()}))  # kinds that no tie can spread need no place among the labels
    own = np.zeros((len(kinds), 1 + len(labels)))
    own[:, 1:] = -30.0
    place = 1 + np.minimum(np.searchsorted(labels, kinds), len(labels) - 1)
    each = np.arange(len(kinds))
    own[each, place] = np.where(kinds == 4, graph.rows @ weights[:N_FEATURES], np.where(known, 30.0, WRITTEN_ALIKE))
    total = beliefs(own, ties, np.repeat(weights[N_FEATURES:], [len(graph.chain), len(graph.skip)]))
    best = total.argmax(axis=1)
    return np.where(known, kinds, np.where(best > 0, labels[np.maximum(best - 1, 0)], -1))


def _examples(seed: int = 5):
    """Sentences with secrets and with harmless numbers, and where the secrets are."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: pick("abdehilmnorstu", int(rng.integers(2, 9)))
    number = lambda n: pick("0123456789", n)
    for _ in range(1500):
        parts, secrets = [], []
        for _ in range(int(rng.integers(3, 9))):
            parts += [word() for _ in range(int(rng.integers(1, 5)))]
            kind = int(rng.integers(0, 20))
            secret = pick("0123456789abcdef", int(rng.integers(16, 48))) if rng.random() < 0.5 else pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", int(rng.integers(16, 40)))
            cue = str(rng.choice(CUES))
            if kind == 0:
                parts.append(f"{cue}={secret}")
            elif kind == 1:
                parts += [cue, "=", f'"{secret}"']
            elif kind == 2:
                parts += [f"{cue}:", secret]
            elif kind == 3:
                secret = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) + pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16)
                parts.append(secret)
            elif kind == 4:  # hexadecimal digits alone are as often a build's or a version's
                if not re.search("[G-Zg-z]", secret):
                    parts.append(secret)
                    secret = ""
                else:
                    parts.append(secret)
            elif kind == 5 and secrets:  # said again
                secret = secrets[0]
                parts.append(secret)
            elif kind == 6:
                parts.append(f"{cue}={word()}{number(3)}")
                secret = parts[-1].split("=")[1]
            elif kind in (14, 15, 16):  # letters and marks alone
                secret = "-_.!"[int(rng.integers(0, 4))].join(word() + word() for _ in range(int(rng.integers(2, 5)))) if rng.random() < 0.5 else pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", int(rng.integers(10, 30)))
                parts += [[f"{cue}={secret}"], [f"{cue}:", secret], [cue, "=", f'"{secret}"']][kind - 14]
            elif kind in (17, 18):  # a word such as these in a sentence
                secret = ""
                parts += [cue if kind == 17 else f"{cue}:", word() if kind == 18 or rng.random() < 0.5 else word() + word()]
            else:
                secret = ""
                parts.append(str(rng.choice([number(2), f"{number(1)}.{number(1)}.", number(16), f"{number(4)}-{number(2)}-{number(2)}", f"{word()}{number(2)}", f"v{number(1)}.{number(2)}", f"https://{word()}.example.com/{number(4)}", f"{word()}.{number(2)}@{word()}.example.com", f"{number(2)}:{number(2)}", f"({number(3)})", f"{number(3)}-{number(4)}"])))
            if secret:
                secrets.append(secret)
        yield " ".join(parts), set(secrets)


@cache
def trained() -> tuple[float, ...]:
    """Weights by pseudo-likelihood: a logistic regression on features and the labels of tied tokens."""
    rows, wanted = [], []
    for text, secrets in _examples():
        graph = Graph(text)
        y = np.array([any(s in v or v in s for s in secrets) if len(v) >= 4 else False for v in graph.values], bool)
        ties = np.zeros((len(y), 2))
        for kind, pairs in enumerate((graph.chain, graph.skip)):
            for a, b in pairs:
                ties[a, kind] += 1 if y[b] else -1
                ties[b, kind] += 1 if y[a] else -1
        rows.append(np.concatenate([graph.rows, ties], axis=1))
        wanted.append(y)
    x, y = np.concatenate(rows), np.concatenate(wanted).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton, with a small prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    w[N_FEATURES:] = np.clip(w[N_FEATURES:], 0, 4)  # ties make labels agree
    return tuple(w.tolist())


def spans_of(text: str, weights: np.ndarray, base: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int]]]:
    """Spans by kind, as ``KINDS`` lists them: the patterns' own, and those that the field adds.

    A secret's span has its name with it, but no closing punctuation.
    """
    base = base_spans(text) if base is None else base
    graph = Graph(text, base)
    out = [*map(list, base), []]
    if not graph.spans or all(graph.known):
        return out
    for k, kind in enumerate(labels_of(graph, weights).tolist()):
        if kind < 0 or graph.known[k]:
            continue
        a, b = graph.spans[k]
        if kind == 4:
            while b > a and text[b - 1] in ".,;:!?)]}":
                b -= 1
            if out[4] and a < out[4][-1][1]:
                a = out[4][-1][1]
        if b > a:
            out[kind].append((a, b))
    return [sorted(x) for x in out]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=False) for a, b in own)


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first in the text counts, the longer if tied."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, kind) for kind, own in zip(KINDS, spans, strict=True) for a, b in own), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans: one row for each row of ``docs``.

    The first four counts and the hash are of the patterns' spans alone; ``spans`` has those that the field adds, too. Places are code points, ends exclusive. A null or empty text has no spans; rows that share a doc_id and null
    doc_ids make no difference. Only ``doc_id`` and ``text`` are read.
    """
    weights, key = trained(), docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                found = [spans_of(t, w, x) for t, x in zip(texts, base, strict=True)]
                counts = [*(pa.array([len(x[k]) for x in base], pa.int64()) for k in range(4)), pa.array([len(x[4]) for x in found], pa.int64())]
                sha = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, sha, pa.array([joined(x) for x in found], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; a null text stays null."""
    weights = trained()
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [None if t is None else masked(t, spans_of(t, w)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column("rest")], names=["text", "rest"])

    out = packed.mapInArrow(run, packed.schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
