"""What one key's events do to its state, one after the other: the folds that replays and streams share.

``in_order`` runs a fold over a table: rows are dealt by key and sorted there, and a task goes through them with one state at a time, so
a key's history is never gathered in one row, however long it is. Streams run the same folds in ``streaming.machines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: How often a job may be tried; how long a lease lasts; states in which a run has ended.
MOST_ATTEMPTS, LEASE_SECONDS = 3, 120
TERMINAL = ("completed", "failed", "stale", "skipped")


class Fold:
    """What one key's events do to its state. Times are milliseconds since 1970."""

    #: Columns of an event beside key and time, of the state, and of a result beside key and time.
    events, state, result = "", "", ""

    def empty(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        """The state after an event, and result rows."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When the state changes without an event; None: never."""
        return None

    def lapse(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        """The state after its deadline, None to forget the key, and result rows."""
        return None, []


class Leases(Fold):
    """A job's leases: claim, renew, complete and expire, as ``operators.jobs.replay_leases`` has them.

    With ``timed`` a lease that runs out needs no ``expire`` event: at its end an attempt is counted and a row without ``seq`` comes
    out. ``keep_ms`` after its end a completed or failed job is forgotten.
    """

    events, state = "seq long, kind string, generation long", "status string, attempts int, generation long, until long"
    result = "seq long, kind string, ok boolean, status string, attempts int, generation long"

    def __init__(self, timed: bool = True, lease_ms: int = 1000 * LEASE_SECONDS, most: int = MOST_ATTEMPTS, keep_ms: int | None = None):
        self.timed, self.lease_ms, self.most, self.keep_ms = timed, lease_ms, most, keep_ms

    def empty(self) -> tuple:
        return "queued", 0, 0, 0

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        (status, attempts, generation, until), (seq, kind, claimed) = state, event
        ok = False
        if kind == "claim":
            ok = status in ("queued", "retry") and attempts < self.most
            if ok:
                status, generation, until = "processing", generation + 1, at + self.lease_ms
        elif kind == "expire":
            ok = status == "processing" and until <= at
            if ok:
                status, attempts, until = self._over(attempts, at)
        elif kind in ("renew", "complete"):
            ok = status == "processing" and claimed == generation and until > at
            if ok:
                status, until = ("completed", at) if kind == "complete" else (status, at + self.lease_ms)
        return (status, attempts, generation, until), [(seq, kind, ok, status, attempts, generation)]

    def _over(self, attempts: int, at: int) -> tuple[str, int, int]:
        return "failed" if attempts + 1 >= self.most else "retry", attempts + 1, at

    def deadline(self, state: tuple) -> int | None:
        status, _, _, until = state
        if status == "processing":
            return until if self.timed else None
        return until + self.keep_ms if self.keep_ms is not None and status in ("completed", "failed") else None

    def lapse(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        status, attempts, generation, until = state
        if status != "processing":
            return None, []
        status, attempts, until = self._over(attempts, at)
        return (status, attempts, generation, until), [(None, "expire", True, status, attempts, generation)]


class Deliveries(Fold):
    """A delivery's outcomes: accepted, then duplicate or, if its payload differs, conflict. ``keep_ms`` after the first it is forgotten."""

    events, state, result = "seq long, payload string", "payload string, until long", "seq long, outcome string"

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def empty(self) -> tuple:
        return None, None

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        (first, until), (seq, payload) = state, event
        if first is None:
            return (payload, None if self.keep_ms is None else at + self.keep_ms), [(seq, "accepted")]
        return (first, until), [(seq, "duplicate" if payload == first else "conflict")]

    def deadline(self, state: tuple) -> int | None:
        return state[1]


class Budget(Fold):
    """Calls of a run, admitted while number and total size stay in the budget; a refused call charges nothing."""

    events, state, result = "seq long, size long", "calls int, used long", "seq long, size long, admitted boolean"

    def __init__(self, most_calls: int, most_size: int):
        self.most_calls, self.most_size = most_calls, most_size

    def empty(self) -> tuple:
        return 0, 0

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        (calls, used), (seq, size) = state, event
        fits = calls < self.most_calls and used + size <= self.most_size
        return (calls + fits, used + (size if fits else 0)), [(seq, size, fits)]


class RunTimes(Fold):
    """A run's status and times after each of its events: the first start stays, the last end counts."""

    events, state, result = "seq long, status string", "status string, started long, completed long", "seq long, status string, started_at timestamp, completed_at timestamp"

    def empty(self) -> tuple:
        return None, None, None

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        (_, started, completed), (seq, status) = state, event
        started = at if status == "in_progress" and started is None else started
        completed = at if status in TERMINAL else completed
        return (status, started, completed), [(seq, status, moment(started), moment(completed))]


class Journal(Fold):
    """A publication's state after each event, as ``operators.jobs.replay_journal`` has it."""

    events, state, result = "seq long, kind string, hash string, remote_id long", "hash string, state string, remote_id long", "seq long, kind string, ok boolean, state string, remote_id long"

    def empty(self) -> tuple:
        return None, "none", None

    def step(self, state: tuple, at: int, event: tuple) -> tuple[tuple, list[tuple]]:
        (known, now, remote), (seq, kind, hashed, told) = state, event
        sent = kind == "sent" and known is None
        confirmed = kind == "confirmed" and known is not None and known == hashed and told is not None and remote in (None, told)
        if sent:
            known, now, remote = hashed, "sent", remote if told is None else told
        elif confirmed:
            now, remote = "confirmed", told
        return (known, now, remote), [(seq, kind, sent or confirmed, now, remote)]


def moment(ms: int | None) -> Any:
    from datetime import datetime, timedelta, timezone

    return None if ms is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


def in_order(rows: DataFrame, key: list[str], order: list[str], fold: Fold, at: str | None = None) -> DataFrame:
    """``key`` and the fold's results for ``rows``, each key's in the order of ``order``; ``at`` is a column of whole numbers, in the fold's unit of time.

    Deadlines don't lapse by themselves here: folds that need them take them from events. Null keys are one key; rows that tie in ``order``
    come in the order of the fold's event columns. An empty table gives no rows.
    """
    wanted, given = StructType.fromDDL(fold.events), StructType.fromDDL(fold.result)
    names = [f"k{n}" for n in range(len(key))]
    use = rows.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], (F.col(at) if at else F.lit(0)).cast("long").alias("at"), *[F.col(f.name).cast(f.dataType).alias(f"e_{f.name}") for f in wanted], *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)])
    ties = [f"e_{f.name}" for f in wanted]
    dealt = use.repartition(*names).sortWithinPartitions(*names, *[f"o{n}" for n in range(len(order))], *ties).select(*names, "at", *ties)
    kinds = [(n, to_arrow_type(rows.schema[c].dataType)) for c, n in zip(key, names, strict=True)] + [(f.name, to_arrow_type(f.dataType)) for f in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, when, event = row[: len(names)], row[len(names)], row[len(names) + 1 :]
                if own != last or state is None:
                    last, state = own, fold.empty()
                state, found = fold.step(state, when, event)
                out += [(*own, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    types = ", ".join([f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in zip(key, names, strict=True)] + [f"{f.name} {f.dataType.simpleString()}" for f in given])
    return dealt.mapInArrow(run, types).select(*[F.col(n).alias(c) for c, n in zip(key, names, strict=True)], *given.names)
