"""State machines on streams: one fold a key, in the order of event time, with deadlines that need no event.

``folded`` runs a fold with ``transformWithState``. Events wait until the watermark has passed them and are then taken in the order of
(time, ``seq``), so neither the division into batches nor late arrival within the watermark's delay changes what comes out. Where
a state has a deadline (a lease that runs out, a time to live) and no earlier event is waiting, the deadline takes effect as the
watermark passes it, also for a key that gets no event any more. A key has one timer: its first waiting event or its deadline.
State needs the RocksDB provider, which keeps it off the heap; a key's state is its fold's few fields and what is waiting.

A fold never reads a clock. An event from behind the watermark is dropped by Spark before it gets here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from patchloom.operators.folds import Budget, Deliveries, Fold, Journal, Leases, RunTimes, moment

__all__ = ["Budget", "Deliveries", "Fold", "Journal", "Leases", "RunTimes", "drained", "folded", "stale_runs"]

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Ordered(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then gives them and the deadlines to the fold by their times."""

    def __init__(self, fold: Fold, key: list[str], names: list[str], idle_ms: int | None):
        self.fold, self.names, self.idle_ms = fold, names, idle_ms
        self.waits, self.knows = StructType.fromDDL(f"at long, {fold.events}"), StructType.fromDDL(f"last long, {fold.state}")  # DDL is read on the driver only
        self.row = [*key, "at", *StructType.fromDDL(fold.result).names]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.known = handle.getValueState("known", self.knows)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self.waiting.appendList([tuple(r[c] for c in ("at", *self.names)) for r in rows])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _due(self, state: tuple | None, last: int | None) -> int | None:
        times = [] if state is None else [self.fold.deadline(state), None if self.idle_ms is None or last is None else last + self.idle_ms]
        return min((t for t in times if t is not None), default=None)

    def _advance(self, key: tuple, watermark: int) -> Iterator[Row]:
        held = self.known.get() if self.known.exists() else None
        last, state = (held[0], tuple(held[1:])) if held is not None else (None, None)
        events = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1]))
        out: list[tuple] = []
        taken = 0
        while True:
            due = self._due(state, last)
            at = events[taken][0] if taken < len(events) else None
            if due is not None and due <= watermark and (at is None or due <= at):
                forget = self.fold.deadline(state) != due
                state, rows = (None, []) if forget else self.fold.lapse(state, due)
                out += [(due, *r) for r in rows]
                if state is not None and self._due(state, last) == due:
                    raise RuntimeError("a deadline must move or end when it has passed")
            elif at is not None and at <= watermark:
                state, rows = self.fold.step(self.fold.empty() if state is None else state, at, events[taken][1:])
                last, taken = at, taken + 1
                out += [(at, *r) for r in rows]
            else:
                break
        if taken:
            if taken < len(events):
                self.waiting.put(events[taken:])
            else:
                self.waiting.clear()
        if state is not None:
            self.known.update((last, *state))
        elif held is not None:
            self.known.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        following = min((t for t in (events[taken][0] if taken < len(events) else None, self._due(state, last)) if t is not None), default=None)
        if following is not None:
            self.handle.registerTimer(following)
        one = Row(*self.row)
        return iter([one(*key, moment(x[0]), *x[1:]) for x in out])

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: list[str], ts: str, fold: Fold, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """``key``, at (the event's time or the deadline's) and the fold's results, for a stream ``rows`` with the fold's event columns.

    ``seq`` orders events of the same time. ``idle_ms`` after its last event a key is forgotten, whatever its state. Rows with a
    null key share one key; a null time is never due, so such rows are left out. Needs the RocksDB state store.
    """
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    wanted = StructType.fromDDL(fold.events)
    use = rows.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(*key, ts, F.unix_millis(ts).alias("at"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return use.groupBy(*key).transformWithState(_Ordered(fold, key, wanted.names, idle_ms), StructType.fromDDL(f"{types}, at timestamp, {fold.result}"), "Append", "EventTime")


def stale_runs(runs: DataFrame, revisions: DataFrame | None, key: list[str], most: str, late: str = "1 hour", periods: int = 1) -> DataFrame:
    """id and ``stale`` of each run, once: did a newer revision of its ``key`` begin before the run was done?

    ``runs`` (id, ``key``, ts, done) last ``most`` ("30 days") at the longest, and ``revisions`` are (id, ``key``, ts), the newer by
    (ts, id). A run with a null in its key is never stale; one that is delivered again comes out once.

    Without ``revisions`` each run is a revision too. Then rows are grouped by key in windows that begin every ``periods`` times
    ``most`` and overlap by ``most``: a run's window is the one that it begins in before the overlap, which shows all that may
    overtake it. One row of state holds a key's runs of a window until the watermark has passed that; more ``periods`` make fewer
    rows of state, which are held for longer. With ``revisions`` the two streams are joined over the interval, and either side's
    rows are held until the watermarks show that no partner can come.
    """
    if revisions is None:
        return _overtaken(runs, key, most, late, periods)
    a = runs.select(F.col("id").alias("run_id"), *[F.col(c).alias(f"run_{c}") for c in key], F.col("ts").alias("began"), "done").withWatermark("began", late)
    b = revisions.select(F.col("id").alias("revision_id"), *key, F.col("ts").alias("revised")).withWatermark("revised", late)
    same = F.lit(True)
    for c in key:
        same = same & (F.col(f"run_{c}") == F.col(c))
    newer = (F.col("revised") > F.col("began")) | ((F.col("revised") == F.col("began")) & (F.col("revision_id") > F.col("run_id")))
    inside = (F.col("revised") >= F.col("began")) & (F.col("revised") <= F.col("began") + F.expr(f"INTERVAL {most}")) & (F.col("revised") < F.col("done"))
    both = a.join(b, same & newer & inside, "leftOuter").select("run_id", "began", F.col("revision_id").isNotNull().alias("stale"))
    return both.dropDuplicatesWithinWatermark(["run_id"]).select(F.col("run_id").alias("id"), "stale")


def _overtaken(runs: DataFrame, key: list[str], most: str, late: str, periods: int) -> DataFrame:
    """``stale_runs`` of one stream: the next run of a key stands next in its window, or first in the window's overlap."""
    n, unit = int(most.split()[0]), most.split()[1]
    apart = F.lit(False)  # as in a join, a key with a null part equals none
    for c in key:
        apart = apart | F.col(c).isNull()
    rows = runs.withWatermark("ts", late).select("id", *key, "ts", "done", F.when(apart, F.col("id")).alias("__apart"))
    first = F.col("ts") < F.col("__w.start") + F.expr(f"INTERVAL {periods * n} {unit}")
    shown = rows.withColumn("__w", F.window("ts", f"{(periods + 1) * n} {unit}", f"{periods * n} {unit}"))
    held = shown.groupBy("__w", *key, "__apart").agg(F.array_sort(F.collect_list(F.when(first, F.struct("ts", "id", "done")))).alias("__runs"), F.min(F.when(~first, F.col("ts"))).alias("__later"))
    pairs = F.arrays_zip(F.col("__runs").alias("run"), F.slice("__runs", F.lit(2), F.greatest(F.size("__runs"), F.lit(1))).alias("following"))
    each = held.select("__later", F.explode(pairs).alias("p")).filter(~F.col("p.run").eqNullSafe(F.col("p.following")))
    revised = F.coalesce("p.following.ts", "__later")
    stale = (revised < F.col("p.run.done")) & (revised <= F.col("p.run.ts") + F.expr(f"INTERVAL {most}"))
    return each.select("p.run.id", F.coalesce(stale, F.lit(False)).alias("stale"))


def drained(stream: DataFrame, folder: str, schema: str | None = None) -> DataFrame:
    """All rows that a stream gives until its source is at its end, written below ``folder`` and read again."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(f"{folder}/rows")
