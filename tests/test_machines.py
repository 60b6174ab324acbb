"""State machines on streams: any division into batches and any disorder within the watermark's delay give what a plain loop gives."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from patchloom.operators import jobs, state
from patchloom.streaming import machines

START = datetime(2020, 1, 1, tzinfo=timezone.utc)
MINUTE = 60_000


def ms(at):
    return round((at.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000)


def run(spark, tmp_path, batches, schema, make):
    """Results of a stream that gets the batches one by one, and its state rows after each."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session = spark.newSession()
    session.conf.set(machines.PROVIDER, machines.ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    held = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
    return spark.read.parquet(str(tmp_path / "out")).collect(), held


def plain_leases(events, lease, most=3):
    """What the jobs' leases do: a loop over events and ends of leases in the order of time."""
    out = []
    for job in sorted({e[0] for e in events}):
        status, attempts, generation, until = "queued", 0, 0, None
        for _, seq, kind, claimed, at in sorted((e for e in events if e[0] == job), key=lambda e: (e[4], e[1])) + [(job, None, None, None, None)]:
            if status == "processing" and (at is None or until <= ms(at)):
                attempts += 1
                status = "failed" if attempts >= most else "retry"
                out.append((job, until, None, "expire", True, status, attempts, generation))
            if at is None:
                continue
            ok = False
            if kind == "claim" and status in ("queued", "retry") and attempts < most:
                ok, status, generation, until = True, "processing", generation + 1, ms(at) + lease
            elif kind in ("renew", "complete") and status == "processing" and claimed == generation and until > ms(at):
                ok = True
                status, until = ("completed", until) if kind == "complete" else (status, ms(at) + lease)
            out.append((job, ms(at), seq, kind, ok, status, attempts, generation))
    return sorted(out, key=str)


def test_leases_run_out_without_events(spark, tmp_path):
    rnd = random.Random(5)
    events, at = [], START
    for seq in range(150):
        at += timedelta(seconds=rnd.randrange(1, 90))
        events.append((rnd.randrange(4), seq, rnd.choice(("claim", "renew", "complete", "claim")), rnd.randrange(1, 4), at))
    events.append((7, 900, "claim", 1, at))  # a job that is never heard of again
    order = sorted(events, key=lambda e: e[4] + timedelta(seconds=rnd.randrange(0, 250)))  # arrives up to four minutes late
    cuts = sorted(rnd.sample(range(1, len(order)), 3))
    batches = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)] + [[(None, None, None, None, at + timedelta(days=d))] for d in (9, 10)]
    schema = "job long, seq long, kind string, generation long, ts timestamp"
    got, _ = run(spark, tmp_path, batches, schema, lambda s: machines.folded(s, ["job"], "ts", machines.Leases(lease_ms=2 * MINUTE), "30 minutes"))
    mine = sorted(((r.job, ms(r.at), r.seq, r.kind, r.ok, r.status, r.attempts, r.generation) for r in got if r.job is not None), key=str)
    assert mine == plain_leases(events, 2 * MINUTE)
    assert any(r[0] == 7 and r[3] == "expire" for r in mine)


def test_untimed_leases_equal_the_batch_replay(spark, tmp_path):
    rnd = random.Random(6)
    events = [(rnd.randrange(5), k, rnd.choice(("claim", "renew", "expire", "complete")), rnd.randrange(1, 4), START + timedelta(seconds=50 * k)) for k in range(120)]
    schema = "id long, seq long, kind string, generation long, ts timestamp"
    batches = [events[:40], events[40:41], events[41:], [(None, None, None, None, START + timedelta(days=d)) for d in (9,)], [(None, None, None, None, START + timedelta(days=10))]]
    got, _ = run(spark, tmp_path, batches, schema, lambda s: machines.folded(s, ["id"], "ts", machines.Leases(timed=False), "1 hour"))
    want = jobs.replay_leases(spark.createDataFrame(events, schema).withColumn("ts", F.unix_timestamp("ts"))).collect()
    fields = ("id", "seq", "kind", "ok", "status", "attempts", "generation")
    assert sorted(tuple(r[c] for c in fields) for r in got if r.id is not None) == sorted(tuple(r[c] for c in fields) for r in want)


def test_deliveries_conflict_and_are_forgotten(spark, tmp_path):
    rnd = random.Random(7)
    events = [(f"d{rnd.randrange(12)}", k, rnd.choice("ab"), START + timedelta(minutes=k)) for k in range(90)] + [("late", 500, None, START), ("late", 501, "a", START + timedelta(minutes=1))]
    order = sorted(events, key=lambda e: e[3] + timedelta(minutes=rnd.randrange(0, 15)))
    batches = [order[:30], order[30:60], order[60:], *[[(None, None, None, START + timedelta(days=d))] for d in (2, 4, 6)]]
    schema = "id string, seq long, payload string, ts timestamp"
    keep = 40 * MINUTE
    got, held = run(spark, tmp_path, batches, schema, lambda s: machines.folded(s, ["id"], "ts", machines.Deliveries(keep), "30 minutes"))
    want, first = [], {}
    for name, seq, payload, at in sorted(events, key=lambda e: (e[3], e[1])):
        if name in first and first[name][1] <= ms(at):
            del first[name]
        if name not in first or first[name][0] is None:
            first[name] = (payload, ms(at) + keep)
            want.append((name, seq, "accepted"))
        else:
            want.append((name, seq, "duplicate" if payload == first[name][0] else "conflict"))
    assert sorted((r.id, r.seq, r.outcome) for r in got if r.id is not None) == sorted(want)
    assert held[-1] < held[0], "forgotten deliveries hold no state"


def test_unlimited_deliveries_equal_the_batch_form(spark, tmp_path):
    events = [(f"d{k * k % 7}", k, "ab"[k % 3 == 0], START + timedelta(minutes=k)) for k in range(40)]
    schema = "id string, seq long, payload string, ts timestamp"
    closing = [[(None, None, None, START + timedelta(days=d))] for d in (2, 4)]
    got, _ = run(spark, tmp_path, [events[:10], events[10:], *closing], schema, lambda s: machines.folded(s, ["id"], "ts", machines.Deliveries(), "1 hour"))
    want = state.deliveries(spark.createDataFrame(events, schema), "id", ["payload"], ["seq"]).collect()
    assert sorted((r.id, r.seq, r.outcome) for r in got if r.id is not None) == sorted((r.id, r.seq, r.outcome) for r in want)


def test_journal_and_idle_keys(spark, tmp_path):
    events = [("r", "o", 1, "confirmed", "h", 5), ("r", "o", 2, "sent", "h", None), ("r", "o", 3, "sent", "x", None), ("r", "o", 4, "confirmed", "x", 5), ("r", "o", 5, "confirmed", "h", 5), ("r", "o", 6, "confirmed", "h", 6), ("q", "o", 1, "sent", "h", 9), ("q", "o", 2, "confirmed", "h", 8)]
    rows = [(*e, START + timedelta(minutes=e[2])) for e in events]
    schema = "run_id string, operation string, seq long, kind string, hash string, remote_id long, ts timestamp"
    closing = [[(None, None, None, None, None, None, START + timedelta(days=d))] for d in (2, 4, 6)]
    got, held = run(spark, tmp_path, [rows, *closing], schema, lambda s: machines.folded(s, ["run_id", "operation"], "ts", machines.Journal(), "1 hour", idle_ms=60 * MINUTE))
    want = jobs.replay_journal(spark.createDataFrame(events, "run_id string, operation string, seq long, kind string, hash string, remote_id long")).collect()
    fields = ("run_id", "seq", "kind", "ok", "state", "remote_id")
    assert sorted((tuple(r[c] for c in fields) for r in got if r.run_id), key=str) == sorted((tuple(r[c] for c in fields) for r in want), key=str)


def test_fold_needs_its_state_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        machines.folded(spark.readStream.format("rate").load().select(F.lit(1).alias("id"), F.lit(1).alias("seq"), F.lit("a").alias("payload"), "timestamp"), ["id"], "timestamp", machines.Deliveries())


def test_folds_over_a_table(spark):
    from patchloom.operators import folds

    rnd = random.Random(8)
    events = [(rnd.choice((None, "a", "b")), "x", k, rnd.choice(("sent", "confirmed")), rnd.choice("hg"), rnd.choice((None, 1, 2))) for k in range(400)]
    schema = "run_id string, operation string, seq long, kind string, hash string, remote_id long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key's rows span batches
    try:
        got = folds.in_order(spark.createDataFrame(events, schema).repartition(5), ["run_id", "operation"], ["seq"], folds.Journal()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for run in (None, "a", "b"):
        state = folds.Journal().empty()
        for _, _, *event in sorted((e for e in events if e[0] == run), key=lambda e: e[2]):
            state, out = folds.Journal().step(state, 0, tuple(event))
            want += [(run, "x", *o) for o in out]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert folds.in_order(spark.createDataFrame([], schema), ["run_id"], ["seq"], folds.Journal()).count() == 0


def test_budgets_of_one_long_run(spark):
    calls = spark.range(50_000).select(F.lit("r").alias("run"), F.col("id").alias("n"), (1 + F.col("id") % 7).cast("int").alias("size")).repartition(6)
    got = state.admit_by_budget(calls, "run", "n", "size", 1000, 3000).filter("admitted").agg(F.count("*"), F.sum("size"), F.max("n")).first()
    used, n, last = 0, 0, None
    for k in range(50_000):
        if n < 1000 and used + 1 + k % 7 <= 3000:
            used, n, last = used + 1 + k % 7, n + 1, k
    assert tuple(got) == (n, used, last)
