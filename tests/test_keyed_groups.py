"""Streams with many keys: Python is called and state is kept per group of keys, and static sides are worked out once."""

import random

from pyspark.sql import functions as F

from runlens.plans import telemetry as tel
from runlens.session import work_path
from runlens.streaming import state
from runlens.workload import q_streaming as qs

BIG = 2**60 + 1  # lost if a column of keys became floats


def feed(spark, rows, schema, files=3):
    path = work_path(spark, "rows")
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream):
    """What the stream wrote, and how many rows of state it left."""
    spark = stream.sparkSession
    path, checkpoint = work_path(spark, "out"), work_path(spark, "out-checkpoint")
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), spark.read.format("statestore").load(checkpoint).count()


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def test_usage_of_many_leases_in_few_groups(spark, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 7)
    r = random.Random(3)
    leases = [None, BIG, BIG + 1, *range(60)]
    rows = [(r.choice(leases), i, 1_000 * i - r.choice([0, 0, 0, 50_000]), r.choice([None, 0.5, r.random() * 4])) for i in range(900)]
    schema = "lease_id long, ord long, t_ms long, cores double"
    rows = [x for k in range(3) for x in rows[300 * k : 300 * k + 300]]
    out, left = run(state.live_usage(feed(spark, [rows[300 * (i % 3) + i // 3] for i in range(900)], schema)))
    assert left <= 8
    got = out.groupBy("lease_id").agg(F.max_by(F.struct("peak", "mean", "samples", "span_ms"), "samples").alias("x")).select("lease_id", "x.*")
    want = {}
    for lease, _, t, c in rows:
        if c is None:
            continue
        p, area, span, n, lt, lc = want.get(lease, (c, 0.0, 0, 0, t, c))
        want[lease] = (max(p, c), area, span, n + 1, lt, lc) if t <= lt else (max(p, c), area + lc * (t - lt), span + t - lt, n + 1, t, c)
    assert rows_of(got, "lease_id", "peak", "mean", "samples", "span_ms") == sorted(repr((k, p, a / s if s else lc, n, s)) for k, (p, a, s, n, _, lc) in want.items())


def test_waits_of_many_tickets_in_few_groups(spark, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 5)
    r = random.Random(4)
    rows = [(r.choice([None, BIG, BIG + 1, *range(40)]), i, 5_000 * i, r.choice(["cpu", "not-head"]), r.choice([None, "over-budget"]), r.random() < 0.1) for i in range(600)]
    schema = "ticket long, ord long, t_ms long, reason string, cause string, ended boolean"
    out, left = run(state.wait_since(feed(spark, [rows[200 * (i % 3) + i // 3] for i in range(600)], schema)))
    assert left <= 6
    want, known = [], {}
    for ticket, i, t, reason, cause, ended in rows:
        since = None if ended else known[ticket][1] if known.get(ticket, (None, None))[0] == (reason, cause) else t
        known[ticket] = (None if ended else (reason, cause), since)
        if not ended:
            want.append((ticket, i, reason, since))
    assert rows_of(out, "ticket", "ord", "reason", "since_ms") == sorted(map(repr, want))


def _seen(spark, sf, monkeypatch, name):
    """The rows that a machine is given, and its output over all leases in few groups."""
    plain, given = getattr(state, name), []
    monkeypatch.setattr(state, name, lambda rows, *a, **k: given.append(rows) or plain(rows, *a, **k))
    monkeypatch.setattr(state, "BUCKETS", 9)
    monkeypatch.setattr(qs, "BATCH_ROWS", 400)
    return given


def test_silence_joins_leases_that_are_worked_out_once(spark, sf, monkeypatch):
    given = _seen(spark, sf, monkeypatch, "silence_flags")
    got = qs.stream_lease_silence(spark, sf)
    assert "Aggregate" not in given[0]._jdf.queryExecution().analyzed().toString()
    cols = ["lease_id", "ord", "silent_ms", "idle_ms", "idle", "silent", "hung"]
    heartbeats, leases = qs.flat(spark, sf, "heartbeats"), qs.flat(spark, sf, "leases")
    want = tel.silence(heartbeats, leases, max_gap_ms=qs.qt.GAP, below_fraction=0.6, hung_cores=0.4, hung_after_ms=qs.qt.DAY, idle_after_ms=qs.qt.DAY)
    assert rows_of(got, *cols) == rows_of(want, *cols) and got.count() > 800


def test_overruns_join_leases_that_are_worked_out_once(spark, sf, monkeypatch):
    given = _seen(spark, sf, monkeypatch, "overrun_alerts")
    got = qs.stream_overrun_alerts(spark, sf)
    assert "Aggregate" not in given[0]._jdf.queryExecution().analyzed().toString()
    want = tel.overruns(qs.flat(spark, sf, "heartbeats"), qs.flat(spark, sf, "leases"), max_gap_ms=qs.qt.GAP, min_ms=qs.qt.MIN_MS)
    assert rows_of(got, "lease_id", "since_ms", "alert_ms") == rows_of(want, "lease_id", "since_ms", "alert_ms")
