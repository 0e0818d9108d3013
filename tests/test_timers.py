"""Streams with timers: lease expiry against hand-worked cases, rows out of order over several files, and the state that is left."""

from runlens.streaming import timers

S = "cluster long, ticket_id long, t_ms long, state string, lease_until_ms long, requeues long, cancel_requested boolean"
T0 = 1_700_000_000_000


def feed(spark, tmp_path, files, schema):
    """A stream that takes one file in a micro-batch."""
    path = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def lease(ticket, at, state="claimed", until=None, requeues=0, cancel=False, cluster=1):
    return (cluster, ticket, T0 + at, state, None if until is None else T0 + until, requeues, cancel)


def tick(at, cluster=1):
    return (cluster, None, T0 + at, None, None, None, None)


def verdicts(spark, tmp_path, files, delay="1 hour"):
    far = (1, None, T0 + 10**9, "mark", None, None, None)
    s = feed(spark, tmp_path, [*files, [far]], S)
    stream = timers.lease_verdicts(s.filter("state IS NOT NULL"), s.filter("state IS NULL"), buckets=3, delay=delay)
    out, checkpoint = timers.run_stateful(stream, "leases")
    left = timers.state_rows(spark, checkpoint, "pending", "leases", "due", "overdue", "soon")
    got = {(r.ticket_id, r.verdict): (r.t_ms - T0, r.not_before_ms and r.not_before_ms - T0, r.lease_until_ms - T0) for r in out.collect()}
    return got, left


def test_deadlines_renewals_and_ends(spark, tmp_path):
    minute = 60_000
    files = [
        [tick(0), lease(1, 10, until=2 * minute), lease(2, 10, until=2 * minute), lease(3, 10, "running", until=2 * minute), lease(4, 10, until=90_000, requeues=5), lease(5, 10, until=90_000, cancel=True)],
        # ticks every half minute, in the wrong order and in other files than the claims
        [tick(30_000 * k) for k in range(9, 4, -1)], [tick(30_000 * k) for k in range(1, 5)] + [lease(2, 100_000, until=4 * minute), lease(6, 50, "running", until=minute)],
        [lease(2, 130_000, "finished"), lease(6, 200_000, "finished"), lease(3, 280_000, "finished")]]
    got, left = verdicts(spark, tmp_path, files)
    assert got == {
        (1, "queued"): (150_000, 155_000, 120_000),  # the tick at 120 s itself finds it in time
        (2, "kept"): (130_000, None, 240_000), (6, "kept"): (200_000, None, 60_000), (3, "kept"): (280_000, None, 120_000),
        (4, "lost"): (120_000, None, 90_000), (5, "cancelled"): (120_000, None, 90_000)}
    assert left == 0


def test_amnesty_moves_every_timer(spark, tmp_path):
    files = [[tick(0), lease(1, 10, until=20_000), lease(2, 10, until=400_000), lease(3, 10, "running", until=20_000)], [tick(61_001), tick(121_000), tick(181_001), tick(181_002)], [tick(0, 2), lease(7, 5, until=10_000, cluster=2), tick(60_000, 2)]]
    got, left = verdicts(spark, tmp_path, files + [[lease(2, 200_000, "finished"), lease(3, 200_000, "lost")]])
    # after the gap of 61 s ticket 1 has until 181.001 s, which the next gap of 60.001 s moves again; 60 s are no gap
    assert got == {(2, "kept"): (200_000, None, 400_000), (3, "kept"): (200_000, None, 301_001), (7, "queued"): (60_000, 65_000, 10_000)} and left > 0
    got, left = verdicts(spark, tmp_path / "b", files + [[tick(181_001 + 60_000 * k) for k in range(1, 4)], [lease(2, 200_000, "finished"), lease(3, 200_000, "lost")]])
    assert got[1, "queued"] == (361_001, 366_001, 301_001) and left == 0


def test_a_running_lease_is_lost_two_hours_after_its_last_sign(spark, tmp_path):
    hours = 7_200_000 - 120_000
    files = [[tick(0), lease(1, 10, "running", until=50_000)], [tick(60_000 * k) for k in range(1, 121)]]
    got, left = verdicts(spark, tmp_path, files, delay="5 hours")
    assert got == {(1, "lost"): (60_000 * (-(-(50_000 + hours + 1) // 60_000)), None, 50_000)} and left == 0


def test_a_lease_that_is_over_when_it_arrives(spark, tmp_path):
    got, left = verdicts(spark, tmp_path, [[lease(1, 1000, until=-5000), tick(1000), lease(2, 1001, until=1001), lease(3, 1001, until=1002)], [tick(1002)], [lease(3, 1003, "finished")]])
    assert got == {(1, "queued"): (1002, 6002, -5000), (2, "queued"): (1002, 6002, 1001), (3, "kept"): (1003, None, 1002)} and left == 0


def test_cpu_of_finished_runs_equals_the_batch_form(spark, tmp_path):
    from runlens.plans import telemetry as tel
    from runlens.streaming import jobs

    R, E = "lease_id long, ord long, t_ms long, cores double", "lease_id long, started_ms long, ended_ms long"
    minute = 60_000
    readings = [(k % 3, k, T0 + minute * (k // 3) - (200_000 if k % 7 == 0 else 0), None if k % 5 == 0 else float("inf") if k == 8 else k / 4) for k in range(60)]
    ends = [(0, T0 - 5_000, T0 + 25 * minute), (1, T0 + 1_000, T0 + 10 * minute), (9, T0, T0 + minute)]  # lease 2 never ends, lease 9 has no reading
    files = [[r for r in readings if r[1] % 4 in (0, 3)], [r for r in readings if r[1] % 4 == 1], [r for r in readings if r[1] % 4 == 2], [(-1, 0, T0 + 10**9, 0.0)]]
    (tmp_path / "r").mkdir()
    (tmp_path / "e").mkdir()
    r = feed(spark, tmp_path / "r", files, R)
    e = feed(spark, tmp_path / "e", [ends[1:2], [(7, T0, T0)], [(8, T0, T0)], [*ends[:1], *ends[2:]], [(-2, 0, T0 + 10**9)]], E)  # one end comes after all readings
    got = jobs.run_to_table(jobs.finished_cpu(r, e, "1 hour", "1 hour", "1 hour"), "cpu")
    batch = spark.createDataFrame([x for f in files for x in f], R)
    want = tel.integrated_cpu(tel.usage_fold(batch), spark.createDataFrame(ends, E))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 2


def test_no_progress_over_files_and_a_process_that_returns(spark, tmp_path):
    from runlens.plans import telemetry as tel

    M = "lease_id long, t_ms long, output_bytes long, identity string, cpu_sec double"
    minute = 60_000
    snaps = {0: "ab", 1: "ab", 2: "abc", 3: "abc", 4: "ab", 5: "abc", 6: "abc", 7: "abc"}  # c leaves and returns
    rows = [(1, T0 + k * minute, 100 if k < 7 else 101, i, 5.0) for k, s in snaps.items() for i in s]
    rows += [(2, T0 + k * minute, 0, "x", 0.04 * k if k < 5 else 0.16 + k) for k in range(8)]
    (tmp_path / "m").mkdir()
    s = feed(spark, tmp_path / "m", [rows[i::3] for i in range(3)] + [[(1, T0 + 10**9, None, None, None)]], M)
    out, checkpoint = timers.run_stateful(timers.no_progress(s, delay="1 hour"), "no-progress")
    got = sorted((r.lease_id, r.t_ms, r.interval_cores and round(r.interval_cores, 9), r.idle_ms) for r in out.collect())
    batch = spark.createDataFrame(rows, M)
    want = tel.no_progress(batch.select("lease_id", "t_ms", "output_bytes").distinct(), batch.select("lease_id", "t_ms", "identity", "cpu_sec"))
    assert got == sorted((r.lease_id, r.t_ms, r.interval_cores and round(r.interval_cores, 9), r.idle_ms) for r in want.collect())
    assert [i // minute for le, _, _, i in got if le == 1] == [0, 1, 0, 1, 0, 0, 1, 0] and [i // minute for le, _, _, i in got if le == 2] == [0, 1, 2, 3, 4, 0, 0, 0]
    assert timers.state_rows(spark, checkpoint, "pending", "procs", "last") == 0  # forgotten after a day of silence


PINGS = "runner string, ord long, t_ms long, ok boolean"


def test_a_silent_runner_goes_down_in_a_batch_without_its_rows(spark, tmp_path):
    cfg = spark.createDataFrame([("b", True, True), ("c", False, False)], "runner string, offline boolean, available boolean")
    files = [
        [("a", 1, T0, True), ("a", 2, T0 + 1000, False), ("b", 3, T0, False), ("c", 4, T0, True)],
        [("c", 5, T0 + 200_000, True)],  # moves the watermark past a's deadline
        [("c", 6, T0 + 400_000, False), ("c", 7, T0 + 900_000, True), ("a", 8, T0 + 950_000, True), ("d", 9, T0 + 1_000_000, True)]]
    s = feed(spark, tmp_path, files, PINGS)
    stream = timers.runner_states(s, cfg, down_after_ms=100_000, lost_after_ms=600_000, delay="0 seconds")
    batches = {}
    with timers.rocksdb_state(spark):
        q = stream.writeStream.foreachBatch(lambda df, i: batches.setdefault(i, []).extend((r.runner, r.t_ms - T0, r.state) for r in df.collect())).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    down = next(i for i, rows in batches.items() if ("a", 101_000, "down") in rows)
    assert down in (1, 2) and ("c", 0, "off-schedule") in batches[0]
    assert sorted(x for rows in batches.values() for x in rows) == [
        ("a", 0, "up"), ("a", 1000, "unreachable"), ("a", 101_000, "down"), ("a", 601_000, "lost"), ("a", 950_000, "up"), ("b", 0, "offline"),
        ("c", 0, "off-schedule"), ("c", 400_000, "unreachable"), ("c", 500_000, "down"), ("c", 900_000, "off-schedule"), ("d", 1_000_000, "up")]


def test_by_the_wall_clock_a_runner_goes_down_without_any_ping(spark, tmp_path):
    import time

    now = int(time.time() * 1000)
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, now, False)], PINGS).coalesce(1).write.parquet(path)
    cfg = spark.createDataFrame([], "runner string, offline boolean, available boolean")
    s = spark.readStream.schema(PINGS).parquet(path)
    with timers.rocksdb_state(spark):
        q = timers.runner_states(s, cfg, down_after_ms=1, lost_after_ms=20_000, clock="processing").writeStream.format("memory").queryName("wall").option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("wall").count() < 3:
            time.sleep(1)
        got = [tuple(r) for r in spark.table("wall").orderBy("t_ms").select("t_ms", "state").collect()]
    finally:
        q.stop()
    assert got == [(now, "unreachable"), (now + 1, "down"), (now + 20_000, "lost")]
