"""Streaming forms run over the events file to completion; the oracles are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.session import cut_lineage, work_path
from runlens.plans import estimates
from runlens.sources.sinks import bypass_summaries
from runlens.streaming import estimators, jobs, replication, state, timers
from runlens.workload import q_estimates as qe
from runlens.workload import q_inventory as qi
from runlens.workload import q_queue as qq
from runlens.workload import q_telemetry as qt
from runlens.workload.registry import ORACLES, query
from runlens.workload.views import VIEWS, Spark, flat, history, oracle


#: Rows of one micro-batch, about: larger inputs are cut into more files.
BATCH_ROWS = 1_000_000


def _stream(spark, sf, view=None, text=None, at_once=False):
    """The events as a stream, through a derived view: the file itself, or cut by event id into files of a micro-batch each, in order."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    parts = -(-events.count() // BATCH_ROWS)
    if at_once or parts <= 1:
        raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        cut = events.repartitionByRange(parts, F.asc_nulls_last("event_id")).withColumn("file", F.spark_partition_id())
        raw = _files(spark, cut, events.schema, "events", parts, split=False)
    return spark.sql(text or VIEWS[view](Spark()), events=raw)


def _leases(spark, sf, *columns):
    """The leases, worked out once: a stream joined with the view itself would run it again over all events in every micro-batch."""
    return cut_lineage(flat(spark, sf, "leases").select(*columns), "leases")


def _last(df, key, order):
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("x")).select(key, "x.*")


@query("stream_lease_usage", "STR01 WIN02", oracle(["heartbeats"], qt.USAGE_SQL + "\nSELECT lease_id, round(peak, 6) AS peak, round(CASE WHEN span_ms > 0 THEN area / span_ms ELSE lc END, 6) AS mean, samples, span_ms FROM u"))
def stream_lease_usage(spark, sf):
    out = _last(jobs.run_to_table(state.live_usage(_stream(spark, sf, "heartbeats")), "usage"), "lease_id", "samples")
    return out.withColumns({"peak": F.round("peak", 6), "mean": F.round("mean", 6)})


@query("stream_overrun_alerts", "STR02", ORACLES["lease_overruns"].replace("SELECT lease_id, min(since) AS since_ms, max(t_ms) AS last_ms,", "SELECT lease_id, min(since) AS since_ms,").replace(", floor(max(cores) * 1000 + 0.5) / 1000 AS peak, count(*) AS readings", ""))
def stream_overrun_alerts(spark, sf):
    r = _stream(spark, sf, "heartbeats").join(_leases(spark, sf, "lease_id", "charged_cores"), "lease_id")
    return jobs.run_to_table(state.overrun_alerts(r, qt.GAP, qt.MIN_MS), "overrun").select("lease_id", "since_ms", "alert_ms")


@query("stream_load_gate", "STR06", ORACLES["load_gate"])
def stream_load_gate(spark, sf):
    s = _stream(spark, sf, "samples").withColumn("thresholds", F.expr("ord div 900 % 2"))
    return jobs.run_to_table(state.hysteresis(s, "host", "load", 12, 6, 3, thresholds="thresholds"), "load-gate")


@query("stream_cpu_gate", "STR07", ORACLES["cpu_gate"])
def stream_cpu_gate(spark, sf):
    s = _stream(spark, sf, "samples").withColumn("thresholds", F.expr("ord div 700 % 2"))
    return jobs.run_to_table(state.hysteresis(s, "host", "busy_percent", 60, 30, 2, at_close=True, thresholds="thresholds"), "cpu-gate")


@query("stream_device_gate", "STR08", ORACLES["device_gate"])
def stream_device_gate(spark, sf):
    why = F.when(F.col("temp_c") > 60, "thermal").when(F.col("load") > 20, "on-battery")
    s = _stream(spark, sf, "samples").withColumns({"violation": why, "informative": F.col("temp_c").isNotNull(), "thresholds": F.expr("ord div 800 % 2")})
    return jobs.run_to_table(state.device_hysteresis(s, 3, "thresholds"), "device-gate")


@query("stream_lease_silence", "STR03 STR04", ORACLES["lease_silence"])
def stream_lease_silence(spark, sf):
    r = _stream(spark, sf, "heartbeats").join(_leases(spark, sf, "lease_id", "charged_cores", "started_ms"), "lease_id")
    flags = state.silence_flags(r, max_gap_ms=qt.GAP, below_fraction=0.6, hung_cores=0.4, hung_after_ms=qt.DAY, idle_after_ms=qt.DAY)
    return jobs.run_to_table(flags, "silence")


@query("stream_busy_cores", "WIN04 WIN05", ORACLES["host_busy_cores"])
def stream_busy_cores(spark, sf):
    two = "n_cores = 2"
    c = _stream(spark, sf, "counters").selectExpr(
        "host", "ord", "t_ms - t_ms % 600000 + ord * 400 % 50000 AS t_ms", f"if({two}, array(double(total0), double(total1)), array(double(total0))) AS totals", f"if({two}, array(double(idle0), double(idle1)), array(double(idle0))) AS idles")
    return jobs.run_to_table(state.busy_core_counters(c, 45_000), "busy-cores").withColumn("busy_cores", F.round("busy_cores", 6))


@query("stream_unreachable_clock", "STR09", ORACLES["unreachable_clock"])
def stream_unreachable_clock(spark, sf):
    p = _stream(spark, sf, "samples").selectExpr("concat('r', host) AS runner", "ord", "t_ms", "load < 8 AS ok")
    return jobs.run_to_table(state.reachability(p), "pings")


@query("stream_decision_compaction", "STR12", ORACLES["decision_compaction"])
def stream_decision_compaction(spark, sf):
    d = _stream(spark, sf, text=qt.DEC).withColumn("signature", F.concat(F.when(F.col("admit"), "admit:").otherwise("deny:"), "reason"))
    return jobs.run_to_table(state.compact_decisions(d.select("candidate", "ord", "t_ms", "signature", "admit")), "decisions")


@query("stream_wait_records", "STR13", ORACLES["wait_records"].replace("SELECT ticket, reason, cause, min(t_ms) AS since_ms, max(t_ms) AS last_ms, count(*) AS polls", "SELECT ticket, reason, min(t_ms) AS since_ms, count(*) AS polls"))
def stream_wait_records(spark, sf):
    out = jobs.run_to_table(state.wait_since(_stream(spark, sf, text=qt.WAIT)), "waits")
    return out.groupBy("ticket", "reason", "since_ms").agg(F.count("*").alias("polls"))


@query("stream_starvation", "STR15", ORACLES["starvation_episodes"])
def stream_starvation(spark, sf):
    out = jobs.run_to_table(state.starvation(_stream(spark, sf, text=qt.STARVE.replace("50.0", "50.0D"))), "starved")
    return out.groupBy("host", "since_ms").agg(F.max("last_ms").alias("last_ms"), F.count("*").alias("denials"))


@query("stream_decision_rates", "AGG39 STR14", f"""WITH d AS ({qt.DEC.replace('{events}', 'events')})
SELECT * FROM (SELECT host, t_ms // 3600000 * 3600000 AS hour_ms, CASE WHEN admit THEN 'admit' ELSE 'deny' END AS verdict, reason, count(*) AS n FROM d GROUP BY 1, 2, 3, 4) w
WHERE hour_ms + 3600000 <= (SELECT max(t_ms) - 600000 FROM d)""")
def stream_decision_rates(spark, sf):
    return jobs.run_to_table(jobs.decision_rates(_stream(spark, sf, text=qt.DEC, at_once=True)), "rates")


FULL_PART = 50  # rows a part, of files that are written in parts

INGEST_FILES = 24  # files of the raw history, about, once it is large


@query("stream_history_ingest", "STR21 SNK03 SRC01", oracle(["history"], """
SELECT id, count(*) FILTER (coalesce(id, '') = '') AS unnamed, count(DISTINCT coalesce(strftime(make_timestamp((floor(coalesce(ended_at, started_at)) * 1000)::BIGINT), '%Y-%m'), 'none')) FILTER (coalesce(id, '') <> '') AS months FROM history GROUP BY 1"""))
def stream_history_ingest(spark, sf):
    """Raw rows in several micro-batches, some without an id: how often each id is stored, and for how many months."""
    h = history(spark, sf)
    src, dst = work_path(spark, "lines"), work_path(spark, "stored")
    # every batch looks at what is stored, so large inputs come in larger files, not in more batches
    records = max(4000, -(-spark.read.parquet(f"{sf}/orders.parquet").count() // INGEST_FILES))
    h.select(F.to_json(F.struct(*[c for c in h.columns if c not in ("ord", "event", "cust")])).alias("value")).write.option("maxRecordsPerFile", records).text(src)
    jobs.ingest_history(spark, src, dst, work_path(spark, "ingest-checkpoint"), "month", max_files=2).awaitTermination()
    named = F.coalesce("id", F.lit("")) != ""
    return spark.read.parquet(dst).groupBy("id").agg(F.count_if(~named).alias("unnamed"), F.count_if(named).alias("months"))


def _files(spark, rows, schema_of, name, files, split=True):
    """`rows` (with a column `file`) written as that many files and read as a stream, one file in a micro-batch.

    The rows are worked out once, into a folder per file. With `split` the largest file sets how many parts of about BATCH_ROWS each file is written
    in; all parts of a file make one micro-batch, so larger inputs give larger micro-batches read by more tasks, not more of them.
    """
    path, dealt = work_path(spark, name), work_path(spark, f"{name}-dealt")
    rows.write.partitionBy("file").parquet(dealt)
    dealt = spark.read.schema(rows.schema).parquet(dealt)
    sizes = {int(r["file"]): r["count"] for r in dealt.filter("file IS NOT NULL").groupBy("file").count().collect()}  # one row per file
    parts = max([1, *[-(-n // BATCH_ROWS) for i, n in sizes.items() if 0 <= i < files]]) if split else 1
    for i in range(files):
        part, n = dealt.filter(F.col("file") == i).drop("file"), sizes.get(i, 0)
        if n >= FULL_PART * parts:  # enough for a row in every part
            part.repartition(parts).write.mode("append").parquet(path)
            continue
        part.coalesce(1).write.mode("append").parquet(path)
        for _ in range(parts - 1):  # files without rows, so that every micro-batch has as many
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema_of).option("maxFilesPerTrigger", parts).parquet(path)


@query("stream_lease_expiry", "STR11 SCL25", ORACLES["lease_expiry"])
def stream_lease_expiry(spark, sf):
    """Claims in the first two files, shuffled; each snapshot's ticks in the third, in the fourth every ticket ends, in the last the watermark moves on."""
    t = flat(spark, sf, "tickets").selectExpr("snapshot AS cluster", "ticket_id", "state", "created_ms + 3000000 AS lease_until_ms", "CAST(requeues AS BIGINT) AS requeues", "ticket_id % 17 = 0 AS cancel_requested").filter("state IN ('claimed', 'running')")
    now = f"({qq.EARLY} + cluster * 1000000000L)"
    claims = t.withColumns({"t_ms": F.expr(f"{now} - 2000 - ticket_id % 100"), "file": F.expr("ticket_id % 2")})
    ends = t.withColumns({"t_ms": F.expr(f"{now} + 1"), "state": F.lit("finished"), "file": F.lit(3)})
    clusters = t.select("cluster").distinct()
    ticks = clusters.select("cluster", F.explode(F.array(F.expr(f"{now} - if(cluster = 3, 90000L, 5000L)"), F.expr(now))).alias("t_ms")).withColumn("file", F.lit(2))
    far = t.agg(F.max(F.expr(f"{now} + 100 * 86400000L")).alias("t_ms"), F.max("cluster").alias("cluster")).withColumns({"file": F.lit(4), "state": F.lit("mark")})
    rows = claims.unionByName(ends).unionByName(ticks, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)
    rows = rows.repartition(8, "cluster", "ticket_id")
    # the watermark allows for the spread of the snapshots' times, so no file comes late
    s = _files(spark, rows, rows.drop("file").schema, "lease-events", 5)
    verdicts = timers.lease_verdicts(s.filter("state IS NOT NULL"), s.filter("state IS NULL"), delay="90 days")
    out, checkpoint = timers.run_stateful(verdicts, "lease-verdicts")
    if left := timers.state_rows(spark, checkpoint, "pending", "leases", "due", "overdue", "soon"):
        raise AssertionError(f"{left} rows of state are left")
    return out.selectExpr("cluster AS snapshot", "ticket_id", "verdict", "not_before_ms", "lease_until_ms")


@query("stream_lease_cpu_seconds", "WIN03", ORACLES["lease_cpu_seconds"])
def stream_lease_cpu_seconds(spark, sf):
    """Readings and ends in three files each, whatever their times; a third of the ends comes after all readings."""
    h = flat(spark, sf, "heartbeats").select("lease_id", "ord", "t_ms", "cores").withColumn("file", F.pmod(F.xxhash64("ord"), F.lit(3)))
    e = flat(spark, sf, "leases").select("lease_id", "started_ms", "ended_ms").withColumn("file", F.pmod(F.xxhash64("lease_id"), F.lit(3)))
    far = 4_000 * qt.DAY  # the last file of each stream moves its watermark past all ends
    h = h.unionByName(h.agg(F.lit(-1).cast("long").alias("lease_id"), F.lit(0).cast("long").alias("ord"), (F.max("t_ms") + far).alias("t_ms"), F.lit(0.0).alias("cores"), F.lit(3).cast("long").alias("file")))
    e = e.unionByName(e.agg(F.lit(-2).cast("long").alias("lease_id"), F.lit(0).cast("long").alias("started_ms"), (F.max("ended_ms") + far).alias("ended_ms"), F.lit(3).cast("long").alias("file")))
    readings = _files(spark, h, h.drop("file").schema, "readings", 4)
    ends = _files(spark, e, e.drop("file").schema, "ends", 4)
    return jobs.run_to_table(jobs.finished_cpu(readings, ends, "1200 days", "1200 days", "1200 days"), "finished-cpu")


@query("stream_duration_estimator", "AGG11", ORACLES["duration_estimator_levels"])
def stream_duration_estimator(spark, sf):
    """Observations of all times shuffled over six micro-batches; slices of half a year."""
    obs = qe._observations(spark, sf).withColumn("file", F.pmod(F.xxhash64("ord", F.lit("shuffle")), F.lit(6)))
    s = _files(spark, cut_lineage(obs, "observations"), obs.drop("file").schema, "observations", 6)
    out, _ = timers.run_stateful(estimators.fold_durations(s, 182 * 86_400_000.0), "duration-estimator")
    newest = out.groupBy("level", *estimates.PARTS).agg(F.max_by(F.struct("n", "censored_n", "state", "variance"), "n").alias("x")).select("level", *estimates.PARTS, "x.*")
    return newest.select("level", *estimates.PARTS, "n", "censored_n", F.round(F.exp("state"), 5).alias("p50"), F.round(estimates.p90_of(F.col("state"), F.col("variance")), 5).alias("p90"))


@query("stream_object_state", "STR17", oracle(["store_journal"], qi.STATE_SQL + """,
pn AS (SELECT store, path, max(seq) AS pin_seq FROM jk WHERE kind = 'pin' GROUP BY 1, 2)
SELECT coalesce(st.store, pn.store) AS store, coalesce(st.path, pn.path) AS path, state, pin_seq FROM st FULL JOIN pn ON pn.store = st.store AND pn.path = st.path"""))
def stream_object_state(spark, sf):
    """The journal shuffled over five micro-batches: object states and pins, kept apart and side by side here."""
    j = flat(spark, sf, "store_journal").selectExpr("store", "seq", "path", f"{qi.JK} AS kind").withColumn("file", F.pmod(F.xxhash64("store", "seq"), F.lit(5)))
    target = work_path(spark, "object-tables")
    jobs.follow_objects(_files(spark, j, j.drop("file").schema, "store-journal", 5), target, work_path(spark, "object-checkpoint"), buckets=8)
    objects, marks = (t.read() for t in jobs.object_tables(spark, target, buckets=8))
    pins = marks.filter("mark = 'pin'").select("store", "path", F.col("seq").alias("pin_seq"))
    return objects.drop("seq").join(pins, ["store", "path"], "full")


@query("stream_no_progress", "STR05", ORACLES["no_progress_streaks"])
def stream_no_progress(spark, sf):
    """The processes of each snapshot spread over three files; a fourth moves the watermark."""
    wrote = (F.col("lease_id") % 4 != 0) & (F.col("t_ms") > 1704067200000)
    m = flat(spark, sf, "procs").selectExpr("host * 1000 + pgid AS lease_id", "snapshot_ms AS t_ms", "concat(pid, ':', token) AS identity", "cpu_sec")
    m = m.withColumns({"output_bytes": F.when(wrote, 10).otherwise(0).cast("long"), "file": F.pmod(F.xxhash64("identity", "t_ms"), F.lit(3))})
    far = m.agg(F.max("lease_id").alias("lease_id"), (F.max("t_ms") + 10 * qt.DAY).alias("t_ms"), F.lit(3).cast("long").alias("file"))
    rows = m.unionByName(far, allowMissingColumns=True)
    s = _files(spark, rows, rows.drop("file").schema, "members", 4)
    out, _ = timers.run_stateful(timers.no_progress(s, delay="2 days"), "no-progress")
    return out.withColumn("interval_cores", F.round("interval_cores", 6))


DOWN_MS, LOST_MS = 1_000_000, 7_200_000


@query("stream_runner_states", "STR10", oracle(["samples"], qt.PING_SQL + f""",
cfg AS (SELECT 'r' || r_regionkey::VARCHAR AS runner, r_regionkey = 4 AS offline, r_regionkey <> 2 AS available FROM region),
x AS (SELECT p2.*, offline, available, lag(ok) OVER w AS was_ok, row_number() OVER w AS rn,
  first_value(CASE WHEN ok THEN t_ms END IGNORE NULLS) OVER (PARTITION BY p2.runner ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ms
  FROM p2 JOIN cfg USING (runner) WINDOW w AS (PARTITION BY p2.runner ORDER BY ord))
SELECT runner, t_ms, 'offline' AS state, unreachable_since, last_ok_ms, NULL::BIGINT AS lost_settle_ms FROM x WHERE offline AND rn = 1
UNION ALL SELECT runner, t_ms, CASE WHEN available THEN 'up' ELSE 'off-schedule' END, NULL, last_ok_ms, NULL FROM x WHERE NOT offline AND ok AND NOT coalesce(was_ok, false)
UNION ALL SELECT runner, t_ms + late, name, t_ms, last_ok_ms, t_ms + {LOST_MS} FROM x, (VALUES (0, 'unreachable'), ({DOWN_MS}, 'down'), ({LOST_MS}, 'lost')) v(late, name)
  WHERE NOT offline AND st AND (late = 0 OR end_ms IS NULL OR end_ms >= t_ms + late)"""))
def stream_runner_states(spark, sf):
    """Pings in three files by arrival; a fourth only moves the watermark past the last deadlines."""
    p = qt._pings(spark, sf)
    last = p.agg(F.max("ord")).scalar()
    p = p.withColumn("file", F.least(F.lit(2), F.floor(F.col("ord") * 3 / (last + F.lit(1)))))
    far = p.agg(F.max("runner").alias("runner"), (F.max("t_ms") + 30 * qt.DAY).alias("t_ms"), F.lit(3).cast("long").alias("file"))
    rows = p.unionByName(far, allowMissingColumns=True)
    cfg = spark.read.parquet(f"{sf}/region.parquet").selectExpr("concat('r', r_regionkey) AS runner", "r_regionkey = 4 AS offline", "r_regionkey <> 2 AS available")
    s = _files(spark, rows, rows.drop("file").schema, "pings", 4)
    out, _ = timers.run_stateful(timers.runner_states(s, cfg, DOWN_MS, LOST_MS, delay="1 day"), "runner-states")
    return out.drop("next_ping_ms")


@query("stream_damped_urgency", "STR18", ORACLES["damped_urgency"])
def stream_damped_urgency(spark, sf):
    """Forecast cycles in four files by time."""
    f = spark.sql(qq.ETA, events=spark.read.parquet(f"{sf}/events.parquet"))
    last = f.agg(F.max("cycle")).scalar()
    rows = f.withColumn("file", F.least(F.lit(3), F.floor(F.col("cycle") * 4 / (last + F.lit(1)))))
    return jobs.run_to_table(state.urgency(_files(spark, rows, f.schema, "forecasts", 4)), "urgency").withColumn("urgency", F.round("urgency", 6))


@query("stream_bypass_table", "SNK02 AGG19", ORACLES["bypass_table"])
def stream_bypass_table(spark, sf):
    """Runs shuffled over four micro-batches; the first builds the table, the others merge into the buckets of their lanes."""
    h = history(spark, sf)
    rows = h.withColumn("file", F.pmod(F.xxhash64("ord"), F.lit(4)))
    s = _files(spark, rows, h.schema, "runs", 4)
    table = bypass_summaries(spark, work_path(spark, "bypass"), 10**9, buckets=16)
    jobs.follow_bypass(s, table, work_path(spark, "bypass-checkpoint"), lambda: rows.filter("file = 0").select(*h.columns), lambda: 1)
    return estimates.bypass_of(table.read(1), 1_800_000.0)


@query("stream_replication_lag", "STR16", ORACLES["replication_lag"].replace("failed_rounds FROM mk m JOIN", "failed_rounds, 0 AS missing FROM mk m JOIN"))
def stream_replication_lag(spark, sf):
    """The journal shuffled over four files; an early mark, the final one, and the early one again."""
    j = flat(spark, sf, "store_journal").select("store", "seq", "created_ms").withColumn("file", F.pmod(F.xxhash64("store", "seq"), F.lit(4)))
    stores = j.select("store").distinct()
    mark = stores.selectExpr("store", "CASE store WHEN 0 THEN 50 WHEN 1 THEN 1000000 ELSE 0 END AS replicated_seq", "store * 2 AS failed_rounds")
    early = stores.selectExpr("store", "1L AS at", "0L AS replicated_seq", "99L AS failed_rounds")
    marks = early.withColumn("file", F.lit(0)).unionByName(mark.withColumns({"at": F.lit(2).cast("long"), "file": F.lit(2)})).unionByName(early.withColumn("file", F.lit(3)))
    marks = marks.unionByName(early.withColumn("file", F.lit(1))).select("store", "at", F.col("replicated_seq").cast("long").alias("replicated_seq"), F.col("failed_rounds").cast("long").alias("failed_rounds"), "file")
    lag = replication.replication_lag(_files(spark, j, j.drop("file").schema, "lag-journal", 4), _files(spark, marks, marks.drop("file").schema, "lag-marks", 4))
    out, _ = timers.run_stateful(lag, "replication-lag")
    return replication.newest_lag(out, qi.NOW + 90_000_000)
