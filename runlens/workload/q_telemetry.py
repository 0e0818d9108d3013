"""Lease, host, gate, reachability and process-tree telemetry over the derived event views."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans import telemetry as tel
from runlens.workload.registry import query
from runlens.workload.views import flat, oracle

DAY = 86_400_000
GAP, MIN_MS = 2 * DAY, DAY
#: So narrow that the events of every size cross many slices; production keeps the default.
SLICE = 4_000.0

USAGE_SQL = """
h AS (SELECT *, max(t_ms) OVER (PARTITION BY lease_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM heartbeats WHERE cores IS NOT NULL),
acc AS (SELECT *, lag(cores) OVER (PARTITION BY lease_id ORDER BY ord) AS pc, t_ms - lag(t_ms) OVER (PARTITION BY lease_id ORDER BY ord) AS dt FROM h WHERE mx IS NULL OR t_ms > mx),
u1 AS (SELECT lease_id, coalesce(sum(pc * dt), 0) AS area, coalesce(sum(dt), 0)::BIGINT AS span_ms, arg_min(t_ms, ord) AS ft, arg_min(cores, ord) AS fc, arg_max(t_ms, ord) AS lt, arg_max(cores, ord) AS lc FROM acc GROUP BY 1),
u AS (SELECT u1.*, x.peak, x.samples FROM u1 JOIN (SELECT lease_id, max(cores) AS peak, count(*) AS samples FROM h GROUP BY 1) x ON x.lease_id = u1.lease_id)"""


@query("lease_usage", "WIN02", oracle(["heartbeats"], USAGE_SQL + """
SELECT lease_id, floor(peak * 1000 + 0.5) / 1000 AS peak, floor((CASE WHEN span_ms > 0 THEN area / span_ms ELSE lc END) * 1000 + 0.5) / 1000 AS mean, samples, span_ms FROM u"""))
def lease_usage(spark, sf):
    return tel.usage_fold(flat(spark, sf, "heartbeats"), ord_slice=SLICE).select("lease_id", "peak", "mean", "samples", "span_ms")


@query("lease_cpu_seconds", "WIN03", oracle(["heartbeats", "leases"], USAGE_SQL + """
SELECT u.lease_id, floor((area + CASE WHEN started_ms < ft THEN fc * (ft - started_ms) ELSE 0 END + CASE WHEN ended_ms > lt THEN lc * (ended_ms - lt) ELSE 0 END) / 1000 * 1000 + 0.5) / 1000 AS cpu_seconds
FROM u JOIN leases l ON l.lease_id = u.lease_id"""))
def lease_cpu_seconds(spark, sf):
    return tel.integrated_cpu(tel.usage_fold(flat(spark, sf, "heartbeats"), ord_slice=SLICE), flat(spark, sf, "leases"))


@query("settled_demand", "WIN07", oracle(["heartbeats", "leases"], f"""
r AS (SELECT h.*, charged_cores AS cold, started_ms FROM heartbeats h JOIN leases l ON l.lease_id = h.lease_id WHERE cores >= 0),
w AS (SELECT *, count(*) OVER z AS cnt, max(cores) OVER z AS pk FROM r WINDOW z AS (PARTITION BY lease_id ORDER BY t_ms RANGE BETWEEN {GAP} PRECEDING AND CURRENT ROW)),
s AS (SELECT *, t_ms - started_ms >= {DAY} AND cnt >= 2 AS settled FROM w)
SELECT lease_id, ord, t_ms, CASE WHEN settled THEN greatest(cores, least(cold, greatest(cold * 0.5::DOUBLE, pk * 1.2::DOUBLE))) ELSE greatest(cores, cold) END AS demand, CASE WHEN settled THEN 'settled' ELSE 'cold' END AS basis FROM s"""))
def settled_demand(spark, sf):
    return tel.settled_demand(flat(spark, sf, "heartbeats"), flat(spark, sf, "leases"), window_ms=GAP, settle_ms=DAY)


def _islands(src: str, cond: str) -> str:
    return f"""
i1 AS (SELECT *, coalesce({cond}, false) AS q FROM {src}),
i2 AS (SELECT *, q AND NOT coalesce(lag(q) OVER w AND t_ms - lag(t_ms) OVER w > 0 AND t_ms - lag(t_ms) OVER w <= {GAP}, false) AS st FROM i1 WINDOW w AS (PARTITION BY lease_id ORDER BY ord)),
i3 AS (SELECT *, sum(st::INT) OVER (PARTITION BY lease_id ORDER BY ord) AS isl, last_value(CASE WHEN st THEN t_ms END IGNORE NULLS) OVER (PARTITION BY lease_id ORDER BY ord) AS since FROM i2)"""


@query("lease_overruns", "STR02 P08", oracle(["heartbeats", "leases"], "r AS (SELECT h.*, charged_cores FROM heartbeats h JOIN leases l ON l.lease_id = h.lease_id)," + _islands("r", "charged_cores > 0 AND cores > 1.25 * charged_cores") + f"""
SELECT lease_id, min(since) AS since_ms, max(t_ms) AS last_ms, min(CASE WHEN t_ms - since >= {MIN_MS} THEN t_ms END) AS alert_ms, floor(max(cores) * 1000 + 0.5) / 1000 AS peak, count(*) AS readings
FROM i3 WHERE q GROUP BY lease_id, isl HAVING max(t_ms - since) >= {MIN_MS}"""))
def lease_overruns(spark, sf):
    return tel.overruns(flat(spark, sf, "heartbeats"), flat(spark, sf, "leases"), max_gap_ms=GAP, min_ms=MIN_MS, ord_slice=SLICE)


@query("lease_silence", "STR03 STR04 P08", oracle(["heartbeats", "leases"],
       "r AS (SELECT h.*, charged_cores, started_ms FROM heartbeats h JOIN leases l ON l.lease_id = h.lease_id),"
       + _islands("r", "cores IS NOT NULL AND interval_cores >= 0 AND interval_cores < 0.6 * charged_cores") + "," +
       _islands("(SELECT * EXCLUDE (q, st, isl, since), CASE WHEN q THEN since END AS idle_since FROM i3)", "cores IS NOT NULL AND interval_cores >= 0 AND interval_cores < 0.4").replace("i1", "j1").replace("i2", "j2").replace("i3 AS", "j3 AS").replace("FROM i2", "FROM j2") + f""",
o AS (SELECT *, CASE WHEN q THEN since END AS hung_since, last_value(CASE WHEN wrote_output THEN t_ms END IGNORE NULLS) OVER (PARTITION BY lease_id ORDER BY ord) AS out_ms FROM j3),
v AS (SELECT *, greatest(0, t_ms - coalesce(out_ms, started_ms)) AS silent_ms, coalesce(t_ms - idle_since, 0) AS idle_ms, coalesce(t_ms - hung_since, 0) AS hung_ms FROM o)
SELECT lease_id, ord, silent_ms, idle_ms, idle_ms >= {DAY} AS idle, silent_ms >= {DAY} AS silent, silent_ms >= {DAY} AND hung_ms >= {DAY} AS hung FROM v"""))
def lease_silence(spark, sf):
    return tel.silence(flat(spark, sf, "heartbeats"), flat(spark, sf, "leases"), max_gap_ms=GAP, below_fraction=0.6, hung_cores=0.4, hung_after_ms=DAY, idle_after_ms=DAY, ord_slice=SLICE)


@query("host_busy_cores", "WIN04 WIN05", oracle(["counters"], """
c AS (SELECT host, ord, t_ms - t_ms % 600000 + ord * 400 % 50000 AS t_ms, n_cores, total0, idle0, total1, idle1 FROM counters),
p AS (SELECT *, lag(t_ms) OVER w AS pt, lag(n_cores) OVER w AS pn, lag(total0) OVER w AS pt0, lag(idle0) OVER w AS pi0, lag(total1) OVER w AS pt1, lag(idle1) OVER w AS pi1 FROM c WINDOW w AS (PARTITION BY host ORDER BY ord)),
d AS (SELECT *, coalesce(n_cores = pn AND t_ms - pt BETWEEN 0 AND 60000, false) AS usable, total0 - pt0 AS d0, CASE WHEN n_cores = 2 THEN total1 - pt1 ELSE 0 END AS d1 FROM p),
e AS (SELECT *, usable AND (d0 > 0 OR d1 > 0) AS valid, CASE WHEN usable AND (d0 > 0 OR d1 > 0) THEN CASE WHEN d0 > 0 THEN (d0 - (idle0 - pi0)) / d0 ELSE 0 END + CASE WHEN d1 > 0 THEN (d1 - (idle1 - pi1)) / d1 ELSE 0 END END AS busy,
  usable AND total0 = pt0 AND idle0 = pi0 AND (n_cores = 1 OR (total1 = pt1 AND idle1 = pi1)) AS same FROM d),
f AS (SELECT *, same AND NOT valid AS unchanged FROM e),
g AS (SELECT *, last_value(CASE WHEN NOT unchanged THEN {'b': CASE WHEN valid THEN busy END, 't': t_ms} END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ord) AS lv FROM f),
k AS (SELECT *, coalesce(unchanged AND lv.b IS NOT NULL AND t_ms - lv.t >= 0 AND t_ms - lv.t < 45000, false) AS reused FROM g)
SELECT host, ord, round(CASE WHEN reused THEN lv.b ELSE busy END, 6) AS busy_cores, NOT valid AND NOT reused AS stale, reused FROM k"""))
def host_busy_cores(spark, sf):
    c = flat(spark, sf, "counters").selectExpr(
        "host", "ord", "t_ms - t_ms % 600000 + ord * 400 % 50000 AS t_ms",
        "if(n_cores = 2, array(struct(total0 AS total, idle0 AS idle), struct(total1 AS total, idle1 AS idle)), array(struct(total0 AS total, idle0 AS idle))) AS cpus")
    return tel.busy_cores(c, 45_000, ord_slice=SLICE).select("host", "ord", F.round("busy_cores", 6).alias("busy_cores"), "stale", "reused")


DELTAS_SQL = """
snap AS (SELECT host, snapshot_ms, lag(snapshot_ms) OVER (PARTITION BY host ORDER BY snapshot_ms) AS prev_ms FROM (SELECT DISTINCT host, snapshot_ms FROM procs) z),
delta AS (SELECT p.*, s.prev_ms, CASE WHEN b.cpu_sec IS NOT NULL THEN greatest(0, p.cpu_sec - b.cpu_sec) END AS delta_sec, p.snapshot_ms - s.prev_ms AS window_ms FROM procs p JOIN snap s ON s.host = p.host AND s.snapshot_ms = p.snapshot_ms
  LEFT JOIN procs b ON b.host = p.host AND b.pid = p.pid AND b.token = p.token AND b.snapshot_ms = s.prev_ms)"""


@query("process_cpu_deltas", "WIN06", oracle(["procs"], DELTAS_SQL + "\nSELECT host, snapshot_ms, pid, token, delta_sec FROM delta"))
def process_cpu_deltas(spark, sf):
    return tel.process_deltas(flat(spark, sf, "procs")).select("host", "snapshot_ms", "pid", "token", "delta_sec")


@query("no_progress_streaks", "STR05", oracle(["procs"], """
m AS (SELECT host * 1000 + pgid AS lease_id, snapshot_ms AS t_ms, pid::VARCHAR || ':' || token AS identity, cpu_sec FROM procs),
c AS (SELECT lease_id, t_ms, count(*) AS n, lease_id % 4 <> 0 AND t_ms > 1704067200000 AS wrote FROM m GROUP BY 1, 2),
p AS (SELECT a.lease_id, a.t_ms, a.n, b.n AS pn, b.t_ms AS pt, a.wrote FROM c a LEFT JOIN c b ON b.lease_id = a.lease_id AND b.t_ms = a.t_ms - 60000),
k AS (SELECT x.lease_id, x.t_ms, count(*) AS kept, sum(greatest(0, x.cpu_sec - y.cpu_sec)) AS used FROM m x JOIN m y ON y.lease_id = x.lease_id AND y.t_ms = x.t_ms - 60000 AND y.identity = x.identity GROUP BY 1, 2),
j AS (SELECT p.*, CASE WHEN k.kept = p.n AND p.pn = p.n THEN used / 60 END AS cores FROM p LEFT JOIN k ON k.lease_id = p.lease_id AND k.t_ms = p.t_ms)
SELECT lease_id, t_ms, round(cores, 6) AS interval_cores, CASE WHEN pt IS NOT NULL AND NOT wrote AND cores <= 0.05::DOUBLE / 60 THEN t_ms - pt ELSE 0 END AS idle_ms FROM j"""))
def no_progress_streaks(spark, sf):
    m = flat(spark, sf, "procs").selectExpr("host * 1000 + pgid AS lease_id", "snapshot_ms AS t_ms", "concat(pid, ':', token) AS identity", "cpu_sec")
    obs = m.select("lease_id", "t_ms").distinct().withColumn("output_bytes", F.when((F.col("lease_id") % 4 != 0) & (F.col("t_ms") > 1704067200000), 10).otherwise(0))
    return tel.no_progress(obs, m).withColumn("interval_cores", F.round("interval_cores", 6))


def _gate_sql(key: str, src: str, cl: str, rs: str, co: str, n: int, changed: str = "false", why: str = "NULL::VARCHAR") -> str:
    return f"""
g1 AS (SELECT *, coalesce({cl}, false) AS cl, coalesce({rs}, false) AS rs, coalesce({co}, false) AND NOT coalesce({cl}, false) AS co FROM {src}),
g1c AS (SELECT *, {changed} AS ch FROM g1),
g2 AS (SELECT *, sum(co::INT) OVER (PARTITION BY {key} ORDER BY ord) AS cum FROM g1c),
g3 AS (SELECT *, coalesce(last_value(CASE WHEN cl OR rs THEN cum WHEN ch THEN cum - co::INT END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY ord), 0) AS base FROM g2),
g4 AS (SELECT *, co AND cum - base >= {n} AS op FROM g3),
g5 AS (SELECT *, last_value(CASE WHEN op THEN ord END IGNORE NULLS) OVER w AS lo, last_value(CASE WHEN cl THEN ord END IGNORE NULLS) OVER w AS lc, last_value(CASE WHEN cl THEN {why} END IGNORE NULLS) OVER w AS why FROM g4 WINDOW w AS (PARTITION BY {key} ORDER BY ord)),
gt AS (SELECT *, coalesce(lc IS NOT NULL AND (lo IS NULL OR lo < lc), false) AS closed FROM g5)"""


@query("load_gate", "STR06", oracle(["samples"], _gate_sql("host", "(SELECT *, (ord // 900 % 2)::VARCHAR AS th FROM samples)", "load > 12", "load >= 6", "load < 6", 3,
       changed="coalesce(th <> lag(th) OVER (PARTITION BY host ORDER BY ord), false)") + "\nSELECT host, ord, closed FROM gt"))
def load_gate(spark, sf):
    return tel.load_gate(flat(spark, sf, "samples"), 12, 6, 3, F.expr("CAST(ord div 900 % 2 AS STRING)"), ord_slice=SLICE).select("host", "ord", "closed")


@query("cpu_gate", "STR07", oracle(["samples"], _gate_sql("host", "(SELECT *, (ord // 700 % 2)::VARCHAR AS th FROM samples WHERE busy_percent IS NOT NULL)", "busy_percent >= 60", "busy_percent >= 30", "busy_percent < 30", 2,
       changed="coalesce(th <> lag(th) OVER (PARTITION BY host ORDER BY ord), false)") + "\nSELECT host, ord, closed FROM gt"))
def cpu_gate(spark, sf):
    return tel.cpu_gate(flat(spark, sf, "samples"), 60, 30, 2, F.expr("CAST(ord div 700 % 2 AS STRING)"), ord_slice=SLICE).select("host", "ord", "closed")


@query("device_gate", "STR08", oracle(["samples"], _gate_sql("host", "(SELECT *, (ord // 800 % 2)::VARCHAR AS th FROM samples)", "temp_c > 60 OR load > 20", "temp_c > 60 OR load > 20", "temp_c IS NOT NULL", 3,
       changed="coalesce(th <> lag(th) OVER (PARTITION BY host ORDER BY ord), false)", why="CASE WHEN temp_c > 60 THEN 'thermal' ELSE 'on-battery' END")
       + "\nSELECT host, ord, closed, CASE WHEN closed THEN why END AS reason FROM gt"))
def device_gate(spark, sf):
    why = F.when(F.col("temp_c") > 60, "thermal").when(F.col("load") > 20, "on-battery")
    return tel.device_gate(flat(spark, sf, "samples"), why, F.col("temp_c").isNotNull(), 3, F.expr("CAST(ord div 800 % 2 AS STRING)"), ord_slice=SLICE).select("host", "ord", "closed", "reason")


PING_SQL = """
pg AS (SELECT 'r' || host::VARCHAR AS runner, ord, t_ms, load < 8 AS ok FROM samples),
p1 AS (SELECT *, NOT ok AND coalesce(lag(ok) OVER (PARTITION BY runner ORDER BY ord), true) AS st FROM pg),
p2 AS (SELECT *, CASE WHEN NOT ok THEN last_value(CASE WHEN st THEN t_ms END IGNORE NULLS) OVER w END AS unreachable_since, last_value(CASE WHEN ok THEN t_ms END IGNORE NULLS) OVER w AS last_ok_ms FROM p1 WINDOW w AS (PARTITION BY runner ORDER BY ord)),
clk AS (SELECT *, CASE WHEN unreachable_since IS NOT NULL THEN t_ms + least(3600000, greatest(60000, t_ms - unreachable_since)) END AS next_ping_ms FROM p2)"""


def _pings(spark, sf):
    return flat(spark, sf, "samples").selectExpr("concat('r', host) AS runner", "ord", "t_ms", "load < 8 AS ok")


@query("unreachable_clock", "STR09 P08", oracle(["samples"], PING_SQL + "\nSELECT runner, ord, ok, unreachable_since, last_ok_ms, next_ping_ms FROM clk"))
def unreachable_clock(spark, sf):
    return tel.unreachable_clock(_pings(spark, sf), ord_slice=SLICE).drop("t_ms")


@query("runner_states", "STR10 JON17", oracle(["samples"], PING_SQL + """,
tick AS (SELECT max(t_ms) AS tick FROM clk),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runner ORDER BY ord DESC) AS rn FROM clk) z WHERE rn = 1),
cfg AS (SELECT 'r' || r_regionkey::VARCHAR AS runner, r_regionkey = 4 AS offline, r_regionkey <> 2 AS available FROM region),
j AS (SELECT c.*, l.unreachable_since, l.last_ok_ms, l.next_ping_ms, tick + 100000 AS now FROM cfg c LEFT JOIN lst l ON l.runner = c.runner, tick)
SELECT runner, CASE WHEN offline THEN 'offline' WHEN now - unreachable_since >= 1000000 THEN 'down' WHEN unreachable_since IS NOT NULL THEN 'unreachable' WHEN NOT available THEN 'off-schedule' ELSE 'up' END AS state,
  unreachable_since, CASE WHEN NOT offline THEN unreachable_since + 7200000 END AS lost_settle_ms, last_ok_ms, CASE WHEN NOT offline THEN next_ping_ms END AS next_ping_ms, true AS watcher_running FROM j"""))
def runner_states(spark, sf):
    cfg = spark.read.parquet(f"{sf}/region.parquet").selectExpr("concat('r', r_regionkey) AS runner", "r_regionkey = 4 AS offline", "r_regionkey <> 2 AS available")
    clock = tel.unreachable_clock(_pings(spark, sf), ord_slice=SLICE)
    now = clock.agg(F.max("t_ms") + 100_000).scalar()
    return tel.runner_states(clock, cfg.select("runner", "offline"), cfg.select("runner", "available"), now=now, down_after_ms=1_000_000, lost_after_ms=7_200_000)


@query("priority_clock", "WIN17", oracle(["heartbeats"], "SELECT lease_id AS host, ord, max(t_ms) OVER (PARTITION BY lease_id ORDER BY ord) AS effective_ms FROM heartbeats"))
def priority_clock(spark, sf):
    return tel.monotone_clock(flat(spark, sf, "heartbeats").withColumnRenamed("lease_id", "host"), ord_slice=SLICE).select("host", "ord", "effective_ms")


DEC = """SELECT user_id % 5 AS host, 'c' || CAST(user_id % 30 AS STRING) AS candidate, event_id AS ord, 1704067200000 + event_id * 7000 AS t_ms, event_type = 'purchase' AND event_id % 7 = 0 AS admit,
  event_id % 5 < 2 AS current_admit, CASE WHEN event_id % 211 < 190 THEN 'cpu' WHEN event_id % 3 = 0 THEN 'memory' ELSE 'load' END AS reason FROM {events}"""


def _decisions(spark, sf):
    d = spark.sql(DEC, events=spark.read.parquet(f"{sf}/events.parquet"))
    return d.withColumn("signature", F.concat(F.when(F.col("admit"), "admit:").otherwise("deny:"), "reason"))


@query("decision_tallies", "AGG39", f"""WITH d AS ({DEC.replace('{events}', 'events')})
SELECT host, t_ms // 3600000 * 3600000 AS hour_ms, CASE WHEN admit THEN 'admit' ELSE 'deny' END AS verdict, reason, count(*) AS n, count(*) FILTER (current_admit <> admit) AS disagree FROM d GROUP BY 1, 2, 3, 4
UNION ALL SELECT host, NULL, CASE WHEN admit THEN 'admit' ELSE 'deny' END, reason, count(*), count(*) FILTER (current_admit <> admit) FROM d GROUP BY 1, 3, 4
UNION ALL SELECT NULL, NULL, CASE WHEN admit THEN 'admit' ELSE 'deny' END, reason, count(*), count(*) FILTER (current_admit <> admit) FROM d GROUP BY 3, 4""")
def decision_tallies(spark, sf):
    return tel.decision_tallies(_decisions(spark, sf))


@query("decision_compaction", "STR12 P09", f"""WITH RECURSIVE d AS ({DEC.replace('{events}', 'events')}),
s AS (SELECT *, CASE WHEN admit THEN 'admit:' ELSE 'deny:' END || reason AS sg, row_number() OVER (PARTITION BY candidate ORDER BY ord) AS rn FROM d),
f AS (SELECT candidate, rn, ord, t_ms, sg, admit, true AS written, CASE WHEN admit THEN NULL ELSE sg END AS last_sg, t_ms AS last_t FROM s WHERE rn = 1
  UNION ALL SELECT s.candidate, s.rn, s.ord, s.t_ms, s.sg, s.admit, NOT coalesce(f.last_sg = s.sg AND s.t_ms - f.last_t < 60000, false),
    CASE WHEN NOT coalesce(f.last_sg = s.sg AND s.t_ms - f.last_t < 60000, false) THEN CASE WHEN s.admit THEN NULL ELSE s.sg END ELSE f.last_sg END,
    CASE WHEN NOT coalesce(f.last_sg = s.sg AND s.t_ms - f.last_t < 60000, false) THEN s.t_ms ELSE f.last_t END FROM f JOIN s ON s.candidate = f.candidate AND s.rn = f.rn + 1)
SELECT candidate, ord, t_ms, sg AS signature FROM f WHERE written""")
def decision_compaction(spark, sf):
    d = _decisions(spark, sf).select("candidate", "ord", "t_ms", "signature", "admit")
    return tel.compact_decisions(d, ord_slice=SLICE).select("candidate", "ord", "t_ms", "signature")


WAIT = """SELECT user_id AS ticket, event_id AS ord, 1704067200000 + event_id * 5000 AS t_ms, CASE WHEN event_id % 3 < 2 THEN 'cpu' ELSE 'not-head' END AS reason,
  CASE WHEN event_id % 11 < 9 THEN 'over-budget' END AS cause, event_type = 'purchase' AS ended FROM {events}"""


@query("wait_records", "STR13 P08", f"""WITH p AS ({WAIT.replace('{events}', 'events')}),
q AS (SELECT *, NOT ended AND NOT coalesce(NOT lag(ended) OVER w AND lag(reason) OVER w = reason AND lag(cause) OVER w IS NOT DISTINCT FROM cause, false) AS st FROM p WINDOW w AS (PARTITION BY ticket ORDER BY ord)),
r AS (SELECT *, sum(st::INT) OVER (PARTITION BY ticket ORDER BY ord) AS span FROM q)
SELECT ticket, reason, cause, min(t_ms) AS since_ms, max(t_ms) AS last_ms, count(*) AS polls FROM r WHERE NOT ended GROUP BY ticket, span, reason, cause""")
def wait_records(spark, sf):
    return tel.wait_records(spark.sql(WAIT, events=spark.read.parquet(f"{sf}/events.parquet")), ord_slice=SLICE).drop("span")


@query("express_rate", "STR14", oracle(["samples"], """
SELECT host, ord, count(*) OVER w AS in_window, count(*) OVER w >= 3 AS at_limit FROM (SELECT *, 1704067200000 + ord * 4000 AS t2 FROM samples) s WINDOW w AS (PARTITION BY host ORDER BY t2 RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)"""))
def express_rate(spark, sf):
    s = flat(spark, sf, "samples").withColumn("t_ms", F.lit(1704067200000) + F.col("ord") * 4000)
    return tel.express_rate(s, 3).drop("t_ms")


STARVE = """SELECT user_id % 5 AS host, event_id AS ord, 1704067200000 + event_id * 2500 + CASE WHEN event_id % 400 > 380 THEN 0 ELSE 1000 END AS t_ms, event_id % 9 <> 0 AS denied, value / 50.0 AS external_busy, CAST(8 AS DOUBLE) AS budget FROM {events}"""


@query("starvation_episodes", "STR15 P09", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS rn, denied AND external_busy >= 2 AS hit FROM ({STARVE.replace('{events}', 'events').replace('50.0', '50.0::DOUBLE')}) z),
f AS (SELECT host, rn, ord, t_ms, hit, CASE WHEN hit THEN t_ms END AS since, CASE WHEN hit THEN t_ms END AS last_at FROM s WHERE rn = 1
  UNION ALL SELECT s.host, s.rn, s.ord, s.t_ms, s.hit, CASE WHEN NOT s.hit THEN NULL WHEN coalesce(s.t_ms - f.last_at <= 30000, false) THEN f.since ELSE s.t_ms END,
    CASE WHEN NOT s.hit THEN NULL WHEN coalesce(s.t_ms - f.last_at <= 30000, false) AND s.t_ms - f.last_at < 5000 THEN f.last_at ELSE s.t_ms END FROM f JOIN s ON s.host = f.host AND s.rn = f.rn + 1)
SELECT host, since AS since_ms, max(last_at) AS last_ms, count(*) AS denials FROM f WHERE hit GROUP BY 1, 2""")
def starvation_episodes(spark, sf):
    return tel.starvation_episodes(spark.sql(STARVE.replace("50.0", "50.0D"), events=spark.read.parquet(f"{sf}/events.parquet")), ord_slice=SLICE)


@query("sim_armed", "STR19", oracle(["samples"], """
s AS (SELECT *, 1704067200000 + ord * 30000 AS t2, ord % 23 = 0 AS act FROM samples),
w AS (SELECT *, max(CASE WHEN act THEN t2 END) OVER (PARTITION BY host ORDER BY t2 RANGE BETWEEN 300000 PRECEDING AND CURRENT ROW) AS l FROM s)
SELECT host, ord, l IS NOT NULL AS armed, 0.15::DOUBLE * 16 AS test_lock, CASE WHEN l IS NOT NULL THEN 0.3::DOUBLE * 16 ELSE 0 END AS sim_lock FROM w"""))
def sim_armed(spark, sf):
    s = flat(spark, sf, "samples").withColumns({"t_ms": F.lit(1704067200000) + F.col("ord") * 30000, "sim_active": F.col("ord") % 23 == 0})
    return tel.sim_armed(s, 16.0)


LEASES_OF = "SELECT h AS host, 'L' || CAST(g AS STRING) AS lease_id, g AS pgid, CASE WHEN g = 7 THEN CAST(20 AS BIGINT) END AS supervisor_pid FROM (SELECT r_regionkey AS h0 FROM {region}) r JOIN (SELECT 3 AS g UNION ALL SELECT 7 UNION ALL SELECT 11) gs ON true JOIN (SELECT CAST(0 AS BIGINT) AS h UNION ALL SELECT 1 UNION ALL SELECT 2) hs ON hs.h = r.h0"
TREE_SQL = DELTAS_SQL + f""",
lease AS ({LEASES_OF.replace('{region}', 'region')}),
tag AS (SELECT p.host, p.snapshot_ms, p.pid, p.ppid, l.lease_id, s.supervisor_pid IS NOT NULL AS sup FROM procs p LEFT JOIN lease l ON l.host = p.host AND l.pgid = p.pgid LEFT JOIN lease s ON s.host = p.host AND s.supervisor_pid = p.pid),
mem AS (SELECT host, snapshot_ms, pid, lease_id FROM tag WHERE lease_id IS NOT NULL AND NOT sup
  UNION ALL SELECT t.host, t.snapshot_ms, t.pid, m.lease_id FROM mem m JOIN tag t ON t.host = m.host AND t.snapshot_ms = m.snapshot_ms AND t.ppid = m.pid AND t.lease_id IS NULL AND NOT t.sup)"""


def _rec(body: str) -> str:
    return oracle(["procs"], body).replace("WITH ", "WITH RECURSIVE ", 1)


def _tree(spark, sf):
    procs = flat(spark, sf, "procs")
    leases = spark.sql(LEASES_OF, region=spark.read.parquet(f"{sf}/region.parquet"))
    return procs, leases, tel.lease_members(procs, leases)


@query("lease_tree_usage", "HIE01", _rec(TREE_SQL + """
SELECT m.host, m.snapshot_ms, lease_id, round(sum(greatest(0, pcpu)) / 100, 6) AS cores, CAST(sum(greatest(0, rss_kib)) * 1024 AS BIGINT) AS memory_bytes, count(*) AS processes
FROM mem m JOIN procs p ON p.host = m.host AND p.snapshot_ms = m.snapshot_ms AND p.pid = m.pid GROUP BY 1, 2, 3"""))
def lease_tree_usage(spark, sf):
    procs, _, members = _tree(spark, sf)
    return tel.lease_tree_usage(procs, members).withColumn("cores", F.round("cores", 6))


@query("top_external_trees", "HIE02 ORD01", _rec(TREE_SQL + """,
d2 AS (SELECT d.*, m.pid IS NOT NULL OR l.supervisor_pid IS NOT NULL AS excluded, d.pid = 2 OR d.ppid = 2 AS kernel,
   regexp_replace(regexp_replace(split_part(d.command, ' ', 1), '^.*/', ''), '^-', '') IN ('launchd','init','systemd','sh','bash','zsh','fish','dash','ksh','tcsh','login','sshd','tmux','screen','Terminal','iTerm2','su','sudo') AS shell
  FROM delta d LEFT JOIN mem m ON m.host = d.host AND m.snapshot_ms = d.snapshot_ms AND m.pid = d.pid LEFT JOIN lease l ON l.host = d.host AND l.supervisor_pid = d.pid),
clm AS (SELECT host, snapshot_ms, pid, pid AS att, ppid, delta_sec, window_ms, 0 AS depth FROM d2 WHERE delta_sec > 0 AND NOT excluded AND NOT kernel
  UNION ALL SELECT c.host, c.snapshot_ms, c.pid, q.pid, q.ppid, c.delta_sec, c.window_ms, c.depth + 1 FROM clm c JOIN d2 q ON q.host = c.host AND q.snapshot_ms = c.snapshot_ms AND q.pid = c.ppid
    WHERE NOT q.excluded AND NOT q.kernel AND q.pid > 1 AND NOT q.shell AND c.depth < 63),
rt AS (SELECT host, snapshot_ms, pid, arg_max(att, depth) AS root, max(delta_sec) AS delta_sec, max(window_ms) AS window_ms FROM clm GROUP BY 1, 2, 3),
gr AS (SELECT host, snapshot_ms, root, sum(delta_sec) / (max(window_ms) / 1000) AS cores FROM rt GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY host, snapshot_ms ORDER BY cores DESC, root) AS rn FROM gr WHERE cores >= 0.05)
SELECT host, snapshot_ms, root AS pid, round(cores, 2) AS cores FROM rk WHERE rn <= 5"""))
def top_external_trees(spark, sf):
    procs, leases, members = _tree(spark, sf)
    return tel.top_external(tel.process_deltas(procs), members, leases)


EXT_SQL = TREE_SQL + """,
pre AS (SELECT d.host, d.snapshot_ms, sum(delta_sec) / (max(window_ms) / 1000) AS preemptible_cores FROM delta d WHERE nice > 5 AND nice >= 8 AND delta_sec > 0
  AND NOT EXISTS (SELECT 1 FROM mem m WHERE m.host = d.host AND m.snapshot_ms = d.snapshot_ms AND m.pid = d.pid) GROUP BY 1, 2)"""


@query("preemptible_cores", "HIE03", _rec(EXT_SQL + "\nSELECT host, snapshot_ms, round(preemptible_cores, 6) AS preemptible_cores FROM pre"))
def preemptible_cores(spark, sf):
    procs, _, members = _tree(spark, sf)
    return tel.preemptible_cores(tel.process_deltas(procs), members, 5, 8).withColumn("preemptible_cores", F.round("preemptible_cores", 6))




def _hosts(spark, sf):
    h = flat(spark, sf, "samples").join(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("ord"), "event_type", "value", "user_id"), "ord")
    return h.selectExpr("host", "t_ms + 20000 AS snapshot_ms", "value / 10 AS busy_cores", "CAST(24 + user_id % 5 * 8 AS DOUBLE) AS cores")


HOST_SQL = """
hs AS (SELECT e.user_id % 5 AS host, s.t_ms + 20000 AS snapshot_ms, e.value / 10 AS busy_cores, CAST(24 + e.user_id % 5 * 8 AS DOUBLE) AS cores FROM samples s JOIN events e ON e.event_id = s.ord),
rd AS (SELECT user_id % 5 AS host, user_id AS lease_id, epoch_us(ts) // 1000 AS t_ms, value / 20 AS cores FROM events),
pr AS (SELECT host, snapshot_ms, busy_cores / 4 AS preemptible_cores FROM hs),
ob AS (SELECT h.host, h.snapshot_ms, r.lease_id, arg_max(r.cores, r.t_ms) AS c FROM hs h JOIN rd r ON r.host = h.host AND r.t_ms <= h.snapshot_ms AND h.snapshot_ms - r.t_ms <= 30000 WHERE r.cores >= 0 GROUP BY 1, 2, 3),
os AS (SELECT host, snapshot_ms, sum(c) AS leased FROM ob GROUP BY 1, 2),
ext AS (SELECT h.host, h.snapshot_ms, h.cores, greatest(0, greatest(0, busy_cores - 0.8::DOUBLE * least(greatest(0, preemptible_cores), busy_cores)) - coalesce(leased, 0)) AS external_busy FROM hs h JOIN pr ON pr.host = h.host AND pr.snapshot_ms = h.snapshot_ms LEFT JOIN os ON os.host = h.host AND os.snapshot_ms = h.snapshot_ms)"""


def _external(spark, sf):
    hosts = _hosts(spark, sf)
    readings = flat(spark, sf, "samples").join(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("ord"), "user_id", "value"), "ord").selectExpr(
        "host", "user_id AS lease_id", "t_ms", "value / 20 AS cores")
    pre = hosts.selectExpr("host", "snapshot_ms", "busy_cores / 4 AS preemptible_cores")
    return hosts, tel.external_busy(hosts.select("host", "snapshot_ms", "busy_cores"), readings, pre, 0.8)


@query("external_busy", "HIE04", oracle(["samples"], HOST_SQL + "\nSELECT host, snapshot_ms, round(external_busy, 6) AS external_busy FROM ext"))
def external_busy(spark, sf):
    return _external(spark, sf)[1].withColumn("external_busy", F.round("external_busy", 6))


@query("cpu_projection", "AGG43 SCL19", oracle(["samples"], HOST_SQL + """,
ch AS (SELECT h.host, h.snapshot_ms, sum(CASE WHEN k % 2 = 0 THEN k * (1 - 0.8::DOUBLE) ELSE k END) AS charged FROM hs h, (SELECT unnest([1, 2, 3]) AS k) z GROUP BY 1, 2)
SELECT e.host, e.snapshot_ms, round(external_busy + charged, 6) AS projected_cores, round(least(0.85::DOUBLE * cores, cores - 2), 6) AS budget, round(greatest(0, least(0.85::DOUBLE * cores, cores - 2) - (external_busy + charged)), 6) AS headroom
FROM ext e JOIN ch ON ch.host = e.host AND ch.snapshot_ms = e.snapshot_ms"""))
def cpu_projection(spark, sf):
    hosts, ext = _external(spark, sf)
    charges = hosts.select("host", "snapshot_ms", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("demand")).withColumn("outranked", F.col("demand") == 2)
    out = tel.cpu_projection(ext, charges, hosts.select("host", "snapshot_ms", "cores"), percent=85.0, reserve=2.0, share=0.8)
    return out.withColumns({c: F.round(c, 6) for c in ("projected_cores", "budget", "headroom")})


@query("idle_credit", "STR20", oracle(["samples", "heartbeats", "leases"], """
l AS (SELECT lease_id % 5 AS host, t_ms - t_ms % 3600000 AS snapshot_ms, charged_cores * 4 AS grt, interval_cores, CASE WHEN ord % 2 = 0 THEN cores END AS oc, ord % 400 * 1000 AS idle_ms, CASE WHEN ord % 3 = 0 THEN 0.25::DOUBLE END AS fl, charged_cores * 3 AS demand FROM heartbeats h JOIN leases z USING (lease_id)),
c AS (SELECT *, CASE WHEN coalesce(interval_cores < 0.3::DOUBLE * grt AND idle_ms >= 100000, false) THEN greatest(0, least(grt, demand) - greatest(coalesce(oc, interval_cores), interval_cores, coalesce(fl, 0))) ELSE 0 END AS credit FROM l)
SELECT host, snapshot_ms, count(*) FILTER (credit > 0) AS leases, round(least(sum(credit), greatest(0, 24 - least(85.0::DOUBLE / 100 * 24, 22))), 6) AS credit_cores FROM c GROUP BY 1, 2"""))
def idle_credit(spark, sf):
    h = flat(spark, sf, "heartbeats").join(flat(spark, sf, "leases"), "lease_id").selectExpr(
        "lease_id % 5 AS host", "t_ms - t_ms % 3600000 AS snapshot_ms", "lease_id", "charged_cores * 4 AS grant", "interval_cores", "if(ord % 2 = 0, cores, NULL) AS observed_cores",
        "ord % 400 * 1000 AS idle_ms", "if(ord % 3 = 0, 0.25D, NULL) AS floor_cores", "charged_cores * 3 AS demand")
    hosts = h.select("host", "snapshot_ms").distinct().withColumn("cores", F.lit(24.0))
    return tel.idle_credit(h, hosts, percent=85.0, reserve=2.0, below_fraction=0.3, after_ms=100_000).withColumn("credit_cores", F.round("credit_cores", 6))
