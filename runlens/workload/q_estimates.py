"""Duration, CPU and speed estimates over the derived history."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import runs
from runlens.plans import estimates
from runlens.session import cut_lineage
from runlens.workload.q_scalars import CLASSIFIED, COMMAND_CTES
from runlens.workload.registry import query
from runlens.workload.views import history, oracle

NOW = 1_000_000_000_000.0
WIDE = 2500 * 86_400_000.0
LOG_FOLD = """list_reduce(list({{'l': {l}, 'c': {c}}} ORDER BY {t}, ord), lambda a, x: CASE WHEN a.n = 0 THEN {{'n': 1::BIGINT, 'cn': x.c::BIGINT, 'mu': x.l, 'v': 0.36::DOUBLE}}
  WHEN x.c THEN {{'n': a.n + 1, 'cn': a.cn + 1, 'mu': greatest(a.mu, x.l), 'v': a.v}}
  ELSE {{'n': a.n + 1, 'cn': a.cn, 'mu': a.mu + 0.1::DOUBLE * greatest(ln(0.2::DOUBLE), least(ln(5::DOUBLE), x.l - a.mu)),
    'v': 0.9::DOUBLE * (a.v + 0.1::DOUBLE * power(greatest(ln(0.2::DOUBLE), least(ln(5::DOUBLE), x.l - a.mu)), 2))}} END, {{'n': 0::BIGINT, 'cn': 0::BIGINT, 'mu': 0::DOUBLE, 'v': 0::DOUBLE}})"""
WALL_FOLD = LOG_FOLD.format(l="ln(wall_s)", c="kind = 'censored'", t="coalesce(ended_at, 0)")
R1 = "floor(({}) * 10 + 0.5) / 10"


@query("duration_backfill", "AGG12 P09 SCL04 SCL05", oracle(["history"], CLASSIFIED + f""",
f AS (SELECT repo, lane, work_class, {WALL_FOLD} AS s, quantile_disc(rss_peak, 0.9) AS rss_p90_bytes FROM kinds WHERE kind <> 'ignored' GROUP BY 1, 2, 3)
SELECT repo, lane, work_class, s.n AS n, s.cn AS censored, {R1.format('exp(s.mu)')} AS p50, {R1.format('exp(s.mu + 1.28::DOUBLE * sqrt(s.v))')} AS p90, rss_p90_bytes, 'exact' AS est_source FROM f"""))
def duration_backfill(spark, sf):
    return estimates.backfill_report(history(spark, sf))


@query("duration_skipped_rows", "AGG12", oracle(["history"], CLASSIFIED + "\nSELECT why, count(*) AS n FROM kinds WHERE kind = 'ignored' GROUP BY 1"))
def duration_skipped_rows(spark, sf):
    return estimates.skipped_by_reason(history(spark, sf))


_PARTS_SQL = """repo || ':' || lane AS template, work_class AS class_id, coalesce(executor, '') AS through_act, 'a' || (cust % 3)::VARCHAR AS arm_set,
  CASE WHEN cust % 7 <> 0 THEN 'f' || (cust % 5)::VARCHAR ELSE '' END AS code_family"""
OBS_SQL = CLASSIFIED + f""",
obs AS (SELECT {_PARTS_SQL}, wall_s AS ref_s, kind = 'censored' AS censored, coalesce(ended_at, 0) AS t, ord FROM kinds WHERE kind <> 'ignored'),
lv AS (SELECT unnest([0, 1, 2, 3, 4]) AS level),
keyed AS (SELECT level, template, CASE WHEN level < 4 THEN class_id ELSE '' END AS class_id, CASE WHEN level < 3 THEN through_act ELSE '' END AS through_act,
   CASE WHEN level < 2 THEN arm_set ELSE '' END AS arm_set, CASE WHEN level < 1 THEN code_family ELSE '' END AS code_family, ref_s, censored, t, ord FROM obs, lv),
st AS (SELECT level, template, class_id, through_act, arm_set, code_family, {LOG_FOLD.format(l='ln(ref_s)', c='censored', t='t')} AS s FROM keyed GROUP BY ALL)"""


def _observations(spark, sf):
    h = history(spark, sf).withColumn("c", runs.classify()).filter("c.kind <> 'ignored'")
    return h.select(
        F.concat("repo", F.lit(":"), "lane").alias("template"), runs.work_class().alias("class_id"), F.coalesce("executor", F.lit("")).alias("through_act"),
        F.concat(F.lit("a"), (F.col("cust") % 3).cast("string")).alias("arm_set"),
        F.when(F.col("cust") % 7 != 0, F.concat(F.lit("f"), (F.col("cust") % 5).cast("string"))).alias("code_family"),
        F.col("c.wallS").alias("ref_s"), (F.col("c.kind") == "censored").alias("censored"), F.coalesce("endedAt", F.lit(0.0)).alias("t"), "ord")


@query("duration_estimator_levels", "AGG11 P09", oracle(["history"], OBS_SQL + """
SELECT level, template, class_id, through_act, arm_set, code_family, s.n AS n, s.cn AS censored_n, round(exp(s.mu), 5) AS p50, round(exp(s.mu + 1.28::DOUBLE * sqrt(s.v)), 5) AS p90 FROM st"""))
def duration_estimator_levels(spark, sf):
    # keys above 300 rows take the path of hot keys, cut into slices of 90 days
    s = estimates.fold_durations(_observations(spark, sf), slice_ms=90 * 86_400_000.0, hot_rows=300)
    return s.select("level", *estimates.PARTS, "n", "censored_n", F.round(F.exp("state"), 5).alias("p50"), F.round(estimates.p90_of(F.col("state"), F.col("variance")), 5).alias("p90"))


@query("duration_answers", "AGG13 AGG41 P10", oracle(["history", "parents"], OBS_SQL + """,
p75 AS (SELECT class_id, quantile_disc(ref_s, 0.75) AS class_p75 FROM obs WHERE NOT censored GROUP BY 1),
jobs AS (SELECT parent_id AS job, CASE parent_id % 4 WHEN 0 THEN '_home_proj_foo_.git:unit' WHEN 1 THEN '_home_proj_bar_.git:train' WHEN 2 THEN '_home_proj_foo_.git:adhoc' || (parent_id % 60)::VARCHAR ELSE 'none' END AS template,
  CASE parent_id % 5 WHEN 0 THEN 'sim' ELSE 'test' END AS class_id, CASE parent_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'x' END AS through_act,
  'a' || (parent_id % 4)::VARCHAR AS arm_set, 'f' || (parent_id % 6)::VARCHAR AS code_family, CASE WHEN parent_id % 8 = 3 THEN 5000.0::DOUBLE END AS hint_p50 FROM parents),
m AS (SELECT j.*, st.level AS lv, st.s AS s, row_number() OVER (PARTITION BY job ORDER BY st.level NULLS LAST) AS rn FROM jobs j LEFT JOIN st ON st.template = j.template
  AND (st.level = 4 OR (st.class_id = j.class_id AND (st.level = 3 OR (st.through_act = j.through_act AND (st.level = 2 OR (st.arm_set = j.arm_set AND (st.level = 1 OR st.code_family = j.code_family))))))))
SELECT job, round(coalesce(exp(s.mu), greatest(class_p75, coalesce(hint_p50, 0))), 5) AS est_p50_s,
  round(coalesce(exp(s.mu + 1.28::DOUBLE * sqrt(s.v) * power(1.5::DOUBLE, lv)), 2 * greatest(class_p75, coalesce(hint_p50, 0))), 4) AS est_p90_s,
  CASE lv WHEN 0 THEN 'exact' WHEN 1 THEN 'no-code-family' WHEN 2 THEN 'no-arm-set' WHEN 3 THEN 'no-through-act' WHEN 4 THEN 'runner-wide' ELSE 'class-default' END AS est_source
FROM m LEFT JOIN p75 ON p75.class_id = m.class_id WHERE rn = 1"""))
def duration_answers(spark, sf):
    obs = cut_lineage(_observations(spark, sf), "duration-observations")  # read by the estimator and by the classes' percentiles
    k = F.col("c_custkey")
    s = lambda e: e.cast("string")
    jobs = spark.read.parquet(f"{sf}/customer.parquet").select(
        k.alias("job"),
        F.when(k % 4 == 0, "_home_proj_foo_.git:unit").when(k % 4 == 1, "_home_proj_bar_.git:train")
        .when(k % 4 == 2, F.concat(F.lit("_home_proj_foo_.git:adhoc"), s(k % 60))).otherwise("none").alias("template"),
        F.when(k % 5 == 0, "sim").otherwise("test").alias("class_id"), F.when(k % 3 == 0, "local").when(k % 3 == 1, "remote").otherwise("x").alias("through_act"),
        F.concat(F.lit("a"), s(k % 4)).alias("arm_set"), F.concat(F.lit("f"), s(k % 6)).alias("code_family"),
        F.when(k % 8 == 3, 5000.0).alias("hint_p50"), F.lit(None).cast("double").alias("hint_p90"))
    a = estimates.answer_estimates(jobs, estimates.fold_durations(obs), estimates.class_p75(obs))
    return a.select("job", F.round("est_p50_s", 5).alias("est_p50_s"), F.round("est_p90_s", 4).alias("est_p90_s"), "est_source")


FACTOR_SQL = CLASSIFIED + """,
fin AS (SELECT runner AS host, work_class AS class, predicted_run_ms / 1000 AS est, run_ms / 1000 AS wall, signal IS NOT NULL AS censored, coalesce(started_at, 0) AS t, ord,
    CASE WHEN predicted_run_ms / 1000 < 120 THEN 'short' WHEN predicted_run_ms / 1000 <= 600 THEN 'medium' ELSE 'long' END AS bucket
  FROM kinds WHERE runner IS NOT NULL AND placed_runner IS NOT NULL AND predicted_run_ms > 0 AND run_ms > 0),
ff AS (SELECT host, class, bucket, list_reduce(list({'o': wall / est, 'c': censored} ORDER BY t, ord), lambda a, x:
    CASE WHEN a.n = 0 THEN {'n': 1::BIGINT, 'f': CASE WHEN x.c THEN greatest(1, x.o) ELSE x.o END} WHEN x.c THEN {'n': a.n + 1, 'f': greatest(a.f, x.o)}
    ELSE {'n': a.n + 1, 'f': a.f + 0.1::DOUBLE * (greatest(a.f * 0.2::DOUBLE, least(a.f * 5, x.o)) - a.f)} END, {'n': 0::BIGINT, 'f': 0::DOUBLE}) AS s FROM fin WHERE host <> 'r0' GROUP BY ALL),
cells AS (SELECT host, class, bucket, s.f AS factor, s.n AS n FROM ff)"""


def _factors(spark, sf):
    h = history(spark, sf).filter("runner IS NOT NULL AND placement IS NOT NULL").select(
        F.col("runner").alias("host"), runs.work_class().alias("class"), (F.col("placement.predictedRunMs") / 1000).alias("est_ref_s"),
        (F.col("runMs") / 1000).alias("wall_s"), F.col("signal").isNotNull().alias("censored"), F.coalesce("startedAt", F.lit(0.0)).alias("t"), "ord")
    return estimates.host_factors(h, "r0")


@query("host_speed_factors", "AGG14 P09", oracle(["history"], FACTOR_SQL + "\nSELECT host, class, bucket, round(factor, 6) AS factor, n FROM cells"))
def host_speed_factors(spark, sf):
    return _factors(spark, sf).withColumn("factor", F.round("factor", 6))


@query("anchor_rebase", "AGG15", oracle(["history"], FACTOR_SQL + """,
rk AS (SELECT host, exp(avg(ln(factor))) AS r FROM cells WHERE host <> 'r0' GROUP BY 1),
pick AS (SELECT host FROM (SELECT host, row_number() OVER (ORDER BY r, host) AS rn, count(*) OVER () AS c FROM rk) x WHERE rn = (c - 1) // 2 + 1),
own AS (SELECT class, bucket, factor AS scale FROM cells WHERE host IN (SELECT host FROM pick)),
hs AS (SELECT DISTINCT host FROM cells UNION SELECT 'r0'),
moved AS (SELECT h.host, o.class, o.bucket, coalesce(c.factor, 1) / o.scale AS factor, coalesce(c.n, 0) AS n FROM hs h, own o LEFT JOIN cells c ON c.host = h.host AND c.class = o.class AND c.bucket = o.bucket
  WHERE h.host NOT IN (SELECT host FROM pick)),
rest AS (SELECT c.* FROM cells c WHERE c.host NOT IN (SELECT host FROM pick) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.class = c.class AND o.bucket = c.bucket))
SELECT 'cell' AS part, host, class, bucket, round(factor, 6) AS factor, n FROM (SELECT * FROM moved UNION ALL SELECT * FROM rest) z
UNION ALL SELECT 'scale', (SELECT host FROM pick), class, bucket, round(scale, 6), NULL FROM own"""))
def anchor_rebase(spark, sf):
    calibrated = spark.read.parquet(f"{sf}/region.parquet").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("host"),
        (F.lit(NOW) - F.when(F.col("r_regionkey") == 0, 40.0).otherwise(3.0) * 86_400_000.0).alias("calibrated_at"))
    cells, scales, _ = estimates.rebase_anchor(_factors(spark, sf), calibrated, "r0", NOW)
    a = cells.select(F.lit("cell").alias("part"), "host", "class", "bucket", F.round("factor", 6).alias("factor"), "n")
    b = scales.select(F.lit("scale").alias("part"), F.col("new_anchor").alias("host"), "class", "bucket", F.round("scale", 6).alias("factor"), F.lit(None).cast("long").alias("n"))
    return a.unionByName(b)


STATES = "SELECT o_orderkey AS template, CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'sim' END AS class_id, 30.25 + o_orderkey % 2000 AS p50 FROM"
SCALES = [("test", "short", 0.5), ("test", "long", 2.0), ("sim", "medium", 1.5)]


@query("rescaled_states", "AGG15", f"""WITH s AS ({STATES} orders), k AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{b}', {x}::DOUBLE)" for c, b, x in SCALES)}) v(class, bucket, scale))
SELECT template, class_id, round(p50 * coalesce(scale, 1), 6)::DOUBLE AS p50 FROM s LEFT JOIN k ON class = class_id AND bucket = CASE WHEN p50 < 120 THEN 'short' WHEN p50 <= 600 THEN 'medium' ELSE 'long' END""")
def rescaled_states(spark, sf):
    states = spark.sql(STATES + " {orders}", orders=spark.read.parquet(f"{sf}/orders.parquet")).withColumn("state", F.ln(F.col("p50").cast("double"))).drop("p50")
    scales = spark.createDataFrame(SCALES, "class string, bucket string, scale double")
    return estimates.rescale_states(states, scales).select("template", "class_id", F.round(F.exp("state"), 6).alias("p50"))


DEMAND_SQL = CLASSIFIED + f""",
u AS (SELECT *, repo || ':' || lane AS key FROM kinds WHERE kind = 'completed' AND coalesce(executor, 'local') = 'local' AND res_cpu IS NOT NULL AND coalesce(granted, res_cpu) = res_cpu
  AND obs_peak >= 0 AND cmd_fp IS NOT NULL AND {NOW:.0f} - ended_at <= {WIDE:.0f}),
x AS (SELECT 'exact' AS level, key AS workload, cmd_fp AS fingerprint, res_cpu AS cores, ended_at, ord, obs_peak FROM u
  UNION ALL SELECT 'configLane', repo || ':' || coalesce(config_lane, lane), cmd_fp, res_cpu, ended_at, ord, obs_peak FROM u),
rk AS (SELECT *, row_number() OVER (PARTITION BY level, workload, fingerprint, cores ORDER BY ended_at DESC, ord DESC) AS rn FROM x),
dem AS (SELECT level, workload, fingerprint, cores, quantile_disc(obs_peak, 0.9) AS p90, count(*) AS n FROM rk WHERE rn <= 50 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)"""


@query("cpu_demand", "AGG16 P06", oracle(["history"], DEMAND_SQL + "\nSELECT * FROM dem"))
def cpu_demand(spark, sf):
    return estimates.cpu_demand(history(spark, sf), NOW, window_ms=WIDE)


@query("cpu_charges", "JON09 SCL24", oracle(["history", "parents"], DEMAND_SQL + """,
q AS (SELECT parent_id AS req, '_home_proj_' || CASE parent_id % 2 WHEN 0 THEN 'foo' ELSE 'bar' END || '_.git:' || CASE parent_id % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'train' ELSE 'adhoc' || (parent_id % 40)::VARCHAR END AS key,
  CASE WHEN parent_id % 3 = 2 THEN 'e2e' END AS config_lane, 'f' || (parent_id % 10)::VARCHAR AS fingerprint, (1 + parent_id % 8)::DOUBLE AS declared, CASE WHEN parent_id % 2 = 0 THEN 6.0::DOUBLE END AS budget FROM parents),
m AS (SELECT q.*, coalesce(a.p90, b.p90) AS p90, CASE WHEN a.p90 IS NOT NULL THEN 'exact' WHEN b.p90 IS NOT NULL THEN 'configLane' END AS lvl FROM q
  LEFT JOIN dem a ON a.level = 'exact' AND a.workload = q.key AND a.fingerprint = q.fingerprint AND a.cores = q.declared
  LEFT JOIN dem b ON b.level = 'configLane' AND b.workload = split_part(q.key, ':', 1) || ':' || coalesce(q.config_lane, split_part(q.key, ':', 2)) AND b.fingerprint = q.fingerprint AND b.cores = q.declared)
SELECT req, CASE WHEN p90 IS NULL THEN declared WHEN budget IS NOT NULL AND p90 > declared THEN least(budget, greatest(0.5::DOUBLE, p90)) ELSE least(declared, greatest(0.5::DOUBLE, p90)) END AS charge,
  CASE WHEN p90 IS NULL THEN 'declared' WHEN budget IS NOT NULL AND p90 > declared THEN 'history:raised' ELSE 'history:' || lvl END AS source FROM m"""))
def cpu_charges(spark, sf):
    q = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS req", "concat('_home_proj_', if(c_custkey % 2 = 0, 'foo', 'bar'), '_.git:', CASE c_custkey % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'train' ELSE concat('adhoc', c_custkey % 40) END) AS key",
        "if(c_custkey % 3 = 2, 'e2e', NULL) AS config_lane", "concat('f', c_custkey % 10) AS fingerprint", "CAST(1 + c_custkey % 8 AS DOUBLE) AS declared", "if(c_custkey % 2 = 0, 6.0D, NULL) AS budget")
    return estimates.charge_requests(q, estimates.cpu_demand(history(spark, sf), NOW, window_ms=WIDE)).select("req", "charge", "source")


@query("cpu_right_size", "AGG17 P06", oracle(["history"], CLASSIFIED + f""",
x AS (SELECT *, coalesce(config_lane, lane) AS name, row_number() OVER (PARTITION BY repo, coalesce(config_lane, lane) ORDER BY ended_at DESC, ord DESC) AS rn FROM kinds WHERE {NOW:.0f} - ended_at <= {WIDE:.0f}),
y AS (SELECT *, CASE WHEN kind <> 'ignored' AND obs_samples >= 3 AND obs_mean >= 0 THEN CASE WHEN granted > 0 AND res_cpu IS NOT NULL THEN obs_mean / granted * res_cpu ELSE obs_mean END END AS need FROM x WHERE rn <= 50),
z AS (SELECT repo, name, count(need) AS runs, quantile_disc(need, 0.9) AS p90, arg_max(CASE WHEN res_cpu IS NULL THEN -1 ELSE res_cpu END, (ended_at, ord)) AS declared FROM y GROUP BY 1, 2)
SELECT repo, name AS lane, runs, nullif(declared, -1) AS declared, least(coalesce(nullif(declared, -1), 1e18), greatest(1.0::DOUBLE, ceil(p90 * 1.2::DOUBLE - 1e-9::DOUBLE))) AS cpu_cores FROM z WHERE runs >= 5"""))
def cpu_right_size(spark, sf):
    return estimates.right_sized(history(spark, sf), NOW, window_ms=WIDE)


EXPRESS_SQL = CLASSIFIED + f""",
loc AS (SELECT * FROM kinds WHERE coalesce(executor, 'local') = 'local'),
ks AS (SELECT *, NULL AS fp FROM loc UNION ALL SELECT *, cmd_fp FROM loc WHERE cmd_fp IS NOT NULL),
first_class AS (SELECT repo, lane, fp, arg_min(work_class, (coalesce(ended_at, 0), ord)) AS wc FROM ks WHERE kind <> 'ignored' GROUP BY 1, 2, 3),
fold AS (SELECT repo, lane, fp, work_class, {WALL_FOLD} AS s FROM ks WHERE kind <> 'ignored' GROUP BY 1, 2, 3, 4),
express AS (SELECT f.repo, f.lane, f.fp AS fingerprint, floor(({R1.format('exp(s.mu)')}) * 1000 + 0.5)::BIGINT AS p50_ms, s.n AS n FROM fold f JOIN first_class c ON c.repo = f.repo AND c.lane = f.lane
  AND c.fp IS NOT DISTINCT FROM f.fp AND c.wc = f.work_class WHERE s.n >= 3)"""


@query("express_table", "AGG18", oracle(["history"], EXPRESS_SQL + "\nSELECT * FROM express"))
def express_table(spark, sf):
    return estimates.express_table(history(spark, sf))


BYPASS_SQL = COMMAND_CTES + """,
jk AS (SELECT c.*, k.kind AS outcome FROM cmds c JOIN kinds k ON k.ord = c.ord),
strt AS (SELECT *, CASE WHEN run_ms > 0 THEN run_ms ELSE ended_at - started_at END AS rms FROM jk WHERE coalesce(executor, 'local') = 'local' AND started_at IS NOT NULL),
ids AS (SELECT repo, lane, 'command' AS kind, cmd_fp AS name, ord, coalesce(ended_at, 0) AS t, rms, outcome FROM strt WHERE rms > 0 AND cmd_fp IS NOT NULL
  UNION ALL SELECT repo, lane, 'family', family, ord, coalesce(ended_at, 0), rms, outcome FROM strt WHERE rms > 0 AND family <> ''),
gd AS (SELECT repo, lane, kind, name, count(*) AS n, floor(quantile_disc(rms, 0.5) + 0.5)::BIGINT AS median_ms FROM (SELECT *, row_number() OVER (PARTITION BY repo, lane, kind, name ORDER BY t DESC, ord DESC) AS rn FROM ids WHERE outcome = 'completed') a WHERE rn <= 20 GROUP BY 1, 2, 3, 4),
sk AS (SELECT repo, lane, kind, name, count(*) FILTER (rms > 1800000) AS strikes FROM (SELECT *, row_number() OVER (PARTITION BY repo, lane, kind, name ORDER BY t DESC, ord DESC) AS rn FROM ids) a WHERE rn <= 20 GROUP BY 1, 2, 3, 4),
byp AS (SELECT g.*, s.strikes FROM gd g JOIN sk s ON s.repo = g.repo AND s.lane = g.lane AND s.kind = g.kind AND s.name = g.name WHERE n >= 3)"""


@query("bypass_table", "AGG19 SCL07 P06", oracle(["history"], CLASSIFIED + "," + BYPASS_SQL + "\nSELECT * FROM byp"))
def bypass_table(spark, sf):
    return estimates.bypass_table(history(spark, sf), 1_800_000.0)


TICKET_SQL = """
tk AS (SELECT parent_id AS ticket, '_home_proj_' || CASE parent_id % 2 WHEN 0 THEN 'foo' ELSE 'bar' END || '_.git' AS repo, CASE parent_id % 4 WHEN 0 THEN 'unit' WHEN 1 THEN 'train' WHEN 2 THEN 'prepush' ELSE 'nolane' END AS lane,
  CASE WHEN parent_id % 3 <> 0 THEN 'f' || (parent_id % 13)::VARCHAR END AS fingerprint, CASE WHEN parent_id % 5 = 0 THEN 'cargo test --release x' ELSE 'timeout 600 make check' END AS command FROM parents)"""


def _tickets(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS ticket", "concat('_home_proj_', if(c_custkey % 2 = 0, 'foo', 'bar'), '_.git') AS repo", "CASE c_custkey % 4 WHEN 0 THEN 'unit' WHEN 1 THEN 'train' WHEN 2 THEN 'prepush' ELSE 'nolane' END AS lane",
        "if(c_custkey % 3 <> 0, concat('f', c_custkey % 13), NULL) AS fingerprint", "if(c_custkey % 5 = 0, 'cargo test --release x', 'timeout 600 make check') AS command")


@query("express_verdicts", "AGG20 P10", oracle(["history", "parents"], EXPRESS_SQL + "," + TICKET_SQL + """
SELECT ticket, coalesce(a.p50_ms, b.p50_ms) AS expected_ms, CASE WHEN a.p50_ms IS NOT NULL THEN 'command' WHEN b.p50_ms IS NOT NULL THEN 'lane' END AS source, coalesce(coalesce(a.p50_ms, b.p50_ms) < 1600000, false) AS express
FROM tk LEFT JOIN express a ON a.repo = tk.repo AND a.lane = tk.lane AND a.fingerprint = tk.fingerprint LEFT JOIN express b ON b.repo = tk.repo AND b.lane = tk.lane AND b.fingerprint IS NULL"""))
def express_verdicts(spark, sf):
    return estimates.express_verdicts(_tickets(spark, sf), estimates.express_table(history(spark, sf)), 1_600_000.0).select("ticket", "expected_ms", "source", "express")


@query("bypass_verdicts", "AGG20", oracle(["history", "parents"], CLASSIFIED + "," + BYPASS_SQL + "," + TICKET_SQL + """,
m AS (SELECT ticket, coalesce(a.median_ms, b.median_ms) AS ms, CASE WHEN a.n IS NOT NULL THEN a.strikes ELSE b.strikes END AS strikes, CASE WHEN a.n IS NOT NULL THEN 'command' ELSE 'family' END AS src
  FROM tk LEFT JOIN byp a ON a.repo = tk.repo AND a.lane = tk.lane AND a.kind = 'command' AND a.name = tk.fingerprint
  LEFT JOIN byp b ON b.repo = tk.repo AND b.lane = tk.lane AND b.kind = 'family' AND b.name = CASE WHEN ticket % 5 = 0 THEN 'cargo test x' ELSE 'timeout 600 make' END),
v AS (SELECT *, CASE WHEN ms IS NULL THEN 'no-history' WHEN ms >= 1800000 THEN 'median-over-max' WHEN strikes > 3 THEN 'too-many-strikes' END AS refused FROM m)
SELECT ticket, refused, CASE WHEN refused IS NULL THEN ms END AS expected_ms, CASE WHEN refused IS NULL THEN src END AS source FROM v"""))
def bypass_verdicts(spark, sf):
    return estimates.bypass_verdicts(_tickets(spark, sf), estimates.bypass_table(history(spark, sf), 1_800_000.0), 1_800_000.0).select("ticket", "refused", "expected_ms", "source")


@query("expected_run", "AGG26", oracle(["history"], CLASSIFIED + f""",
fc AS (SELECT repo, lane, arg_min(work_class, (coalesce(ended_at, 0), ord)) AS wc FROM kinds WHERE kind <> 'ignored' GROUP BY 1, 2),
f AS (SELECT repo, lane, work_class, {WALL_FOLD} AS s FROM kinds WHERE kind <> 'ignored' GROUP BY 1, 2, 3)
SELECT f.repo, f.lane, floor(({R1.format('exp(s.mu + 1.28::DOUBLE * sqrt(s.v))')}) * 1000 + 0.5)::BIGINT AS expected_ms, s.n AS n FROM f JOIN fc ON fc.repo = f.repo AND fc.lane = f.lane AND fc.wc = f.work_class"""))
def expected_run(spark, sf):
    return estimates.expected_run_ms(history(spark, sf), local_only=False)
