"""Speed-aware placement over the derived history; runners come from `region`, jobs from `customer`."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans import placement
from runlens.workload.q_scalars import CLASSIFIED, COMMAND_CTES
from runlens.workload.registry import query
from runlens.workload.views import flat, history, oracle

NOW = 1_000_000_000_000

PAIRS_SQL = CLASSIFIED + "," + COMMAND_CTES + """,
pr AS (SELECT CASE WHEN coalesce(k.executor, 'local') = 'local' THEN '' WHEN k.executor = 'remote' THEN k.runner END AS side, k.repo, k.lane, CASE WHEN coalesce(c.command, '') <> '' THEN c.pairing ELSE k.cmd_fp END AS pair, k.wall_s * 1000 AS ms
  FROM kinds k JOIN cmds c ON c.ord = k.ord WHERE k.kind = 'completed'),
md AS (SELECT side, repo, lane, pair, count(*) AS n, median(ms) AS med FROM pr WHERE side IS NOT NULL AND pair IS NOT NULL GROUP BY 1, 2, 3, 4),
pairs AS (SELECT r.side AS runner, r.repo, r.lane, r.pair, l.n AS local_runs, r.n AS remote_runs, l.med AS local_median_ms, r.med / l.med AS ratio FROM md r JOIN md l ON l.side = '' AND r.side <> '' AND l.repo = r.repo AND l.lane = r.lane AND l.pair = r.pair)"""


@query("speed_pairs", "JON06 P02 SCL06", oracle(["history"], PAIRS_SQL + "\nSELECT runner, repo, lane, pair, local_runs, remote_runs, round(local_median_ms, 4) AS local_median_ms, round(ratio, 6) AS ratio FROM pairs"))
def speed_pairs(spark, sf):
    return placement.speed_pairs(history(spark, sf)).withColumns({"ratio": F.round("ratio", 6), "local_median_ms": F.round("local_median_ms", 4)})


JOBS_SQL = """
jb AS (SELECT parent_id AS job, '_home_proj_' || CASE parent_id % 2 WHEN 0 THEN 'foo' ELSE 'bar' END || '_.git' AS repo, CASE parent_id % 5 WHEN 0 THEN 'unit' WHEN 1 THEN 'train' WHEN 2 THEN 'prepush' WHEN 3 THEN 'sim-heavy' ELSE 'none' END AS lane,
  CASE parent_id % 6 WHEN 0 THEN 'cargo test --release' WHEN 1 THEN 'env MODE=m' || (parent_id % 5)::VARCHAR || ' STAMP=2024-02-20T11:11 pnpm run gate' WHEN 2 THEN 'timeout 600 make check'
    WHEN 3 THEN 'MODE=m1 SEED=s7 node run.js --shard 9' WHEN 4 THEN 'pnpm test && pnpm build' ELSE 'unknown tool' END AS command, (20000 + (parent_id % 40) * 90000)::DOUBLE AS estimate_ms FROM parents),
rn AS (SELECT 'r' || r_regionkey::VARCHAR AS runner, r_regionkey::INTEGER AS config_order, CASE r_regionkey WHEN 1 THEN 2.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE END AS speed_factor, CASE r_regionkey WHEN 2 THEN 3.5::DOUBLE WHEN 4 THEN 0.5::DOUBLE END AS speed_ratio FROM region)"""


def _jobs(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS job", "concat('_home_proj_', if(c_custkey % 2 = 0, 'foo', 'bar'), '_.git') AS repo",
        "CASE c_custkey % 5 WHEN 0 THEN 'unit' WHEN 1 THEN 'train' WHEN 2 THEN 'prepush' WHEN 3 THEN 'sim-heavy' ELSE 'none' END AS lane",
        "CASE c_custkey % 6 WHEN 0 THEN 'cargo test --release' WHEN 1 THEN concat('env MODE=m', c_custkey % 5, ' STAMP=2024-02-20T11:11 pnpm run gate') WHEN 2 THEN 'timeout 600 make check'"
        " WHEN 3 THEN 'MODE=m1 SEED=s7 node run.js --shard 9' WHEN 4 THEN 'pnpm test && pnpm build' ELSE 'unknown tool' END AS command",
        "CAST(20000 + (c_custkey % 40) * 90000 AS DOUBLE) AS estimate_ms")


def _runners(spark, sf):
    return spark.read.parquet(f"{sf}/region.parquet").selectExpr(
        "concat('r', r_regionkey) AS runner", "r_regionkey AS config_order", "CASE r_regionkey WHEN 1 THEN 2.0D WHEN 3 THEN 0.5D END AS speed_factor",
        "CASE r_regionkey WHEN 2 THEN 3.5D WHEN 4 THEN 0.5D END AS speed_ratio")


@query("speed_ratios", "AGG21 JON07 P02 P10", oracle(["history", "parents"], PAIRS_SQL + "," + JOBS_SQL + """,
jp AS (SELECT *, CASE parent_pair WHEN 1 THEN 'MODE=m' || (job % 5)::VARCHAR || ' pnpm run gate' ELSE command END AS pair0 FROM (SELECT *, job % 6 AS parent_pair FROM jb) z),
base AS (SELECT jp.*, CASE WHEN parent_pair = 1 THEN 'env ' || pair0 ELSE command END AS pair, rn.runner, rn.speed_ratio FROM jp, rn),
ex AS (SELECT b.job, b.runner, p.ratio, 1 AS k FROM base b JOIN pairs p ON p.runner = b.runner AND p.repo = b.repo AND p.lane = b.lane AND p.pair = b.pair AND p.local_runs >= 2 AND p.remote_runs >= 2),
rl AS (SELECT runner, repo, lane, median(ratio) AS ratio, count(*) AS k FROM pairs GROUP BY 1, 2, 3 HAVING count(*) >= 5),
sb AS (SELECT b.job, b.runner, median(p.ratio) AS ratio, count(*) AS k FROM base b JOIN pairs p ON p.runner = b.runner AND p.local_median_ms BETWEEN b.estimate_ms / 2 AND b.estimate_ms * 2 GROUP BY 1, 2 HAVING count(*) >= 5),
gl AS (SELECT runner, median(ratio) AS ratio, count(*) AS k FROM pairs GROUP BY 1 HAVING count(*) >= 5)
SELECT b.job, b.runner, round(coalesce(ex.ratio, rl.ratio, sb.ratio, gl.ratio, CASE WHEN b.speed_ratio >= 1 THEN b.speed_ratio ELSE 1 END), 6) AS ratio,
  CASE WHEN ex.k IS NOT NULL THEN 'exact' WHEN rl.k IS NOT NULL THEN 'repo-lane' WHEN sb.k IS NOT NULL THEN 'size-band' WHEN gl.k IS NOT NULL THEN 'global' ELSE 'configured' END AS tier, coalesce(ex.k, rl.k, sb.k, gl.k, 0) AS pairs
FROM base b LEFT JOIN ex ON ex.job = b.job AND ex.runner = b.runner LEFT JOIN rl ON rl.runner = b.runner AND rl.repo = b.repo AND rl.lane = b.lane
LEFT JOIN sb ON sb.job = b.job AND sb.runner = b.runner LEFT JOIN gl ON gl.runner = b.runner"""))
def speed_ratios(spark, sf):
    return placement.speed_ratios(_jobs(spark, sf), _runners(spark, sf).select("runner", "speed_ratio"), placement.speed_pairs(history(spark, sf))).withColumn("ratio", F.round("ratio", 6))


NAMES_SQL = COMMAND_CTES + """,
sa AS (SELECT repo, lane, unnest(stable) AS p FROM cmds),
nm AS (SELECT repo, lane, p.name AS name, count(DISTINCT p.value) AS vals FROM sa GROUP BY 1, 2, 3 HAVING count(DISTINCT p.value) <= 8)"""


@query("class_assignment_names", "AGG22 SCL08", oracle(["history"], NAMES_SQL + "\nSELECT * FROM nm"))
def class_assignment_names(spark, sf):
    return placement.class_names(history(spark, sf))


EVIDENCE_SQL = NAMES_SQL + "," + JOBS_SQL + """,
lane_names AS (SELECT repo, lane, list(name) AS names FROM nm GROUP BY 1, 2),
okr AS (SELECT c.*, coalesce(n.names, []) AS names FROM cmds c LEFT JOIN lane_names n ON n.repo = c.repo AND n.lane = c.lane WHERE executor = 'remote' AND runner IS NOT NULL AND exit_code = 0 AND run_ms > 0),
tk AS (SELECT 'exact' AS tier, repo, lane, CASE WHEN coalesce(command, '') <> '' THEN pairing END AS tkey, runner, run_ms, coalesce(started_at, 0) AS t, ord FROM okr
  UNION ALL SELECT 'class', repo, lane, nullif(array_to_string(list_sort(list_transform(list_filter(stable, lambda p: list_contains(names, p.name)), lambda p: p.name || '=' || p.value)), ' '), ''), runner, run_ms, coalesce(started_at, 0), ord FROM okr
  UNION ALL SELECT 'repo-lane', repo, lane, '', runner, run_ms, coalesce(started_at, 0), ord FROM okr),
rk AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY tier, repo, lane, tkey, runner) AS matching FROM tk WHERE tkey IS NOT NULL WINDOW w AS (PARTITION BY tier, repo, lane, tkey, runner ORDER BY t DESC, ord DESC)),
ev AS (SELECT tier, repo, lane, tkey, runner, max(matching) AS matching, median(run_ms) AS ms, count(*) AS n FROM rk WHERE rn <= 20 GROUP BY 1, 2, 3, 4, 5 HAVING max(matching) >= CASE WHEN tier = 'repo-lane' THEN 3 ELSE 2 END)"""


@query("run_evidence", "AGG23 P06", oracle(["history", "parents"], EVIDENCE_SQL + "\nSELECT * FROM ev"))
def run_evidence(spark, sf):
    h = history(spark, sf)
    return placement.run_evidence(h, placement.class_names(h))


ESTIMATE_SQL = EVIDENCE_SQL + """,
jt AS (SELECT job, repo, lane, 0 AS tier_no, 'exact' AS tier, CASE WHEN job % 6 = 1 THEN 'env MODE=m' || (job % 5)::VARCHAR || ' pnpm run gate' ELSE command END AS tkey FROM jb
  UNION ALL SELECT job, jb.repo, jb.lane, 1, 'class', CASE job % 6 WHEN 1 THEN CASE WHEN list_contains(names, 'MODE') THEN 'MODE=m' || (job % 5)::VARCHAR END
    WHEN 3 THEN nullif(array_to_string(list_filter([CASE WHEN list_contains(names, 'MODE') THEN 'MODE=m1' END, CASE WHEN list_contains(names, 'SEED') THEN 'SEED=s7' END], lambda x: x IS NOT NULL), ' '), '') END FROM jb LEFT JOIN lane_names n ON n.repo = jb.repo AND n.lane = jb.lane
  UNION ALL SELECT job, repo, lane, 2, 'repo-lane', '' FROM jb),
sp AS (SELECT runner, config_order, CASE WHEN speed_factor > 0 THEN speed_factor ELSE 1 END AS speed FROM rn),
je AS (SELECT j.*, c.runner AS cand, c.speed AS cand_speed, e.runner AS er, e.matching, e.ms, e.n, s.speed, s.config_order FROM jt j CROSS JOIN sp c LEFT JOIN ev e ON e.tier = j.tier AND e.repo = j.repo AND e.lane = j.lane AND e.tkey = j.tkey LEFT JOIN sp s ON s.runner = e.runner),
hits AS (SELECT job, cand AS runner, tier_no, tier, max(CASE WHEN er = cand THEN floor(ms + 0.5)::BIGINT END) AS own_ms, max(CASE WHEN er = cand THEN n END) AS own_n,
  arg_max(floor(ms * speed / cand_speed + 0.5)::BIGINT, (matching, -config_order)) FILTER (er <> cand) AS donor_ms, arg_max(n, (matching, -config_order)) FILTER (er <> cand) AS donor_n, arg_max(er, (matching, -config_order)) FILTER (er <> cand) AS donor FROM je GROUP BY 1, 2, 3, 4),
best AS (SELECT job, runner, arg_min(own_ms, tier_no) FILTER (own_ms IS NOT NULL) AS oms, arg_min(own_n, tier_no) FILTER (own_ms IS NOT NULL) AS onn, arg_min(tier, tier_no) FILTER (own_ms IS NOT NULL) AS ot,
  arg_min(donor_ms, tier_no) FILTER (donor_ms IS NOT NULL) AS dms, arg_min(donor_n, tier_no) FILTER (donor_ms IS NOT NULL) AS dn, arg_min(tier, tier_no) FILTER (donor_ms IS NOT NULL) AS dt, arg_min(donor, tier_no) FILTER (donor_ms IS NOT NULL) AS dd FROM hits GROUP BY 1, 2),
single AS (SELECT job, runner, coalesce(oms, dms) AS ms, CASE WHEN oms IS NOT NULL THEN ot ELSE dt END AS tier, CASE WHEN oms IS NOT NULL THEN onn ELSE dn END AS n, CASE WHEN oms IS NULL THEN dd END AS donor FROM best),
com AS (SELECT job, min(tier_no) AS common FROM (SELECT job, tier_no FROM hits GROUP BY 1, 2 HAVING bool_and(own_ms IS NOT NULL OR donor_ms IS NOT NULL)) z GROUP BY 1),
est AS (SELECT s.job, s.runner, CASE WHEN c.common IS NULL THEN s.ms ELSE coalesce(h.own_ms, h.donor_ms) END AS ms, CASE WHEN c.common IS NULL THEN s.tier ELSE h.tier END AS tier,
  CASE WHEN c.common IS NULL THEN s.n WHEN h.own_ms IS NOT NULL THEN h.own_n ELSE h.donor_n END AS n, CASE WHEN c.common IS NULL THEN s.donor WHEN h.own_ms IS NULL THEN h.donor END AS donor
  FROM single s LEFT JOIN com c ON c.job = s.job LEFT JOIN hits h ON h.job = s.job AND h.runner = s.runner AND h.tier_no = c.common)"""


@query("run_estimates", "AGG23 JON08 P10", oracle(["history", "parents"], ESTIMATE_SQL + "\nSELECT * FROM single"))
def run_estimates(spark, sf):
    return placement.run_estimates(_jobs(spark, sf), _runners(spark, sf), history(spark, sf), common_tier=False)


@query("run_estimates_common_tier", "AGG24", oracle(["history", "parents"], ESTIMATE_SQL + "\nSELECT * FROM est"))
def run_estimates_common_tier(spark, sf):
    return placement.run_estimates(_jobs(spark, sf), _runners(spark, sf), history(spark, sf))


@query("finish_ranking", "AGG25 JON18", oracle(["history", "parents"], ESTIMATE_SQL + f""",
cd AS (SELECT e.job, e.runner, CASE WHEN e.job % 7 <> 0 OR e.runner <> 'r3' THEN e.ms END AS ms, r.config_order, (e.job + r.config_order) % 4 AS queued, (e.job + r.config_order) % 3 <> 1 AS room, ((e.job * 3 + r.config_order) % 8)::DOUBLE AS cpu_free,
  (8 + 4 * r.config_order)::DOUBLE AS capacity_cpu, (1 + e.job % 6)::DOUBLE AS need_cpu, coalesce(r.speed_factor, 1) AS sp, CASE WHEN r.config_order = 2 THEN {NOW} + 2000000 END AS closes_at FROM est e JOIN rn r ON r.runner = e.runner),
fr2 AS (SELECT *, room AND queued = 0 AS idle, bool_and(ms IS NOT NULL) OVER (PARTITION BY job) AS scored, greatest(1, floor(capacity_cpu / need_cpu)) AS slots, (queued + 1) * need_cpu / sp AS rough FROM cd),
fr3 AS (SELECT *, CASE WHEN idle THEN 0 ELSE (queued + 0.5::DOUBLE) * ms / slots END AS wait FROM fr2),
fr4 AS (SELECT *, CASE WHEN scored THEN wait + ms + 60000 END AS finish, coalesce(scored AND {NOW} + wait + ms > closes_at, false) AS dropped FROM fr3),
fr5 AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY dropped, finish NULLS LAST, CASE WHEN scored THEN 0 WHEN idle THEN 0 ELSE queued + 1 END, CASE WHEN scored THEN 0 ELSE rough END, idle DESC, cpu_free DESC, config_order) AS rk FROM fr4)
SELECT job, runner, scored, dropped, idle, CASE WHEN scored THEN round(wait, 4) END AS wait_ms, round(finish, 4) AS finish_ms, CASE WHEN NOT dropped THEN rk END AS rank FROM fr5"""))
def finish_ranking(spark, sf):
    est = placement.run_estimates(_jobs(spark, sf), _runners(spark, sf), history(spark, sf))
    c = est.join(F.broadcast(_runners(spark, sf)), "runner").selectExpr(
        "job", "runner", "if(job % 7 <> 0 OR runner <> 'r3', ms, NULL) AS ms", "config_order", "(job + config_order) % 4 AS queued", "(job + config_order) % 3 <> 1 AS room",
        "CAST((job * 3 + config_order) % 8 AS DOUBLE) AS cpu_free", "CAST(8 + 4 * config_order AS DOUBLE) AS capacity_cpu", "CAST(1 + job % 6 AS DOUBLE) AS need_cpu", "speed_factor",
        f"CASE WHEN config_order = 2 THEN {NOW}L + 2000000 END AS closes_at")
    return placement.finish_ranking(c, float(NOW)).withColumns({"wait_ms": F.round("wait_ms", 4), "finish_ms": F.round("finish_ms", 4)})


@query("closes_before_finish", "JON18", oracle(["tickets"], """
SELECT ticket_id AS t_ms, 'r' || (ticket_id % 4)::VARCHAR AS runner, coalesce(ticket_id + ticket_id % 70 * 60000 + ticket_id % 90 * 50000 > CASE WHEN ticket_id % 3 <> 0 THEN ticket_id + ticket_id % 50 * 100000 END, false) AS closes_first FROM tickets"""))
def closes_before_finish(spark, sf):
    t = flat(spark, sf, "tickets").selectExpr("ticket_id AS t_ms", "concat('r', ticket_id % 4) AS runner", "ticket_id % 70 * 60000 AS wait_ms", "ticket_id % 90 * 50000 AS run_ms", "CASE WHEN ticket_id % 3 <> 0 THEN ticket_id + ticket_id % 50 * 100000 END AS closes_at")
    return placement.closes_before_finish(t.drop("closes_at"), t.select("t_ms", "runner", "closes_at")).select("t_ms", "runner", "closes_first")


QUEUE_SQL = """
tq AS (SELECT ticket_id AS ticket, host, created_ms, (60000 + (ticket_id % 50) * 20000)::DOUBLE AS estimate_ms, priority, ticket_id % 9 = 0 AS admits_now, ticket_id % 10 = 1 AS blocked, ticket_id % 8 = 3 AS held,
  CASE WHEN ticket_id % 6 <> 0 THEN 1 + (ticket_id % 5)::DOUBLE / 4 END AS ratio, CASE WHEN ticket_id % 4 = 0 THEN (ticket_id % 997)::DOUBLE * 1000000 END AS remote_finish, (1 + ticket_id % 3)::DOUBLE AS slots FROM tickets WHERE state = 'queued'),
ta AS (SELECT *, coalesce(sum(estimate_ms) OVER (PARTITION BY host ORDER BY created_ms, ticket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, row_number() OVER (PARTITION BY host ORDER BY created_ms, ticket) AS pos FROM tq),
tb AS (SELECT *, greatest((ahead + estimate_ms) / greatest(1, slots), 0) AS wait, coalesce(remote_finish, estimate_ms * ratio + 60000) AS remote FROM ta),
tc AS (SELECT *, CASE WHEN admits_now THEN 0 ELSE wait END + estimate_ms AS loc, NOT admits_now AND (blocked OR (held AND remote IS NOT NULL)) AS hidden FROM tb)"""


@query("local_or_remote", "AGG27 P11", oracle(["tickets"], QUEUE_SQL + """
SELECT ticket, CASE WHEN hidden THEN CASE WHEN remote IS NULL THEN 'local' ELSE 'remote' END WHEN remote IS NULL OR loc <= remote THEN 'local' ELSE 'remote' END AS choice,
  CASE WHEN NOT hidden THEN floor(loc + 0.5)::BIGINT END AS local_finish_ms, floor(remote + 0.5)::BIGINT AS remote_finish_ms, coalesce(remote_finish < 0.75::DOUBLE * pos * estimate_ms, true) AS move_allowed FROM tc"""))
def local_or_remote(spark, sf):
    t = flat(spark, sf, "tickets").filter("state = 'queued'").selectExpr(
        "ticket_id AS ticket", "host", "created_ms", "CAST(60000 + (ticket_id % 50) * 20000 AS DOUBLE) AS estimate_ms", "ticket_id % 9 = 0 AS admits_now", "ticket_id % 10 = 1 AS blocked", "ticket_id % 8 = 3 AS held_by_key",
        "CASE WHEN ticket_id % 6 <> 0 THEN 1 + CAST(ticket_id % 5 AS DOUBLE) / 4 END AS runner_ratio", "CASE WHEN ticket_id % 4 = 0 THEN CAST(ticket_id % 997 AS DOUBLE) * 1000000 END AS remote_finish_ms",
        "CAST(1 + ticket_id % 3 AS DOUBLE) AS slots", "0.0D AS waited_ms", f"created_ms div {30 * 86400000} AS slice", "1L AS one")
    t = placement.work_ahead(t, ["host"], "slice", ["created_ms", "ticket"], "estimate_ms")
    t = placement.work_ahead(t.withColumnRenamed("ahead_ms", "work"), ["host"], "slice", ["created_ms", "ticket"], "one").withColumn("position", F.col("ahead_ms") + 1)
    return placement.local_or_remote(t.drop("ahead_ms").withColumnRenamed("work", "ahead_ms").withColumn("source_estimate_ms", F.col("estimate_ms")))


@query("runner_availability", "JON17", oracle(["tickets"], """
sch AS (SELECT * FROM (VALUES ('r0', ['mon', 'tue', 'wed', 'thu', 'fri'], 540, 1080), ('r1', ['sat', 'sun'], 0, 1439), ('r2', ['mon', 'wed', 'sun'], 1320, 360), ('r2', ['mon'], 1380, 600), ('r3', ['tue'], 30, 31)) v(runner, days, f, t)),
ins AS (SELECT DISTINCT created_ms AS t_ms FROM tickets),
x AS (SELECT t_ms, runner, days, f, CASE WHEN t > f THEN t ELSE t + 1440 END AS t, t_ms // 86400000 + o AS d FROM ins, sch, (VALUES (-1), (0)) v(o)),
y AS (SELECT *, d * 86400000 + f * 60000 AS s, d * 86400000 + t * 60000 AS e FROM x WHERE list_contains(days, ['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'][((d + 3) % 7) + 1])),
z AS (SELECT t_ms, runner, max(e) AS closes_at FROM y WHERE s <= t_ms AND t_ms < e GROUP BY 1, 2)
SELECT i.t_ms, r.runner, z.closes_at, z.closes_at IS NOT NULL AS available FROM ins i CROSS JOIN (SELECT DISTINCT runner FROM sch) r LEFT JOIN z ON z.t_ms = i.t_ms AND z.runner = r.runner"""))
def runner_availability(spark, sf):
    sched = spark.sql(
        "SELECT * FROM VALUES ('r0', 'UTC', array('mon','tue','wed','thu','fri'), 540L, 1080L), ('r1', 'UTC', array('sat','sun'), 0L, 1439L),"
        " ('r2', 'UTC', array('mon','wed','sun'), 1320L, 360L), ('r2', 'UTC', array('mon'), 1380L, 600L), ('r3', 'UTC', array('tue'), 30L, 31L)"
        " AS v(runner, timezone, days, from_min, to_min)")
    return placement.availability(flat(spark, sf, "tickets").select(F.col("created_ms").alias("t_ms")), sched)


@query("readiness_gaps", "JON19 SCL21", oracle(["tickets", "agents"], """
nd AS (SELECT DISTINCT array_to_string(tools, ',') AS tools, array_to_string(requires_tags, ',') AS tags, tools AS tl, requires_tags AS tg FROM tickets),
p AS (SELECT agent AS runner, CASE CAST(substr(agent, 2) AS BIGINT) % 3 WHEN 0 THEN ['node', 'pnpm', 'cargo'] WHEN 1 THEN ['node'] END AS has_tools, tags AS has_tags, CAST(substr(agent, 2) AS BIGINT) AS k FROM agents),
g AS (SELECT nd.tools, nd.tags, runner, list_sort(list_filter(tl, lambda x: NOT list_contains(coalesce(has_tools, []), x))) AS mt, list_sort(list_filter(tg, lambda x: NOT list_contains(has_tags, x))) AS mg, k % 5 = 0 AS old, k % 7 = 0 AS trunc FROM nd, p)
SELECT tools, tags, runner, CASE WHEN len(mt) > 0 THEN 'tools' WHEN len(mg) > 0 THEN 'tags' WHEN old THEN 'version' WHEN trunc THEN 'integrity' END AS "check",
  CASE WHEN len(mt) > 0 THEN array_to_string(mt, ',') WHEN len(mg) > 0 THEN array_to_string(mg, ',') WHEN old THEN '1.0.0' WHEN trunc THEN 'src/a.js' END AS missing FROM g"""))
def readiness_gaps(spark, sf):
    needs = flat(spark, sf, "tickets").select("tools", F.col("requires_tags").alias("tags"), F.lit("1.0.0").alias("version_floor")).distinct()
    probes = flat(spark, sf, "agents").withColumn("k", F.expr("cast(substring(agent, 2) as bigint)")).selectExpr(
        "agent AS runner", "CASE k % 3 WHEN 0 THEN array('node', 'pnpm', 'cargo') WHEN 1 THEN array('node') END AS tools", "tags", "if(k % 5 = 0, '0.9.9', '1.2.0') AS version", "if(k % 7 = 0, array('src/a.js'), NULL) AS zero_length")
    g = placement.readiness_gaps(needs, probes)
    return g.select(F.array_join("tools", ",").alias("tools"), F.array_join("tags", ",").alias("tags"), "runner", "check", F.array_join("missing", ",").alias("missing"))


@query("runner_fit", "JON22", oracle(["tickets", "agents"], """
cl AS (SELECT DISTINCT weight, weight AS cpu, CASE WHEN weight > 4 THEN weight / 2 END AS min_cpu, (weight * 1000000000)::DOUBLE AS memory FROM tickets),
p AS (SELECT agent AS runner, capacity AS cap_weight, CASE WHEN k % 6 <> 0 THEN capacity END AS cap_cpu, 12e9::DOUBLE AS cap_memory, 1e9::DOUBLE AS memory_reserve, CASE WHEN k % 4 = 0 THEN 5e9::DOUBLE END AS memory_admissible, k % 2 = 0 AS elastic, 3.0::DOUBLE AS reserved,
  CASE WHEN k % 3 <> 0 THEN headroom END AS hc, CASE WHEN k % 3 = 1 THEN headroom / 2 END AS hu, CASE WHEN k % 5 = 0 THEN 4e9::DOUBLE END AS hm, k % 7 = 1 AS unenf FROM (SELECT *, CAST(substr(agent, 2) AS BIGINT) AS k FROM agents) a),
j AS (SELECT *, CASE WHEN elastic AND min_cpu IS NOT NULL THEN min_cpu ELSE cpu END AS need, coalesce(CASE WHEN hc IS NOT NULL AND unenf AND hu IS NOT NULL THEN hu ELSE hc END, CASE WHEN cap_cpu IS NOT NULL THEN greatest(0, cap_cpu - reserved) END) AS free FROM cl, p)
SELECT weight, runner, coalesce(weight > cap_weight, false) OR coalesce(need > cap_cpu, false) OR memory + memory_reserve > cap_memory OR coalesce(memory > memory_admissible, false) AS never_fits,
  NOT coalesce(need > free, false) AND NOT coalesce(memory > hm, false) AS room, CASE WHEN coalesce(need > free, false) THEN 'cpu' WHEN coalesce(memory > hm, false) THEN 'memory' END AS no_room_reason, free AS cpu_free,
  CASE WHEN cap_cpu > 0 THEN greatest(1, floor(cap_cpu / cpu))::BIGINT ELSE 1 END AS slots FROM j"""))
def runner_fit(spark, sf):
    claims = flat(spark, sf, "tickets").selectExpr("weight", "weight AS cpu", "if(weight > 4, weight / 2, NULL) AS min_cpu", "weight * 1000000000.0D AS memory").distinct()
    probes = flat(spark, sf, "agents").withColumn("k", F.expr("cast(substring(agent, 2) as bigint)")).selectExpr(
        "agent AS runner", "capacity AS cap_weight", "if(k % 6 <> 0, capacity, NULL) AS cap_cpu", "12e9D AS cap_memory", "1e9D AS memory_reserve", "if(k % 4 = 0, 5e9D, NULL) AS memory_admissible", "k % 2 = 0 AS elastic", "3.0D AS reserved_cpu",
        "if(k % 3 <> 0, headroom, NULL) AS headroom_cpu", "if(k % 3 = 1, headroom / 2, NULL) AS headroom_undiscounted", "if(k % 5 = 0, 4e9D, NULL) AS headroom_memory", "k % 7 = 1 AS unenforced")
    return placement.runner_fit(claims, probes).select("weight", "runner", "never_fits", "room", "no_room_reason", F.when(F.col("cpu_free").isNotNull(), F.col("cpu_free")).alias("cpu_free"), "slots")
