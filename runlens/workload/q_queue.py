"""Queue-table reports over the derived ticket, agent, job, group and parent views."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans import queue as pq
from runlens.workload.registry import query
from runlens.workload.views import flat, oracle

NOW = 1_000_000_000_000


@query("ticket_view", "PRJ01 PRJ02", oracle(["tickets", "agents"], """
SELECT 'ticket' AS kind, ticket_id::VARCHAR AS id, md5('run ' || repo || ' ' || ticket_id::VARCHAR) AS detail FROM tickets
UNION ALL SELECT 'agent', agent, array_to_string(tags, ',') FROM agents WHERE max_claims > 0 UNION ALL SELECT 'runner', agent, max_claims::VARCHAR FROM agents"""))
def ticket_view(spark, sf):
    t = flat(spark, sf, "tickets").withColumns({
        "header": F.to_json(F.struct(F.concat(F.lit("run "), "repo", F.lit(" "), F.col("ticket_id").cast("string")).alias("argv"))), "claim_token": F.lit("secret")})
    a = flat(spark, sf, "agents").withColumnsRenamed({"agent": "host"}).withColumns({"kind": F.when(F.col("max_claims") > 0, "agent").otherwise("submit"), "last_seen": F.col("max_claims")})
    tv = pq.ticket_view(t).select(F.lit("ticket").alias("kind"), F.col("ticket_id").cast("string").alias("id"), F.col("argv_md5").alias("detail"))
    pv = pq.principal_view(a).select(F.lit("agent").alias("kind"), F.col("host").alias("id"), F.array_join("tags", ",").alias("detail"))
    return tv.union(pv).union(pq.runner_view(a).select(F.lit("runner"), "host", F.col("last_seen").cast("string")))


@query("list_mine", "PRJ03", oracle(["tickets"], """
SELECT owner, ticket_id, state, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_ms DESC, ticket_id) AS rn FROM tickets WHERE state IN ('queued', 'running')) t WHERE rn <= 100"""))
def list_mine(spark, sf):
    return pq.list_mine(flat(spark, sf, "tickets"), ["queued", "running"]).select("owner", "ticket_id", "state", "created_ms")


@query("prune_candidates", "ORD02", oracle(["tickets"], f"""
SELECT ticket_id, finished_ms, finished_ms < {NOW} - 100000000000 AS row_due FROM tickets WHERE finished_ms < {NOW} - 86400000 AND (finished_ms, ticket_id) > (820000000000, 10) ORDER BY finished_ms, ticket_id LIMIT 500"""))
def prune_candidates(spark, sf):
    return pq.prune_candidates(flat(spark, sf, "tickets"), NOW, 86_400_000, 100_000_000_000, (820_000_000_000, 10), 900)


@query("job_state_counts", "AGG29", oracle(["jobs"], "SELECT class, state, count(*) AS n FROM jobs GROUP BY 1, 2"))
def job_state_counts(spark, sf):
    return pq.state_counts(flat(spark, sf, "jobs"))


ELIG = """
pf AS (SELECT DISTINCT array_to_string(list_sort(requires_tags), ',') AS tags, list_sort(requires_tags) AS rt, repo FROM tickets),
el AS (SELECT pf.*, a.agent, a.max_claims, a.tags AS atags FROM pf, agents a WHERE list_has_all(a.tags, pf.rt) AND (list_contains(a.allowed_repos, pf.repo) OR list_contains(a.allowed_repos, '*')))"""


@query("ticket_eligibility", "JON11", oracle(["tickets", "agents"], ELIG + "\nSELECT tags, repo, agent FROM el"))
def ticket_eligibility(spark, sf):
    t = flat(spark, sf, "tickets")
    return pq.eligible_agents(pq._profiles(t), flat(spark, sf, "agents")).select(F.array_join("requires_tags", ",").alias("tags"), "repo", "agent")


@query("ticket_scarcity", "AGG31", oracle(["tickets", "agents"], ELIG + "\nSELECT pf.tags, pf.repo, count(el.agent) FILTER (max_claims > 0) AS scarcity FROM pf LEFT JOIN el ON el.tags = pf.tags AND el.repo = pf.repo GROUP BY 1, 2"))
def ticket_scarcity(spark, sf):
    return pq.scarcity(flat(spark, sf, "tickets"), flat(spark, sf, "agents")).select(F.array_join("requires_tags", ",").alias("tags"), "repo", "scarcity")


@query("needed_tools", "AGG30", oracle(["tickets", "agents"], ELIG + """,
tl AS (SELECT DISTINCT array_to_string(list_sort(requires_tags), ',') AS tags, repo, unnest(tools) AS tool FROM tickets WHERE state = 'queued'),
g AS (SELECT agent, list_sort(list(DISTINCT tool)) AS t FROM el JOIN tl ON tl.tags = el.tags AND tl.repo = el.repo GROUP BY 1)
SELECT a.agent, coalesce(array_to_string(g.t, ','), '') AS tools FROM agents a LEFT JOIN g ON g.agent = a.agent"""))
def needed_tools(spark, sf):
    return pq.needed_tools(flat(spark, sf, "tickets"), flat(spark, sf, "agents")).select("agent", F.array_join("tools", ",").alias("tools"))


def _claim_sql(room: str, now: int) -> str:
    return oracle(["tickets", "agents"], ELIG + f""",
sc AS (SELECT tags, repo, count(*) FILTER (max_claims > 0) AS scarcity FROM el GROUP BY 1, 2),
s AS (SELECT t.*, array_to_string(list_sort(requires_tags), ',') AS ptags, greatest(0, {now} - created_ms) AS age FROM tickets t WHERE state = 'queued'),
sx AS (SELECT *, least(CASE WHEN priority >= 7 OR age / 1000 >= 3600 THEN 2.0::DOUBLE ELSE 1.98::DOUBLE END, CASE WHEN priority >= 7 THEN 2.0::DOUBLE WHEN priority >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 2.0::DOUBLE * least(1.0::DOUBLE, age / 1000 / 1200)) + CASE WHEN priority >= 9 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s),
c AS (SELECT sx.snapshot, el.agent, sx.ticket_id, score, sc.scarcity, row_number() OVER (PARTITION BY sx.snapshot, el.agent ORDER BY score DESC, CASE WHEN score >= 2 AND age >= 3600000 THEN created_ms END NULLS LAST, sc.scarcity, created_ms, ticket_id) AS rn
  FROM sx JOIN el ON el.tags = sx.ptags AND el.repo = sx.repo JOIN agents a ON a.agent = el.agent JOIN sc ON sc.tags = sx.ptags AND sc.repo = sx.repo
  WHERE (age >= 600000 OR NOT list_has_any(sx.avoid_tags, a.tags)) AND sx.weight <= a.{room})
SELECT snapshot, agent, ticket_id, round(score, 6) AS score, scarcity FROM c WHERE rn = 1""")


EARLY = 820_000_000_000


@query("claim_ranking_now", "WIN10 JON12 SCL12", _claim_sql("headroom", NOW))
def claim_ranking_now(spark, sf):
    return pq.claim_ranking(flat(spark, sf, "tickets"), flat(spark, sf, "agents"), NOW, 600_000, "headroom")


@query("claim_ranking_capacity", "WIN10 JON12", _claim_sql("capacity", EARLY))
def claim_ranking_capacity(spark, sf):
    return pq.claim_ranking(flat(spark, sf, "tickets"), flat(spark, sf, "agents"), EARLY, 600_000, "capacity")


STAGE_SQL = "stg AS (SELECT group_id, min(stage) AS open_stage FROM jobs WHERE lower(state) IN ('queued', 'claimed', 'preparing', 'running', 'held') GROUP BY 1)"


@query("open_stages", "AGG34", oracle(["jobs"], STAGE_SQL + "\nSELECT * FROM stg"))
def open_stages(spark, sf):
    return pq.open_stages(flat(spark, sf, "jobs"))


JOBX = """SELECT *, hash_no AS seq, CASE WHEN hash_no % 3 = 0 THEN hash_no % 4 END AS host_pin, hash_no % 5 = 0 AS gpu, CASE hash_no % 6 WHEN 0 THEN 'host' WHEN 1 THEN 'global' ELSE 'none' END AS conflict_scope,
 'k' || CAST(hash_no % 50 AS STRING) AS ck, CASE WHEN hash_no % 17 = 0 THEN 'gone' ELSE 'tpl' END AS template, enqueued_ms AS not_before_ms, cpu_req AS cpu_min, cpu_req * 1000000000 AS memory, hash_no % 13 = 0 AS exclusive
FROM (SELECT *, group_id * 7919 + stage * 104729 + max_ms % 7 AS hash_no FROM {jobs})"""
CUT = 950_000_000_000
ELIG_JOBS = STAGE_SQL + """,
jx0 AS (""" + JOBX.replace("{jobs}", "jobs") + """ z),
hx AS (SELECT * FROM (VALUES (0::BIGINT, false, 'k6', 6.0::DOUBLE), (1, true, 'k12', 7.0::DOUBLE), (2, true, 'k18', 3.0::DOUBLE)) v(host, gpu, held, free)),
ej AS (SELECT j.* EXCLUDE (host), h.host, h.free FROM jx0 j JOIN stg s ON s.group_id = j.group_id AND s.open_stage = j.stage, hx h
  WHERE lower(j.state) = 'queued' AND not_before_ms <= 950000000000 AND template = 'tpl' AND NOT (conflict_scope = 'global' AND ck IN ('k1', 'k7', 'k13')) AND (host_pin IS NULL OR host_pin = h.host) AND (NOT j.gpu OR h.gpu) AND NOT (conflict_scope = 'host' AND ck = held))"""


def _eligible(spark, sf):
    jobs = spark.sql(JOBX, jobs=flat(spark, sf, "jobs").drop("host")).withColumns({
        "tags_req": F.when(F.col("gpu"), F.array(F.lit("gpu"))).otherwise(F.array().cast("array<string>")), "conflict_keys": F.array("ck")})
    hosts = spark.sql("SELECT * FROM VALUES (0L, array('cpu'), array('k6'), 6.0D, 9e9D), (1L, array('cpu','gpu'), array('k12'), 7.0D, 9e9D), (2L, array('gpu'), array('k18'), 3.0D, 9e9D) AS v(host, tags, held_keys, free, memory)")
    excl = spark.sql("SELECT * FROM VALUES ('k1'), ('k7'), ('k13') AS v(key)")
    tpl = spark.sql("SELECT 'tpl' AS template")
    res = spark.sql("SELECT 9L AS host, 'x' AS owner_job_id")
    return pq.eligible_jobs(jobs, hosts.select("host", "tags", "held_keys"), CUT, excl, tpl, res), hosts


@query("eligible_jobs", "WIN12 AGG34", oracle(["jobs"], ELIG_JOBS + "\nSELECT host, class, count(*) AS jobs, count(DISTINCT group_id) AS job_groups, sum(cpu_min) AS cores FROM ej GROUP BY 1, 2"))
def eligible_jobs(spark, sf):
    return _eligible(spark, sf)[0].groupBy("host", "class").agg(F.count("*").alias("jobs"), F.countDistinct("group_id").alias("job_groups"), F.sum("cpu_min").alias("cores"))


POLICY_SQL = """
pol AS (SELECT * FROM (VALUES (0::BIGINT, 'test', 40.0::DOUBLE, 90.0::DOUBLE, 1.5::DOUBLE, 3.25::DOUBLE, true, 16.0::DOUBLE), (0, 'sim', 20.0, NULL, 0.5, 1.5, false, 16.0), (1, 'test', 30.0, 60.0, 4.0, 2.0, false, 16.0), (1, 'sim', 25.0, 50.0, 1.0, 2.5, true, 16.0), (2, 'test', 10.0, NULL, NULL, 0.0, true, 8.0), (2, 'sim', 10.0, NULL, NULL, 0.0, true, 8.0))
  v(host, class, floor_pct, cap_pct, used, vtime, active, budget)),
gx AS (SELECT group_id, parent_id, (group_id % 3)::INTEGER AS band, CASE WHEN group_id % 4 = 0 THEN created_ms + 1000 END AS last_claim_ms, created_ms AS aging_anchor_ms, round(urgency / 10000, 3) AS urgency, CASE WHEN group_id % 5 = 0 THEN created_ms + 86400000 END AS deadline_ms FROM groups WHERE state = 'active'),
px AS (SELECT parent_id, CASE WHEN parent_id % 3 = 0 THEN oldest_ms END AS last_claim_ms, CASE WHEN parent_id % 2 = 0 THEN oldest_ms ELSE oldest_ms - 3000000 END AS aging_anchor_ms, (parent_id % 100)::DOUBLE / 7 AS score_base FROM parents)"""


def _policies(spark):
    return spark.sql("""SELECT *, true AS enabled, 1.0D AS weight FROM VALUES (0L, 'test', 40.0D, 90.0D, 1.5D, 3.25D, true, 16.0D), (0L, 'sim', 20.0D, CAST(NULL AS DOUBLE), 0.5D, 1.5D, false, 16.0D), (1L, 'test', 30.0D, 60.0D, 4.0D, 2.0D, false, 16.0D),
      (1L, 'sim', 25.0D, 50.0D, 1.0D, 2.5D, true, 16.0D), (2L, 'test', 10.0D, NULL, CAST(NULL AS DOUBLE), 0.0D, true, 8.0D), (2L, 'sim', 10.0D, NULL, NULL, 0.0D, true, 8.0D) AS v(host, class, floor_pct, cap_pct, used, vtime, active, budget)""")


FLOOR_SQL = """
cj AS (SELECT e.*, g.parent_id, g.band, g.last_claim_ms AS g_last, coalesce(g.last_claim_ms, g.aging_anchor_ms) AS g_since, g.urgency, g.deadline_ms AS dl, p.score_base, coalesce(p.last_claim_ms, p.aging_anchor_ms) AS since_p FROM ej e JOIN gx g ON g.group_id = e.group_id JOIN px p ON p.parent_id = g.parent_id),
rho AS (SELECT host, class, max(band) AS rk FROM cj GROUP BY 1, 2),
wn AS (SELECT DISTINCT host, class, band AS rank FROM cj),
fl AS (SELECT w.host, w.class, w.rank, coalesce(sum(CASE WHEN (p.class <> w.class AND r.rk >= w.rank) OR (p.class = w.class AND w.rank < r.rk) THEN greatest(0, floor_pct / 100 * budget - coalesce(used, 0)) END), 0)::DOUBLE AS reserved
  FROM wn w LEFT JOIN pol p ON p.host = w.host LEFT JOIN rho r ON r.host = p.host AND r.class = p.class GROUP BY 1, 2, 3)"""
CLAIM_NOW = 1_704_067_000_000


def _groups_parents(spark, sf):
    g = flat(spark, sf, "groups").filter("state = 'active'").selectExpr("group_id", "parent_id", "CAST(group_id % 3 AS INT) AS band", "if(group_id % 4 = 0, created_ms + 1000, NULL) AS last_claim_ms", "created_ms AS aging_anchor_ms",
                                                                      "round(urgency / 10000, 3) AS urgency", "if(group_id % 5 = 0, created_ms + 86400000, NULL) AS deadline_ms")
    p = flat(spark, sf, "parents").selectExpr("parent_id", "if(parent_id % 3 = 0, oldest_ms, NULL) AS last_claim_ms", "if(parent_id % 2 = 0, oldest_ms, oldest_ms - 3000000) AS aging_anchor_ms", "CAST(parent_id % 100 AS DOUBLE) / 7 AS score_base")
    return g, p


@query("unmet_floors", "AGG36", oracle(["jobs", "groups", "parents"], ELIG_JOBS + "," + POLICY_SQL + "," + FLOOR_SQL + "\nSELECT host, class, rank, round(reserved, 6) AS reserved FROM fl"))
def unmet_floors(spark, sf):
    e, _ = _eligible(spark, sf)
    g, p = _groups_parents(spark, sf)
    c = e.join(g, "group_id").join(p.select("parent_id"), "parent_id")
    out = pq.unmet_floors(_policies(spark), c.groupBy("host", "class").agg(F.max("band").alias("best_rank")), c.select("host", "class", F.col("band").alias("rank")).distinct())
    return out.withColumn("reserved", F.round("reserved", 6))


@query("parent_claim_ranking", "WIN11 WIN12 AGG36", oracle(["jobs", "groups", "parents"], ELIG_JOBS + "," + POLICY_SQL + "," + FLOOR_SQL + f""",
ft0 AS (SELECT c.*, p.vtime, p.active, {CLAIM_NOW} - since_p >= 1200000 AS p_overdue, {CLAIM_NOW} - g_since >= 1200000 AS g_overdue, c.free - f.reserved AS held_room, coalesce(cap_pct / 100 * budget - coalesce(used, 0), 1e18) AS cap FROM cj c JOIN pol p ON p.host = c.host AND p.class = c.class JOIN fl f ON f.host = c.host AND f.class = c.class AND f.rank = c.band),
ft1 AS (SELECT *, row_number() OVER (PARTITION BY host, group_id, class ORDER BY p_overdue AND exclusive, est_p50_s DESC, seq) AS rn FROM ft0 WHERE cpu_min <= least(CASE WHEN p_overdue AND NOT exclusive THEN free ELSE held_room END, cap) AND memory <= 9e9),
ft2 AS (SELECT *, p_overdue AND NOT exclusive AS overdue, score_base + max(urgency) OVER (PARTITION BY host, parent_id) AS score FROM ft1 WHERE rn = 1),
rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, parent_id, class ORDER BY p_overdue AND exclusive, g_overdue DESC, CASE WHEN g_overdue THEN g_since END NULLS LAST, urgency DESC, g_since, dl NULLS LAST, g_last NULLS FIRST, est_p50_s DESC, seq, group_id) AS r2 FROM ft2) z WHERE r2 = 1),
sd AS (SELECT *, CASE WHEN active THEN vtime ELSE greatest(vtime, coalesce(min(CASE WHEN active THEN vtime END) OVER (PARTITION BY host), vtime)) END AS ev FROM rp),
fn AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY overdue DESC, CASE WHEN overdue THEN since_p END NULLS LAST, CASE WHEN overdue THEN parent_id END NULLS LAST, band DESC, round(ev, 9), score DESC, dl NULLS LAST, g_last NULLS FIRST, est_p50_s DESC, seq, group_id) AS r3 FROM sd)
SELECT host, job_id, group_id, parent_id, class, overdue, round(score, 6) AS score FROM fn WHERE r3 = 1"""))
def parent_claim_ranking(spark, sf):
    e, hosts = _eligible(spark, sf)
    g, p = _groups_parents(spark, sf)
    return pq.parent_claim_ranking(e.drop("tags", "held_keys"), g, p, _policies(spark), hosts, CLAIM_NOW)


REM_SQL = """
fac AS (SELECT h::BIGINT AS host, c AS class, b AS bucket, (1 + h)::DOUBLE / 2 AS factor FROM (SELECT unnest([0, 1, 2, 3]) AS h) a, (SELECT unnest(['test', 'sim']) AS c) b1, (SELECT unnest(['short', 'long']) AS b) c1),
rj AS (SELECT j.*, g.parent_id, CASE WHEN est_p50_s < 120 THEN 'short' WHEN est_p50_s <= 600 THEN 'mid' ELSE 'long' END AS bucket FROM jobs j JOIN groups g ON g.group_id = j.group_id AND g.state = 'active' WHERE lower(j.state) IN ('queued', 'running')),
rf AS (SELECT r.*, coalesce(factor, 1) AS f FROM rj r LEFT JOIN fac ON fac.host = r.host AND fac.class = r.class AND fac.bucket = r.bucket),
rem AS (SELECT parent_id, class, bucket, sum(CASE WHEN lower(state) <> 'running' THEN est_p50_s WHEN elapsed_s / f > est_p90_s THEN least(elapsed_s / f / 2, greatest((max_ms / 1000 - elapsed_s) / f, 0)) ELSE greatest(est_p50_s - elapsed_s / f, 0) END) AS ref_s FROM rf GROUP BY 1, 2, 3)"""


def _factors(spark):
    return spark.sql("SELECT CAST(h AS BIGINT) AS host, c AS class, b AS bucket, CAST(1 + h AS DOUBLE) / 2 AS factor FROM (SELECT explode(array(0, 1, 2, 3)) AS h) CROSS JOIN (SELECT explode(array('test', 'sim')) AS c) CROSS JOIN (SELECT explode(array('short', 'long')) AS b)")


@query("remaining_work", "AGG32 JON10 SCL15", oracle(["jobs", "groups"], REM_SQL + "\nSELECT parent_id, class, bucket, round(ref_s, 4) AS ref_s FROM rem"))
def remaining_work(spark, sf):
    return pq.remaining_work(flat(spark, sf, "jobs"), flat(spark, sf, "groups"), _factors(spark)).withColumn("ref_s", F.round("ref_s", 4))


@query("remaining_work_map", "AGG32", oracle(["jobs", "groups"], REM_SQL + "\nSELECT parent_id, count(DISTINCT class) AS classes, count(*) AS cells, round(coalesce(sum(ref_s) FILTER (class = 'sim' AND bucket = 'mid'), 0), 4) AS sim_mid_s FROM rem GROUP BY 1"))
def remaining_work_map(spark, sf):
    m = pq.remaining_map(pq.remaining_work(flat(spark, sf, "jobs"), flat(spark, sf, "groups"), _factors(spark)))
    cells = F.aggregate(F.map_values("remaining"), F.lit(0).cast("long"), lambda a, b: a + F.size(b))
    return m.select("parent_id", F.size("remaining").cast("long").alias("classes"), cells.alias("cells"),
                    F.round(F.coalesce(F.try_element_at(F.try_element_at("remaining", F.lit("sim")), F.lit("mid")), F.lit(0.0)), 4).alias("sim_mid_s"))


@query("remaining_minutes", "AGG33 JON10", oracle(["jobs", "groups"], REM_SQL + """
SELECT parent_id, h.host, round(sum(ref_s * coalesce(factor, 1)) / 60, 4) AS minutes FROM rem CROSS JOIN (SELECT DISTINCT host FROM fac) h LEFT JOIN fac f ON f.host = h.host AND f.class = rem.class AND f.bucket = rem.bucket GROUP BY 1, 2"""))
def remaining_minutes(spark, sf):
    f = _factors(spark)
    return pq.remaining_minutes(pq.remaining_work(flat(spark, sf, "jobs"), flat(spark, sf, "groups"), f), f, f.select("host").distinct()).withColumn("minutes", F.round("minutes", 4))


@query("parent_usage", "AGG35 SCL14", oracle(["parents", "jobs", "groups"], REM_SQL + """,
mn AS (SELECT parent_id, sum(ref_s) / 60 AS minutes FROM rem GROUP BY 1),
u AS (SELECT p.*, (1704067200000 - usage_at_ms) / 1000.0::DOUBLE AS dt, minutes FROM parents p LEFT JOIN mn ON mn.parent_id = p.parent_id),
v AS (SELECT *, running_cores + (usage_core_s * power(0.5, dt / 1800) + running_cores * (1800 / ln(2::DOUBLE)) * (1 - power(0.5, dt / 1800))) / 1800 AS cores FROM u)
SELECT parent_id, round(cores, 5) AS cores, round(least(100, 5 * greatest(0, (1704067200000 - oldest_ms) / 1000.0::DOUBLE) / 60) + 40 / (1 + cores / 4) + least(60, 6 * (1 + parent_id % 4) / greatest(coalesce(minutes, 0), 0.5)), 4) AS score,
  interactive AND (cores > 5 OR (was_demoted AND cores >= 4)) AS demoted FROM v"""))
def parent_usage(spark, sf):
    rem = pq.remaining_work(flat(spark, sf, "jobs"), flat(spark, sf, "groups"), _factors(spark)).groupBy("parent_id").agg((F.sum("ref_s") / 60).alias("minutes"))
    p = flat(spark, sf, "parents").withColumns({"since_ms": F.col("oldest_ms"), "cost_per_min": (1 + F.col("parent_id") % 4).cast("double")})
    return pq.parent_usage(p, rem, 1704067200000, 5.0).withColumns({"cores": F.round("cores", 5), "score": F.round("score", 4)})


ORDER_SQL = """
qv AS (SELECT snapshot, host, ticket_id AS idx, ticket_id, ticket_id % 401 <> 0 AS readable, (priority * 37 % 100)::DOUBLE / 50 AS score, CASE WHEN ticket_id % 3 = 0 THEN 1 ELSE 0 END AS sim_rank, ticket_id % 3 = 0 AS is_sim, ticket_id // 7 AS seq, ticket_id % 5 <> 2 AS eligible, ticket_id % 90 = 4 AS res FROM tickets),
qb AS (SELECT *, sum((NOT readable)::INT) OVER (PARTITION BY snapshot, host ORDER BY idx) - (NOT readable)::INT AS barrier FROM qv),
qo AS (SELECT *, row_number() OVER (PARTITION BY snapshot, host ORDER BY barrier, NOT readable, score DESC, sim_rank, seq, idx) AS position FROM qb),
ft AS (SELECT snapshot, host, min(position) AS first_test FROM qo WHERE readable AND NOT is_sim GROUP BY 1, 2),
ow AS (SELECT q.snapshot, q.host, min((seq * -1, ticket_id, position)) AS o FROM qo q LEFT JOIN ft ON ft.snapshot = q.snapshot AND ft.host = q.host WHERE res AND barrier = 0 AND readable AND (NOT is_sim OR first_test IS NULL OR position < first_test) GROUP BY 1, 2),
pp AS (SELECT q.*, o[2] AS owner_id, CASE WHEN q.ticket_id = o[2] THEN 1 WHEN q.position < o[3] THEN q.position + 1 ELSE q.position END AS pos2 FROM qo q LEFT JOIN ow ON ow.snapshot = q.snapshot AND ow.host = q.host)"""


def _queue(spark, sf):
    return flat(spark, sf, "tickets").selectExpr("snapshot", "host", "ticket_id AS idx", "ticket_id", "ticket_id % 401 <> 0 AS readable", "CAST(priority * 37 % 100 AS DOUBLE) / 50 AS score", "if(ticket_id % 3 = 0, 1, 0) AS sim_rank",
                                                "ticket_id % 3 = 0 AS is_sim", "ticket_id div 7 AS seq", "ticket_id % 5 <> 2 AS eligible", "ticket_id % 90 = 4 AS res")


@query("queue_order", "WIN08 SCL11", oracle(["tickets"], ORDER_SQL + "\nSELECT snapshot, host, ticket_id, position FROM qo"))
def queue_order(spark, sf):
    return pq.queue_order(_queue(spark, sf)).select("snapshot", "host", "ticket_id", "position")


def _promoted(spark, sf):
    qo = pq.queue_order(_queue(spark, sf))
    return pq.promote_owner(qo, _queue(spark, sf).filter("res").selectExpr("snapshot", "host", "ticket_id", "-seq AS res_seq"))


@query("queue_owner_promotion", "WIN09", oracle(["tickets"], ORDER_SQL + "\nSELECT snapshot, host, ticket_id, owner_id, pos2 AS position FROM pp"))
def queue_owner_promotion(spark, sf):
    return _promoted(spark, sf).select("snapshot", "host", "ticket_id", "owner_id", "position")


@query("queue_facts", "WIN16", oracle(["tickets"], ORDER_SQL + """
SELECT snapshot, host, ticket_id, row_number() OVER (PARTITION BY snapshot, host ORDER BY pos2) AS position, owner_id, owner_id IS NOT NULL AND owner_id <> ticket_id AS behind_other_owner, CASE WHEN owner_id <> ticket_id THEN owner_id * 10 END AS owner_waited_ms FROM pp WHERE readable AND eligible"""))
def queue_facts(spark, sf):
    return pq.queue_facts(_promoted(spark, sf), _queue(spark, sf).selectExpr("snapshot", "host", "ticket_id", "ticket_id * 10 AS waited_ms"))


LEASE_SQL = """
ls AS (SELECT ticket_id, snapshot, host, CASE WHEN ticket_id % 4 = 0 THEN 'sim' ELSE 'test' END AS class, CASE ticket_id % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'ORPHANED' ELSE 'STARTING' END AS state, ticket_id % 29 = 0 AS synthetic, weight, weight * 0.5::DOUBLE AS demand, weight AS cores, weight * 1e9::DOUBLE AS memory,
  CASE WHEN ticket_id % 5 <> 0 THEN ticket_id % 600 * 1000 END AS log_age_ms, CASE WHEN ticket_id % 6 <> 0 THEN (ticket_id % 12) * 1e9::DOUBLE END AS peak_memory FROM tickets WHERE state IN ('running', 'claimed')),
qs AS (SELECT snapshot, host, ticket_id, CASE WHEN ticket_id % 4 = 0 THEN 'sim' ELSE 'test' END AS class, weight AS claim, weight * 1e9::DOUBLE AS memory, ticket_id % 31 = 0 AS required FROM tickets WHERE state = 'queued'),
bd AS (SELECT DISTINCT snapshot, host, 64.0::DOUBLE AS budget, snapshot % 2 = 0 AS armed FROM tickets),
cu AS (SELECT b.snapshot, b.host, c.class, coalesce(l.used, 0)::DOUBLE AS used, coalesce(l.bc, 0)::DOUBLE AS booked_cores, coalesce(l.bm, 0)::DOUBLE AS booked_memory, coalesce(q.queued, 0)::DOUBLE AS queued, coalesce(l.n, 0) AS booked,
    CASE WHEN c.class = 'test' THEN 0.15::DOUBLE * budget WHEN armed THEN 0.3::DOUBLE * budget ELSE 0 END AS target
  FROM bd b CROSS JOIN (VALUES ('test'), ('sim')) c(class) LEFT JOIN (SELECT snapshot, host, class, sum(CASE WHEN state IN ('RUNNING', 'ORPHANED') AND NOT synthetic THEN demand ELSE 0 END) AS used, sum(cores) AS bc, sum(memory) AS bm, count(*) AS n FROM ls GROUP BY 1, 2, 3) l
  ON l.snapshot = b.snapshot AND l.host = b.host AND l.class = c.class LEFT JOIN (SELECT snapshot, host, class, sum(claim) AS queued FROM qs GROUP BY 1, 2, 3) q ON q.snapshot = b.snapshot AND q.host = b.host AND q.class = c.class)"""


def _leases(spark, sf):
    return flat(spark, sf, "tickets").filter("state IN ('running', 'claimed')").selectExpr(
        "ticket_id", "snapshot", "host", "if(ticket_id % 4 = 0, 'sim', 'test') AS class", "CASE ticket_id % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'ORPHANED' ELSE 'STARTING' END AS state", "ticket_id % 29 = 0 AS synthetic", "weight", "weight * 0.5D AS demand",
        "weight AS cores", "weight * 1e9D AS memory", "if(ticket_id % 5 <> 0, ticket_id % 600 * 1000, NULL) AS log_age_ms", "if(ticket_id % 6 <> 0, (ticket_id % 12) * 1e9D, NULL) AS peak_memory")


def _queued(spark, sf):
    return flat(spark, sf, "tickets").filter("state = 'queued'").selectExpr("snapshot", "host", "ticket_id", "if(ticket_id % 4 = 0, 'sim', 'test') AS class", "weight AS claim", "weight AS cores", "weight * 1e9D AS memory", "ticket_id % 31 = 0 AS required")


def _snaps(spark, sf, *exprs):
    return flat(spark, sf, "tickets").select("snapshot", "host").distinct().selectExpr("snapshot", "host", *exprs)


def _usage(spark, sf):
    return pq.class_usage(_leases(spark, sf), _queued(spark, sf), _snaps(spark, sf, "64.0D AS budget", "snapshot % 2 = 0 AS armed"))


@query("class_usage", "AGG37", oracle(["tickets"], LEASE_SQL + "\nSELECT * FROM cu"))
def class_usage(spark, sf):
    return _usage(spark, sf)


@query("sim_cap_verdicts", "AGG38", oracle(["tickets"], LEASE_SQL + """,
j AS (SELECT q.*, c.booked, c.booked_cores, c.booked_memory, q.snapshot <> 1 AS active, q.snapshot <> 2 AS valid, CASE WHEN q.snapshot = 0 THEN 10 ELSE 100000 END AS mt, CASE WHEN q.snapshot = 3 THEN 100 ELSE 1e9 END AS cc FROM qs q LEFT JOIN cu c ON c.snapshot = q.snapshot AND c.host = q.host AND c.class = 'sim')
SELECT snapshot, host, ticket_id, CASE WHEN required AND NOT (active AND valid) THEN 'enforcement-unavailable' WHEN class <> 'sim' THEN NULL WHEN NOT valid THEN 'config-invalid' WHEN booked >= mt THEN 'max-tickets' WHEN booked_cores + claim > cc THEN 'cap-cores'
  WHEN booked_memory + memory > 1e11 + snapshot * 1e12 THEN 'cap-memory' WHEN claim > least(cc, 400.0 - 3.0) - booked_cores THEN 'test-reserve' END AS reason FROM j"""))
def sim_cap_verdicts(spark, sf):
    pol = _snaps(spark, sf, "snapshot <> 1 AS active", "snapshot <> 2 AS valid", "if(snapshot = 0, 10, 100000) AS max_tickets", "if(snapshot = 3, 100D, 1e9D) AS cap_cores", "1e11D + snapshot * 1e12D AS cap_memory", "3.0D AS reserve_cores", "400.0D AS budget")
    return pq.sim_cap_verdicts(_queued(spark, sf), _usage(spark, sf), pol)


@query("fleet_occupancy", "AGG42", oracle(["tickets"], LEASE_SQL + """
SELECT b.snapshot, b.host, coalesce(sum(weight), 0) AS running_weight, coalesce(sum(cores), 0) AS reserved_cores, coalesce(sum(memory), 0) AS reserved_memory, 52.0::DOUBLE AS budget, count(*) FILTER (log_age_ms > 300000) AS stale_logs,
  count(*) FILTER (peak_memory > memory) AS over_memory, count(l.ticket_id) AS leases FROM bd b LEFT JOIN ls l ON l.snapshot = b.snapshot AND l.host = b.host GROUP BY 1, 2"""))
def fleet_occupancy(spark, sf):
    return pq.occupancy(_leases(spark, sf), _snaps(spark, sf, "64.0D AS capacity_cores", "90.0D AS percent", "12.0D AS reserve"))


@query("memory_projection", "AGG44", oracle(["tickets"], LEASE_SQL + """,
m AS (SELECT b.snapshot, b.host, coalesce(sum(greatest(0, memory - CASE WHEN log_age_ms <= 30000 AND peak_memory IS NOT NULL THEN peak_memory ELSE 0 END)), 0) AS growth, coalesce(sum(memory), 0) AS reserved FROM bd b LEFT JOIN ls l ON l.snapshot = b.snapshot AND l.host = b.host GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN snapshot <> 4 THEN 2e12::DOUBLE END AS available, CASE WHEN snapshot = 1 THEN 5e11::DOUBLE WHEN snapshot = 2 THEN NULL ELSE 9e13::DOUBLE END AS total FROM m)
SELECT snapshot, host, growth, available - growth - 4e9::DOUBLE AS projected, CASE WHEN available IS NULL THEN 'memory-unavailable' WHEN total IS NOT NULL AND reserved + 4e9 > greatest(0, total - 1e9) THEN 'memory-reservations' WHEN available - growth - 4e9 < 1e9 THEN 'memory-headroom' ELSE 'ok' END AS verdict FROM h"""))
def memory_projection(spark, sf):
    hosts = _snaps(spark, sf, "if(snapshot <> 4, 2e12D, NULL) AS available", "CASE WHEN snapshot = 1 THEN 5e11D WHEN snapshot = 2 THEN NULL ELSE 9e13D END AS total", "1e9D AS reserve", "4e9D AS claim")
    return pq.memory_projection(_leases(spark, sf).selectExpr("snapshot", "host", "memory AS booked", "peak_memory AS observed", "log_age_ms AS observed_age_ms"), hosts)


@query("lease_expiry", "STR11 SCL25", oracle(["tickets"], f"""
t AS (SELECT *, created_ms + 3000000 AS lu, {EARLY} + snapshot * 1000000000 AS now_ms, snapshot = 3 AS amnesty FROM tickets WHERE state IN ('claimed', 'running')),
u AS (SELECT *, CASE WHEN amnesty THEN greatest(lu, now_ms + 120000) ELSE lu END AS lease_until_ms FROM t)
SELECT snapshot, ticket_id, CASE WHEN state = 'claimed' AND lease_until_ms < now_ms THEN CASE WHEN ticket_id % 17 = 0 THEN 'cancelled' WHEN requeues >= 5 THEN 'lost' ELSE 'queued' END WHEN state = 'running' AND lease_until_ms + 7080000 < now_ms THEN 'lost' ELSE 'kept' END AS verdict,
  CASE WHEN state = 'claimed' AND lease_until_ms < now_ms AND ticket_id % 17 <> 0 AND requeues < 5 THEN now_ms + CAST(least(5000 * power(2, requeues), 60000) AS BIGINT) END AS not_before_ms, lease_until_ms FROM u"""))
def lease_expiry(spark, sf):
    t = flat(spark, sf, "tickets").selectExpr("snapshot", "ticket_id", "state", "created_ms + 3000000 AS lease_until_ms", "requeues", "ticket_id % 17 = 0 AS cancel_requested")
    ticks = flat(spark, sf, "tickets").select("snapshot").distinct().selectExpr("snapshot", f"{EARLY} + snapshot * 1000000000L AS now_ms", f"{EARLY} + snapshot * 1000000000L - if(snapshot = 3, 90000L, 5000L) AS last_tick_ms")
    return pq.lease_expiry(t, ticks)


ETA = "SELECT user_id AS group_id, event_id AS cycle, CAST(1704067200000 + (user_id + 3) * 40000000 AS BIGINT) AS deadline_ms, 1704067200000 + event_id * 40000 AS now_ms, value * 30 AS eta_p90_s, event_id % 4 = 0 AS low_confidence FROM {events}"


@query("damped_urgency", "STR18 P09", f"""WITH RECURSIVE e AS ({ETA.replace('{events}', 'events')}),
x AS (SELECT *, (deadline_ms - now_ms) / 1000.0::DOUBLE - eta_p90_s AS slack, greatest(900, eta_p90_s / 2) AS s0, (deadline_ms - now_ms) / 1000.0::DOUBLE AS bare, row_number() OVER (PARTITION BY group_id ORDER BY cycle) AS rn FROM e),
y AS (SELECT *, CASE WHEN low_confidence THEN 0.5::DOUBLE ELSE 1 END * 150 * least(1, greatest(0, 1 - slack / s0)) AS raw, CASE WHEN bare < 0 THEN 75 ELSE 150 * least(1, greatest(0, 1 - bare / 900)) END AS st FROM x),
z AS (SELECT group_id, cycle, rn, slack < s0 AS on_, CASE WHEN slack < s0 THEN rn END AS flip, st + least(25, greatest(-25, CASE WHEN slack < s0 THEN raw ELSE 0 END - st)) AS u FROM y WHERE rn = 1
  UNION ALL SELECT group_id, cycle, rn, on2, CASE WHEN on2 <> pon THEN rn ELSE pflip END, pu + least(25, greatest(-25, CASE WHEN on2 THEN raw ELSE 0 END - pu)) FROM (
    SELECT y.*, z.on_ AS pon, z.flip AS pflip, z.u AS pu, CASE WHEN want <> z.on_ AND z.flip IS NOT NULL AND y.rn - z.flip < 3 THEN z.on_ ELSE want END AS on2
    FROM (SELECT z.group_id AS zg, z.rn AS zr, z.on_, z.flip, z.u FROM z) z JOIN y ON y.group_id = zg AND y.rn = zr + 1, LATERAL (SELECT CASE WHEN z.on_ THEN NOT (y.slack > 1.25 * y.s0) ELSE y.slack < y.s0 END AS want) w) q)
SELECT group_id, cycle, round(u, 6) AS urgency, on_ AS boosted FROM z""")
def damped_urgency(spark, sf):
    return pq.damped_urgency(spark.sql(ETA, events=spark.read.parquet(f"{sf}/events.parquet")), slice_cycles=700, slice_rows=60).withColumn("urgency", F.round("urgency", 6))
