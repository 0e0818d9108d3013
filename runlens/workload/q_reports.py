"""Run-history reports over the derived history, journal and PR views."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans import reports
from runlens.workload.registry import query
from runlens.workload.views import flat, history, oracle

SINCE, UNTIL = 788918400000.0, 1706140800000.0
REPOS = ["foo", "bar"]
NOW = 1_000_000_000_000.0

IS_FOO = "(repo LIKE '%\\_proj\\_foo\\_.git' ESCAPE '\\' OR repo LIKE '%\\_merge-train\\_foo\\_clone\\_.git' ESCAPE '\\')"
IS_BAR = "(repo LIKE '%\\_proj\\_bar\\_.git' ESCAPE '\\' OR repo LIKE '%\\_merge-train\\_bar\\_clone\\_.git' ESCAPE '\\')"
WINDOW = f"started_at >= {SINCE:.0f} AND started_at < {UNTIL:.0f}"
DEDUPE = "(id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"

PHASE_ROWS = f"""
ph AS (SELECT coalesce(runner, 'unknown') AS r, * FROM (SELECT *, {DEDUPE} AS keep FROM history
  WHERE executor = 'remote' AND has_phases AND ({IS_FOO} OR {IS_BAR}) AND {WINDOW}) x WHERE keep)"""
_COLS = [("uploadMs", "upload_ms"), ("queuedMs", "queued_ms"), ("snapshotMs", "snapshot_ms"), ("depsMs", "deps_ms"), ("setupMs", "setup_ms"),
         ("commandMs", "command_ms"), ("artifactsMs", "artifacts_ms"), ("artifactReturnMs", "artifact_return_ms")]


@query("phases_per_runner", "AGG07 P01 P03 P04 P05", oracle(["history"], PHASE_ROWS + "\n" + "\nUNION ALL\n".join(
    f"SELECT r AS runner, count(*) AS runs, '{p}' AS phase, count({c}) AS n, quantile_disc({c}, 0.5) AS p50, quantile_disc({c}, 0.9) AS p90, max({c}) AS max FROM ph GROUP BY r"
    for p, c in _COLS)))
def phases_per_runner(spark, sf):
    return reports.phases_report(history(spark, sf), REPOS, SINCE, UNTIL)


@query("phase_overhead", "AGG07", oracle(["history"], PHASE_ROWS + """
SELECT r AS runner, count(*) AS runs,
  round(sum(CASE WHEN command_ms IS NOT NULL THEN coalesce(snapshot_ms, 0) + coalesce(deps_ms, 0) + coalesce(setup_ms, 0) END)
    / sum(CASE WHEN command_ms IS NOT NULL THEN coalesce(snapshot_ms, 0) + coalesce(deps_ms, 0) + coalesce(setup_ms, 0) + command_ms + coalesce(artifacts_ms, 0) END), 6) AS overhead_share,
  count(*) FILTER (deps_cache = 'hit') AS hits, count(*) FILTER (deps_cache = 'miss') AS misses, count(*) FILTER (deps_cache = 'fallback') AS fallbacks
FROM ph GROUP BY r"""))
def phase_overhead(spark, sf):
    out = reports.phase_overhead(history(spark, sf), REPOS, SINCE, UNTIL)
    return out.select("runner", "runs", F.round("overhead_share", 6).alias("overhead_share"), *[
        F.coalesce(F.try_element_at("depsCache", F.lit(k)), F.lit(0)).alias(n) for k, n in [("hit", "hits"), ("miss", "misses"), ("fallback", "fallbacks")]])


_LOST = "('runner-lost', 'runner-offline', 'runner-shutdown', 'runner-never-started', 'never-dispatched')"


@query("losses_per_runner", "AGG06", oracle(["history"], f"""
w AS (SELECT * FROM history WHERE {WINDOW} AND ({IS_FOO} OR {IS_BAR})),
legs AS (
  SELECT coalesce(runner, 'unknown') AS runner, 'lost' AS kind, reason, CASE WHEN ended_at >= started_at THEN ended_at - started_at ELSE 0 END AS ms
    FROM w WHERE executor = 'remote' AND reason IN {_LOST}
  UNION ALL SELECT unnest(redispatched_from), 'redispatched', redispatch_reason, 0 FROM w WHERE redispatch_reason IS NOT NULL
  UNION ALL SELECT coalesce(runner, 'unknown'), 'fallback', substr(local_reason, 10), 0 FROM w
    WHERE executor = 'local' AND local_reason IN ('fallback:runner-shutdown', 'fallback:runner-lost', 'fallback:runner-offline'))
SELECT runner, kind, reason, count(*) AS n, floor(sum(ms) / 3600000 * 10 + 0.5) / 10 AS lane_hours FROM legs GROUP BY GROUPING SETS ((runner, kind, reason), (kind))"""))
def losses_per_runner(spark, sf):
    return reports.losses_report(history(spark, sf), REPOS, SINCE, UNTIL)


@query("placement_accuracy", "AGG08 SCL13", oracle(["history"], f"""
p AS (SELECT * FROM (SELECT *, {DEDUPE} AS keep FROM history WHERE executor = 'remote' AND placed_runner IS NOT NULL AND placed_runner = runner AND {WINDOW}) x WHERE keep),
s AS (SELECT runner, coalesce(exit_code, 1) = 0 AS green,
  CASE WHEN predicted_wait_ms >= 0 AND queued_ms >= 0 THEN predicted_wait_ms END AS wp, CASE WHEN predicted_wait_ms >= 0 AND queued_ms >= 0 THEN queued_ms END AS wa,
  CASE WHEN coalesce(exit_code, 1) = 0 AND predicted_run_ms >= 0 AND run_ms >= 0 THEN predicted_run_ms END AS rp,
  CASE WHEN coalesce(exit_code, 1) = 0 AND predicted_run_ms >= 0 AND run_ms >= 0 THEN run_ms END AS ra FROM p),
t AS (SELECT *, (wp + 30000) / (wa + 30000) AS wr, (rp + 30000) / (ra + 30000) AS rr FROM s)
SELECT runner, count(*) AS placements, count(*) FILTER (NOT green) AS non_green, count(wr) AS wait_n, count(rr) AS run_n,
  quantile_disc(wp, 0.5) AS wait_pred_p50, quantile_disc(wa, 0.5) AS wait_act_p50, round(quantile_disc(wr, 0.5), 6) AS wait_ratio_p50,
  quantile_disc(rp, 0.5) AS run_pred_p50, quantile_disc(ra, 0.5) AS run_act_p50, round(quantile_disc(rr, 0.5), 6) AS run_ratio_p50,
  count(*) FILTER (wr > 2) AS wait_over2x, count(*) FILTER (wr < 0.5) AS wait_under2x, count(*) FILTER (rr > 2) AS run_over2x, count(*) FILTER (rr < 0.5) AS run_under2x
FROM t GROUP BY GROUPING SETS ((runner), ())"""))
def placement_accuracy(spark, sf):
    out = reports.placement_report(history(spark, sf), SINCE, UNTIL)
    return out.withColumns({c: F.round(c, 6) for c in ("wait_ratio_p50", "run_ratio_p50")})


FACTS = f"""
ev AS (SELECT * FROM journal WHERE t_ms < {UNTIL:.0f}),
lanes AS (SELECT repo, lane_id, bool_or(starts_with(run_id, 'master-')) AS is_master, bool_or(NOT starts_with(run_id, 'master-')) AS is_train FROM ev WHERE event = 'lane-start' GROUP BY 1, 2),
joined_batches AS (SELECT repo, ord, t_ms, event, last_value(CASE WHEN event = 'batch-built' THEN prs END IGNORE NULLS) OVER (PARTITION BY repo, run_id ORDER BY ord) AS batch
  FROM ev WHERE event IN ('batch-built', 'landed')),
landings AS (SELECT repo, ord, t_ms, unnest(batch) AS pr FROM joined_batches WHERE event = 'landed'),
landed AS (SELECT repo, pr, arg_min(t_ms, ord) AS landed_ms, min(ord) AS landed_ord FROM landings GROUP BY 1, 2),
removed AS (SELECT e.repo, e.pr, max(e.ord) AS removed_ord FROM ev e LEFT JOIN landed l ON l.repo = e.repo AND l.pr = e.pr
  WHERE e.event IN ('remove', 'drop') AND (l.landed_ord IS NULL OR e.ord < l.landed_ord) GROUP BY 1, 2),
enq AS (SELECT e.repo, e.pr, arg_min(e.t_ms, e.ord) AS enqueued_ms FROM ev e LEFT JOIN removed r ON r.repo = e.repo AND r.pr = e.pr
  WHERE e.event = 'enqueue' AND (r.removed_ord IS NULL OR e.ord > r.removed_ord) GROUP BY 1, 2),
gh AS (SELECT repo, number AS pr, CASE WHEN merged_ms >= {SINCE:.0f} AND merged_ms < {UNTIL:.0f} THEN merged_ms END AS merged_ms,
    CASE WHEN merged_ms IS NULL AND list_contains(labels, 'train-landed') AND closed_ms >= {SINCE:.0f} AND closed_ms < {UNTIL:.0f} THEN closed_ms END AS train_ms FROM prs),
un AS (SELECT coalesce(j.repo, g.repo) AS repo, coalesce(j.pr, g.pr) AS pr, j.landed_ms AS journal_ms, g.merged_ms, g.train_ms, coalesce(j.landed_ms, g.merged_ms, g.train_ms) AS at_ms
  FROM (SELECT * FROM landed WHERE landed_ms >= {SINCE:.0f}) j FULL JOIN (SELECT * FROM gh WHERE merged_ms IS NOT NULL OR train_ms IS NOT NULL) g ON g.repo = j.repo AND g.pr = j.pr),
counts AS (SELECT repo, count(merged_ms) AS github_merged, count(train_ms) AS github_train_landed, count(journal_ms) AS journal_landed, count(*) AS "union",
    count(*) FILTER (journal_ms IS NOT NULL AND merged_ms IS NULL AND train_ms IS NULL) AS only_journal, count(*) FILTER (journal_ms IS NULL) AS only_github,
    count(*) FILTER (isodow(make_timestamp(at_ms * 1000)) < 6) AS landed_weekday, count(*) FILTER (isodow(make_timestamp(at_ms * 1000)) >= 6) AS landed_weekend FROM un GROUP BY 1)"""
SPEND_SQL = f"""
rows0 AS (SELECT *, CASE WHEN {IS_FOO} THEN 'foo' ELSE 'bar' END AS rep, {DEDUPE} AS keep FROM history
  WHERE ended_at IS NOT NULL AND {WINDOW} AND ({IS_FOO} OR {IS_BAR})),
rows1 AS (SELECT r.*, coalesce(r.run_ms, r.ended_at - r.started_at) AS ms, coalesce(nullif(granted, 0), nullif(res_cpu, 0), nullif(weight, 0), 1) AS cores,
    CASE WHEN l.is_master THEN 'master-verify' WHEN l.is_train OR r.lane = 'train' THEN 'train-batch' WHEN r.lane = 'prepush' THEN 'gate' ELSE 'ad-hoc' END AS cls
  FROM (SELECT * FROM (SELECT *, id IS NULL OR row_number() OVER (PARTITION BY rep, id ORDER BY ord) = 1 AS keep2 FROM rows0) y WHERE keep2) r LEFT JOIN lanes l ON l.repo = r.rep AND l.lane_id = r.id),
classes AS (SELECT * FROM (VALUES ('foo'), ('bar')) a(repo), (VALUES ('gate'), ('train-batch'), ('master-verify'), ('ad-hoc')) b(cls)),
agg AS (SELECT rep AS repo, cls, count(*) AS runs, count(*) FILTER (exit_code <> 0) AS failed, sum(ms) / 60000 AS wall_min, sum(coalesce(waited_ms, 0)) / 60000 AS wait_min,
    sum(ms * cores) / 60000 AS reserved_core_min, sum(coalesce(cpu_seconds, 0)) AS cpu_seconds, count(cpu_seconds) AS cpu_runs FROM rows1 GROUP BY 1, 2),
full_agg AS (SELECT c.repo, c.cls, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, coalesce(wall_min, 0) AS wall_min, coalesce(wait_min, 0) AS wait_min,
    coalesce(reserved_core_min, 0) AS reserved_core_min, coalesce(cpu_seconds, 0) AS cpu_seconds, coalesce(cpu_runs, 0) AS cpu_runs FROM classes c LEFT JOIN agg a ON a.repo = c.repo AND a.cls = c.cls),
spend AS (SELECT * FROM full_agg UNION ALL SELECT repo, 'TOTAL', sum(runs)::BIGINT, sum(failed)::BIGINT, sum(wall_min), sum(wait_min), sum(reserved_core_min), sum(cpu_seconds), sum(cpu_runs)::BIGINT FROM full_agg GROUP BY 1)"""


def _cost(spark, sf):
    return reports.cost_report(history(spark, sf), flat(spark, sf, "journal"), flat(spark, sf, "prs"), REPOS, SINCE, UNTIL)


@query("cost_by_class", "AGG01 AGG02 JON01 P05", oracle(["history", "journal", "prs"], FACTS + "," + SPEND_SQL + """
SELECT repo, cls, runs, failed, round(wall_min, 6) AS wall_min, round(wait_min, 6) AS wait_min, round(reserved_core_min, 6) AS reserved_core_min, round(cpu_seconds, 6) AS cpu_seconds, cpu_runs FROM spend"""))
def cost_by_class(spark, sf):
    return _cost(spark, sf).spend.withColumns({c: F.round(c, 6) for c in ("wall_min", "wait_min", "reserved_core_min", "cpu_seconds")})


@query("cost_per_landed_pr", "AGG03", oracle(["history", "journal", "prs"], FACTS + "," + SPEND_SQL + """
SELECT s.repo, cls, round(runs / "union", 6) AS runs, round(wall_min / "union", 6) AS wall_min, round(wait_min / "union", 6) AS wait_min,
  round(reserved_core_min / "union", 6) AS reserved_core_min, round(cpu_seconds / "union", 6) AS cpu_seconds FROM spend s LEFT JOIN counts c ON c.repo = s.repo"""))
def cost_per_landed_pr(spark, sf):
    return _cost(spark, sf).per_pr.withColumns({c: F.round(c, 6) for c in ("runs", "wall_min", "wait_min", "reserved_core_min", "cpu_seconds")})


@query("cost_executor_mix", "AGG04", oracle(["history", "journal", "prs"], FACTS + "," + SPEND_SQL + """
SELECT rep AS repo, CASE WHEN executor = 'remote' THEN 'remote:' || coalesce(runner, '?') ELSE 'local' END AS executor, count(*) AS runs, round(sum(ms * cores) / 60000, 4) AS reserved_core_min FROM rows1 GROUP BY 1, 2"""))
def cost_executor_mix(spark, sf):
    return _cost(spark, sf).executors.withColumn("reserved_core_min", F.round("reserved_core_min", 4))


@query("cost_pr_counts", "AGG05 JON02 JON03 SET01", oracle(["journal", "prs"], FACTS + "\nSELECT * FROM counts"))
def cost_pr_counts(spark, sf):
    return _cost(spark, sf).counts


@query("cost_pr_latency", "JON04 WIN01 JON02", oracle(["journal", "prs"], FACTS + """,
w AS (SELECT l.repo, (l.landed_ms - e.enqueued_ms) / 60000 AS wait FROM landed l JOIN un u ON u.repo = l.repo AND u.pr = l.pr JOIN enq e ON e.repo = l.repo AND e.pr = l.pr),
s AS (SELECT repo, count(*) AS n, quantile_disc(wait, 0.5) AS p50, quantile_disc(wait, 0.9) AS p90, max(wait) AS max FROM w GROUP BY 1)
SELECT u.repo, coalesce(s.n, 0) AS n, round(p50, 6) AS p50, round(p90, 6) AS p90, round(max, 6) AS max, prs - coalesce(s.n, 0) AS prs_without_enqueue
FROM (SELECT repo, count(*) AS prs FROM un GROUP BY 1) u LEFT JOIN s ON s.repo = u.repo"""))
def cost_pr_latency(spark, sf):
    return _cost(spark, sf).latency.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "max")})


@query("cost_unfinished_prs", "JON05 ORD03 WIN01", oracle(["journal", "prs"], FACTS + f"""
SELECT e.repo, e.pr, e.enqueued_ms, round(({UNTIL:.0f} - e.enqueued_ms) / 60000, 6) AS age_min, e.enqueued_ms < {SINCE:.0f} AS before_window
FROM enq e WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.repo = e.repo AND l.pr = e.pr)"""))
def cost_unfinished_prs(spark, sf):
    return _cost(spark, sf).unfinished.withColumn("age_min", F.round("age_min", 6)).orderBy("repo", "pr")


DAYS = 2500
SUGGEST = f"""
r AS (SELECT *, coalesce(config_lane, lane) AS name, coalesce(res_cpu, weight) AS declared, coalesce(run_ms, ended_at - started_at) AS span,
    coalesce(res_cpu::BIGINT::VARCHAR || '.0', '-') AS sig0 FROM history
  WHERE (ended_at IS NULL OR ended_at >= {NOW:.0f} - {DAYS} * 86400000::BIGINT) AND started_at IS NOT NULL AND obs_mean IS NOT NULL AND obs_peak IS NOT NULL),
z AS (SELECT repo, name, count(*) < 5 AND max(coalesce(config_lane, '')) = '' AS pooled FROM r GROUP BY 1, 2),
g AS (SELECT r.*, CASE WHEN pooled THEN '(by resources)' ELSE r.name END AS glane, CASE WHEN pooled THEN 'resources' ELSE 'lane' END AS kind,
    CASE WHEN pooled THEN coalesce(res_cpu::VARCHAR, '-') || '|' || coalesce(res_memory::BIGINT::VARCHAR, '-') || '|' || coalesce(res_min_cpu::VARCHAR, '-') ELSE '' END AS sig
  FROM r JOIN z ON z.repo = r.repo AND z.name = r.name),
f AS (SELECT *, coalesce(granted > 0, false) AS elastic, ended_at IS NOT NULL AS finished, coalesce(declared > 0, false) AS usable FROM g),
f2 AS (SELECT *, finished AND (NOT elastic OR usable) AS scalable FROM f),
f3 AS (SELECT *, scalable AND span >= 120000 AS sustained, CASE WHEN elastic THEN obs_mean / granted * declared ELSE obs_mean END AS need FROM f2)"""


@query("sizing_suggestions", "AGG09 ORD03", oracle(["history"], SUGGEST + """,
a AS (SELECT repo, glane AS lane, kind AS grouping_, sig, count(*) AS all_runs, count(*) FILTER (sustained) AS runs, count(*) FILTER (scalable AND NOT sustained) AS short_runs,
  count(*) FILTER (NOT finished) AS unfinished_runs, count(*) FILTER (finished AND NOT scalable) AS malformed_runs, count(DISTINCT CASE WHEN lane <> glane THEN lane END) AS folded_lanes,
  count(*) FILTER (sustained AND elastic) AS elastic_runs, count(*) FILTER (sustained AND elastic AND granted < declared) AS below,
  arg_max(declared, (coalesce(ended_at, started_at), ord)) FILTER (usable) AS declared_cores,
  quantile_disc(need, 0.5) FILTER (sustained) AS mean_p50, quantile_disc(need, 0.9) FILTER (sustained) AS mean_p90,
  quantile_disc(obs_peak, 0.5) FILTER (sustained) AS peak_p50, quantile_disc(obs_peak, 0.9) FILTER (sustained) AS peak_p90 FROM f3 GROUP BY ALL),
b AS (SELECT *, declared_cores IS NOT NULL AND runs >= 5 AS enough FROM a WHERE all_runs >= 5)
SELECT repo, lane, grouping_ AS grouping, runs, short_runs, unfinished_runs, malformed_runs, folded_lanes, elastic_runs,
  CASE WHEN runs = 0 THEN 0 ELSE floor(100 * below / runs + 0.5)::BIGINT END AS granted_below_declared_pct, declared_cores,
  CASE WHEN enough THEN round(mean_p50, 6) END AS mean_p50, CASE WHEN enough THEN round(mean_p90, 6) END AS mean_p90, CASE WHEN enough THEN round(peak_p50, 6) END AS peak_p50, CASE WHEN enough THEN round(peak_p90, 6) END AS peak_p90,
  CASE WHEN enough THEN greatest(1, ceil(mean_p90)::BIGINT) END AS suggested_cores,
  CASE WHEN NOT enough THEN 'insufficient' WHEN mean_p90 > 1.25 * declared_cores THEN 'under-booked' WHEN ceil(mean_p90) <= 0.5 * declared_cores THEN 'over-booked' ELSE 'ok' END AS verdict FROM b"""))
def sizing_suggestions(spark, sf):
    out = reports.order_suggestions(reports.sizing_suggestions(history(spark, sf), NOW, DAYS)).drop("signature")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_p50", "mean_p90", "peak_p50", "peak_p90")})


@query("sizing_skipped_rows", "AGG10", oracle(["history"], f"""SELECT repo, count(*) FILTER (obs_mean IS NULL OR obs_peak IS NULL) AS skipped FROM history
  WHERE (ended_at IS NULL OR ended_at >= {NOW:.0f} - {DAYS} * 86400000::BIGINT) AND started_at IS NOT NULL GROUP BY 1"""))
def sizing_skipped_rows(spark, sf):
    return reports.skipped_without_observation(history(spark, sf), NOW, DAYS)


@query("sizing_too_few_runs", "AGG10", oracle(["history"], SUGGEST + "\nSELECT repo, glane AS lane, count(*) AS runs FROM g GROUP BY repo, glane, kind, sig HAVING count(*) < 5"))
def sizing_too_few_runs(spark, sf):
    return reports.too_few_runs(history(spark, sf), NOW, DAYS).drop("signature")


@query("reuse_decisions", "AGG28 P07 SCL16", oracle(["history"], f"""
real AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY ended_at DESC, ord DESC) AS rn FROM history
  WHERE cached_from IS NULL AND refused_from IS NULL AND started_at IS NOT NULL AND ended_at <= {NOW:.0f}),
d AS (SELECT *, coalesce(exit_code = 0, false) AND signal IS NULL AND NOT cancelled AND reason IS NULL AS is_pass,
  content_key_verified AND coalesce(exit_code <> 0 AND exit_code < 128 AND exit_code NOT IN (64, 69, 75, 76, 77, 79, 124, 126, 127, 130), false) AND signal IS NULL AND NOT cancelled AND reason IS NULL
    AND (coalesce(executor, '') <> 'remote' OR (remote_kind = 'completed' AND remote_phase = 'command')) AS is_red, {NOW:.0f} - ended_at AS age FROM real WHERE rn = 1),
q AS (SELECT DISTINCT 'ck' || (c_custkey % 700)::VARCHAR AS "contentKey" FROM customer),
a AS (SELECT q."contentKey", CASE WHEN d.is_pass AND age <= 30000000000 THEN 'serve' WHEN d.is_red AND age <= 90000000000 THEN 'refuse' ELSE 'run' END AS action, ord FROM q LEFT JOIN d ON d.content_key = q."contentKey")
SELECT "contentKey", action, CASE WHEN action <> 'run' THEN ord END AS decided_by FROM a"""))
def reuse_decisions(spark, sf):
    keys = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("ck"), (F.col("c_custkey") % 700).cast("string")).alias("contentKey")).distinct()
    return reports.reuse_decisions(keys, history(spark, sf), NOW, 30_000_000_000.0, 90_000_000_000.0)
