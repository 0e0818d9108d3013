"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import commands, paths, queue, runs
from runlens.operators.primitives import round_to
from runlens.workload.registry import query
from runlens.workload.views import flat, history, oracle

TIMEOUT_SQL = r"'^\s*(?:env\s+(?:-\S+\s+|\w+=\S*\s+)*)?g?timeout\b'"

CLASSIFIED = rf"""
classified AS (
  SELECT *, CASE WHEN run_ms > 0 THEN run_ms / 1000 ELSE (ended_at - started_at) / 1000 END AS wall,
    (coalesce(signal, '') <> '' OR (coalesce(exit_code, -1) = 124 AND regexp_matches(coalesce(command, ''), {TIMEOUT_SQL}))) AS killed,
    CASE WHEN class = 'sim' OR (class IS NULL AND regexp_matches(lane, '(^|[-_:.])sims?($|[-_:.0-9])', 'i')) THEN 'sim' ELSE 'test' END AS work_class
  FROM history),
judged AS (
  SELECT *, CASE WHEN started_at IS NULL THEN 'never-started' WHEN cancelled THEN 'cancelled'
      WHEN NOT coalesce(wall > 0, false) THEN 'no-duration' WHEN killed THEN NULL WHEN coalesce(exit_code, -1) = 0 THEN NULL ELSE 'failed' END AS why
  FROM classified),
kinds AS (
  SELECT *, CASE WHEN why IS NOT NULL THEN 'ignored' WHEN killed THEN 'censored' ELSE 'completed' END AS kind,
    CASE WHEN why IS NULL THEN wall END AS wall_s FROM judged)"""


@query("scalar_run_fields", "SCL01 SCL02 SCL03 SCL04 SCL05 SCL10 SCL13", oracle(["history"], CLASSIFIED + """
SELECT ord, (repo LIKE '%\\_proj\\_foo\\_.git' ESCAPE '\\' OR repo LIKE '%\\_merge-train\\_foo\\_clone\\_.git' ESCAPE '\\') AS is_foo,
  coalesce(run_ms, ended_at - started_at) AS run_time,
  coalesce(nullif(granted, 0), nullif(res_cpu, 0), nullif(weight, 0), 1) AS cores,
  kind, why, round(wall_s, 6) AS wall_s, work_class,
  CASE WHEN wall_s < 120 THEN 'short' WHEN wall_s <= 600 THEN 'medium' WHEN wall_s IS NOT NULL THEN 'long' END AS bucket,
  CASE WHEN placed_runner IS NOT NULL THEN round((predicted_run_ms + 30000) / (run_ms + 30000), 6) END AS ratio
FROM kinds"""))
def scalar_run_fields(spark, sf):
    h = history(spark, sf).withColumn("c", runs.classify())
    wall = F.col("c.wallS")
    return h.select(
        "ord", runs.repo_matches(F.col("repo"), "foo").alias("is_foo"),
        runs.run_ms(F.col("runMs"), F.col("startedAt"), F.col("endedAt")).alias("run_time"),
        runs.reserved_cores(F.col("grantedCpuCores"), F.col("resources.cpuCores"), F.col("weight")).alias("cores"),
        F.col("c.kind").alias("kind"), F.col("c.why").alias("why"), F.round(wall, 6).alias("wall_s"),
        runs.work_class().alias("work_class"), F.when(wall.isNotNull(), runs.ref_bucket(wall)).alias("bucket"),
        F.round(runs.prediction_ratio(F.col("placement.predictedRunMs"), F.col("runMs")), 6).alias("ratio"))


def _val(t: str) -> str:
    return rf"regexp_replace(regexp_extract({t}, '^[A-Za-z_][A-Za-z0-9_]*=(.*)$', 1), '^[\"'']|[\"'']$', '', 'g')"


def _volatile(v: str) -> str:
    return rf"(regexp_matches({v}, '^[0-9a-fA-F]{{7,}}$') OR (regexp_matches({v}, '^\d[\d\-._:TZ]*$') AND length(regexp_replace({v}, '\D', '', 'g')) >= 6))"


WORDS = r"list_filter(string_split_regex(coalesce(command, ''), '\s+'), lambda t: t <> '')"
STABLE = (rf"list_filter(list_transform(list_filter({WORDS}, lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*=')), "
          rf"lambda t: {{'name': split_part(t, '=', 1), 'value': {_val('t')}}}), lambda p: NOT {_volatile('p.value')})")
_UNWRAP = r"""CASE WHEN regexp_matches({0}, '^env( |$)') THEN regexp_replace({0}, '^env(?: -[uC] \S+| -\S*| [A-Za-z_]\w*=\S*)*(?: |$)', '')
  WHEN regexp_matches({0}, '^(?:sh|bash|zsh|dash)(?: |$)') THEN CASE WHEN regexp_matches({0}, '^(?:sh|bash|zsh|dash) -l?c(?: |$)')
    THEN regexp_replace({0}, '^(?:sh|bash|zsh|dash) -l?c(?: |$)', '') ELSE '' END ELSE {0} END"""
COMMAND_CTES = rf"""
c0 AS (SELECT *, list_filter({WORDS}, lambda t: NOT {_volatile(_val('t'))}) AS kept,
    array_to_string(list_transform({WORDS}, lambda t: regexp_replace(t, '^[''\"]+|[''\"]+$', '', 'g')), ' ') AS l0, {STABLE} AS stable FROM history),
c1 AS (SELECT *, {_UNWRAP.format('l0')} AS l1 FROM c0),
c2 AS (SELECT *, {_UNWRAP.format('l1')} AS l2 FROM c1),
c3 AS (SELECT *, {_UNWRAP.format('l2')} AS l3 FROM c2),
c4 AS (SELECT *, {_UNWRAP.format('l3')} AS l4 FROM c3),
cmds AS (SELECT *,
  array_to_string(CASE WHEN len(kept) > 1 AND kept[1] = 'env' AND NOT starts_with(kept[2], '-') AND NOT regexp_matches(kept[2], '^[A-Za-z_][A-Za-z0-9_]*=')
    THEN kept[2:] ELSE kept END, ' ') AS pairing,
  CASE WHEN regexp_matches(coalesce(command, ''), '&&|\|\||[;|<>`\n]|\$\(') OR regexp_matches(l4, '^(?:env|sh|bash|zsh|dash)(?: |$)') THEN ''
    ELSE array_to_string(list_filter(string_split(l4, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^[A-Za-z_]\w*=') AND NOT starts_with(t, '-')
      AND NOT regexp_matches(t, '[/.]'))[1:3], ' ') END AS family FROM c4)"""

ARGV_SQL = "['node', '/work/c' || (cust % 5)::VARCHAR || '/src/x.js', '--out=/tmp/t' || (cust % 7)::VARCHAR || '/o', '/work/c' || (cust % 5)::VARCHAR || 'x/y', lane]"


def _prefix_sql(x: str, p: str, tok: str) -> str:
    at = f"(CASE WHEN starts_with({x}, '-') THEN instr({x}, '=') ELSE 0 END)"
    rest = f"substr({x}, {at} + 1)"
    return (f"(CASE WHEN starts_with({rest}, {p}) AND (length({rest}) = length({p}) OR substr({rest}, length({p}) + 1, 1) = '/') "
            f"THEN substr({x}, 1, {at}) || '{tok}' || substr({rest}, length({p}) + 1) ELSE {x} END)")


@query("scalar_commands", "SCL06 SCL07 SCL08 SCL09", oracle(["history"], COMMAND_CTES + rf""",
argvs AS (SELECT *, {ARGV_SQL} AS argv, '/work/c' || (cust % 5)::VARCHAR AS root, '/tmp/t' || (cust % 7)::VARCHAR AS tmp FROM cmds),
normed AS (SELECT *, list_transform(argv, lambda a: {_prefix_sql('a', 'root', '<repo>')}) AS n1 FROM argvs)
SELECT ord, CASE WHEN command IS NOT NULL THEN pairing END AS pairing, family,
  array_to_string(list_sort(list_transform(stable, lambda p: p.name || '=' || p.value)), ' ') AS assignments,
  sha256('{{"cwd":"<repo>/pkg","argv":["' || array_to_string(list_transform(n1, lambda a: {_prefix_sql('a', 'tmp', '<tmp>')}), '","') || '"]}}') AS fingerprint
FROM normed"""))
def scalar_commands(spark, sf):
    h = history(spark, sf)
    root = F.concat(F.lit("/work/c"), (F.col("cust") % 5).cast("string"))
    tmp = F.concat(F.lit("/tmp/t"), (F.col("cust") % 7).cast("string"))
    argv = F.array(F.lit("node"), F.concat(root, F.lit("/src/x.js")), F.concat(F.lit("--out="), tmp, F.lit("/o")),
                   F.concat(root, F.lit("x/y")), F.col("lane"))
    stable = F.transform(commands.stable_assignments(F.col("command")), lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    return h.select(
        "ord", commands.pairing_command(F.col("command")).alias("pairing"), commands.command_family(F.col("command")).alias("family"),
        F.array_join(F.array_sort(stable), " ").alias("assignments"),
        commands.argv_fingerprint(argv, root, F.concat(tmp, F.lit("/")), F.concat(root, F.lit("/pkg"))).alias("fingerprint"))


@query("scalar_verdict_predicates", "SCL16 PRJ04 PRJ05", oracle(["history"], """
SELECT ord, coalesce(exit_code = 0, false) AND coalesce(signal, '') = '' AND NOT cancelled AND coalesce(reason, '') = '' AS servable,
  content_key_verified AND coalesce(exit_code <> 0 AND exit_code < 128 AND exit_code NOT IN (64, 69, 75, 76, 77, 79, 124, 126, 127, 130), false)
    AND coalesce(signal, '') = '' AND NOT cancelled AND coalesce(reason, '') = ''
    AND (coalesce(executor, '') <> 'remote' OR (coalesce(remote_kind, '') = 'completed' AND coalesce(remote_phase, '') = 'command')) AS red,
  CASE WHEN obs_mean IS NOT NULL AND obs_peak IS NOT NULL AND obs_samples IS NOT NULL THEN obs_peak END AS clean_peak,
  CASE WHEN deps_ms - 1000 >= 0 THEN deps_ms - 1000 END AS clean_phase FROM history"""))
def scalar_verdict_predicates(spark, sf):
    return history(spark, sf).select(
        "ord", runs.servable_pass().alias("servable"), runs.qualifying_red().alias("red"),
        runs.observed_or_null(F.col("observedCpu"))["peak"].alias("clean_peak"),
        runs.relayed_phase(F.col("remotePhasesMs.depsMs") - 1000).alias("clean_phase"))


NOW = 1_000_000_000_000


@query("scalar_ticket_scores", "SCL11 SCL12 SCL20 SCL25", oracle(["tickets"], f"""
t AS (SELECT *, CASE WHEN created_ms <= {NOW} THEN {NOW} - created_ms ELSE 0 END AS waited,
    CASE priority % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE NULL END AS tier, ticket_id % 11 = 0 AS excl, ticket_id % 13 <> 0 AS aging FROM tickets),
p AS (SELECT *, CASE WHEN excl OR NOT aging THEN 0 ELSE (waited % 5000000) END AS credited, waited % 5000000 AS w2 FROM t),
s AS (SELECT *, least(CASE WHEN coalesce(tier, 'medium') = 'high' OR credited >= 3600000 THEN 2.0::DOUBLE ELSE 2.0::DOUBLE * (1 - 0.01::DOUBLE) END,
    2.0::DOUBLE * (CASE coalesce(tier, 'medium') WHEN 'high' THEN 2.0::DOUBLE WHEN 'medium' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END / 2) + 2.0::DOUBLE * least(1.0::DOUBLE, credited / 1200000.0::DOUBLE)) AS score FROM p)
SELECT ticket_id, waited, round(score, 6) AS score, CASE WHEN score >= 2 THEN 2 WHEN score >= 1 THEN 1 ELSE 0 END AS rank,
  round(least(CASE WHEN priority >= 7 OR (aging AND w2 / 1000.0::DOUBLE >= 3600) THEN 2.0::DOUBLE ELSE 1.98::DOUBLE END,
    CASE WHEN priority >= 7 THEN 2.0::DOUBLE WHEN priority >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + 2.0::DOUBLE * least(1.0::DOUBLE, CASE WHEN aging THEN w2 / 1000.0::DOUBLE ELSE 0.0::DOUBLE END / 1200)) + CASE WHEN priority >= 9 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END, 6) AS eff,
  CASE WHEN excl AND w2 >= 1000000 THEN least(ceil(weight / 3), weight) ELSE weight END AS need,
  CASE ticket_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN least(weight, 6.0::DOUBLE) ELSE 0.0::DOUBLE END AS charged_weight,
  CASE WHEN ticket_id % 17 = 0 THEN 'cancelled' WHEN requeues >= 5 THEN 'lost' ELSE 'queued' END AS back_state,
  CASE WHEN ticket_id % 17 <> 0 AND requeues < 5 THEN {NOW} + CAST(least(5000 * power(2, requeues), 60000) AS BIGINT) END AS not_before
FROM s"""))
def scalar_ticket_scores(spark, sf):
    t = flat(spark, sf, "tickets")
    now = F.lit(NOW).cast("long")
    tier = F.when(F.col("priority") % 4 == 0, "low").when(F.col("priority") % 4 == 1, "high").when(F.col("priority") % 4 == 2, "medium")
    excl, aging = F.col("ticket_id") % 11 == 0, F.col("ticket_id") % 13 != 0
    t = t.withColumn("waited", queue.waited_ms(F.col("created_ms"), now)).withColumn("w2", F.col("waited") % 5_000_000)
    header = F.when(F.col("ticket_id") % 3 == 0, F.lit('{"x":1}')).when(
        F.col("ticket_id") % 3 == 1, F.concat(F.lit('{"weight":'), F.col("weight").cast("string"), F.lit("}"))).otherwise(F.lit('{"weight":"7"}'))
    back = queue.return_to_queue(F.col("ticket_id") % 17 == 0, F.col("requeues"), now)
    score = queue.priority_score(tier, F.col("w2"), excl, aging)
    return t.select(
        "ticket_id", "waited", F.round(score, 6).alias("score"), queue.effective_rank(score).alias("rank"),
        F.round(queue.eff_score(F.col("priority"), aging, F.col("w2") / 1000.0), 6).alias("eff"),
        queue.claim_need(F.col("weight"), F.when(excl, F.col("weight") / 3), F.col("w2"), F.lit(1_000_000)).alias("need"),
        queue.ticket_weight(header, F.lit(6.0)).alias("charged_weight"),
        back["state"].alias("back_state"), back["notBeforeMs"].alias("not_before"))


@query("scalar_parent_usage", "SCL14", oracle(["parents"], """
SELECT parent_id, round(usage_core_s * power(0.5, dt / 1800) + running_cores * (1800 / ln(2::DOUBLE)) * (1 - power(0.5, dt / 1800)), 4) AS usage_core_s,
  round(running_cores + (usage_core_s * power(0.5, dt / 1800) + running_cores * (1800 / ln(2::DOUBLE)) * (1 - power(0.5, dt / 1800))) / 1800, 4) AS usage_cores
FROM (SELECT *, (1704067200000 - usage_at_ms) / 1000.0::DOUBLE AS dt FROM parents) p"""))
def scalar_parent_usage(spark, sf):
    p = flat(spark, sf, "parents")
    dt = (F.lit(1704067200000) - F.col("usage_at_ms")) / 1000.0
    return p.select("parent_id", F.round(queue.usage_now(F.col("usage_core_s"), dt, F.col("running_cores")), 4).alias("usage_core_s"),
                    F.round(queue.usage_cores(F.col("usage_core_s"), dt, F.col("running_cores")), 4).alias("usage_cores"))


@query("scalar_running_residual", "SCL15", oracle(["jobs"], """
SELECT job_id, elapsed_s / factor > est_p90_s AS overrun,
  round(CASE WHEN elapsed_s / factor > est_p90_s THEN least(elapsed_s / factor / 2, greatest((max_ms / 1000 - elapsed_s) / factor, 0)) ELSE greatest(est_p50_s - elapsed_s / factor, 0) END, 6) AS residual_ref_s,
  round(factor * CASE WHEN elapsed_s / factor > est_p90_s THEN least(elapsed_s / factor / 2, greatest((max_ms / 1000 - elapsed_s) / factor, 0)) ELSE greatest(est_p50_s - elapsed_s / factor, 0) END, 6) AS residual_wall_s
FROM (SELECT *, (1 + host)::DOUBLE / 2 AS factor FROM jobs) j"""))
def scalar_running_residual(spark, sf):
    j = flat(spark, sf, "jobs").withColumn("factor", (1 + F.col("host")).cast("double") / 2)
    r = runs.running_residual(F.col("elapsed_s"), F.col("factor"), F.col("est_p50_s"), F.col("est_p90_s"), F.col("max_ms"))
    return j.withColumn("r", r).select("job_id", F.col("r.overrun").alias("overrun"), F.round("r.residualRef", 6).alias("residual_ref_s"),
                                       F.round("r.residualWallS", 6).alias("residual_wall_s"))


@query("scalar_object_paths", "SCL17 SCL22", oracle(["store_journal"], """
p AS (SELECT store, seq, CASE seq % 4 WHEN 0 THEN path WHEN 1 THEN 'manifests/job-' || seq::VARCHAR || '.json' WHEN 2 THEN 'blobs/00/' || substr(path, 10) ELSE path || '/' END AS path,
  'src/' || CASE seq % 6 WHEN 0 THEN '.env' WHEN 1 THEN '.env.sample' WHEN 2 THEN 'a/../b.txt' WHEN 3 THEN 'key.pem' WHEN 4 THEN 'id_rsa.pub' ELSE 'id_dict' END AS file, sha FROM store_journal)
SELECT store, seq, CASE WHEN seq % 4 = 0 OR (seq % 4 = 2 AND substr(sha, 1, 2) = '00') THEN 'blob' WHEN seq % 4 = 1 THEN 'manifest' END AS kind,
  CASE WHEN seq % 4 = 0 OR (seq % 4 = 2 AND substr(sha, 1, 2) = '00') THEN sha END AS sha, CASE WHEN seq % 4 = 1 THEN 'job-' || seq::VARCHAR END AS job,
  seq % 6 <> 2 AS canonical, seq % 6 IN (0, 3, 4) AS secret,
  'blobs/' || substr(sha, 1, 2) || '/' || substr(sha, 3, 2) || '/' || sha AS rebuilt FROM p"""))
def scalar_object_paths(spark, sf):
    j = flat(spark, sf, "store_journal")
    m, n = F.col("seq") % 4, F.col("seq") % 6
    path = (F.when(m == 0, F.col("path")).when(m == 1, paths.manifest_path(F.concat(F.lit("job-"), F.col("seq").cast("string"))))
            .when(m == 2, F.concat(F.lit("blobs/00/"), F.expr("substring(path, 10)"))).otherwise(F.concat("path", F.lit("/"))))
    file = F.concat(F.lit("src/"), F.when(n == 0, ".env").when(n == 1, ".env.sample").when(n == 2, "a/../b.txt").when(n == 3, "key.pem")
                    .when(n == 4, "id_rsa.pub").otherwise("id_dict"))
    j = j.withColumn("o", paths.parse_object_path(path)).withColumn("file", file)
    return j.select("store", "seq", F.col("o.kind").alias("kind"), F.col("o.sha").alias("sha"), F.col("o.job").alias("job"),
                    paths.canonical_rel_path(F.col("file")).alias("canonical"), paths.secret_shaped(F.col("file")).alias("secret"),
                    paths.blob_path(F.col("sha")).alias("rebuilt"))


@query("scalar_host_limits", "SCL18 SCL19 SCL21 SCL24 P12", oracle(["agents"], """
a AS (SELECT *, row_number() OVER (ORDER BY agent) * 0 + CAST(substr(agent, 2) AS BIGINT) AS k FROM agents)
SELECT agent, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 100 <= 8 THEN 'exhausted' WHEN k % 100 <= 15 THEN 'tight' ELSE 'healthy' END AS memory,
  round(least(85.0::DOUBLE / 100 * capacity, greatest(0, capacity - max_claims)), 6) AS budget,
  CASE WHEN k % 6 = 5 THEN true ELSE (k % 3, k % 12, k % 7) < (1, 9, 3) END AS below_floor,
  least(capacity, greatest(0.5::DOUBLE, headroom * 1.3::DOUBLE)) AS charge, least(6.0::DOUBLE, greatest(0.5::DOUBLE, headroom * 1.3::DOUBLE)) AS raised,
  floor(headroom / 7 * 1000 + 0.5) / 1000 AS rounded
FROM a"""))
def scalar_host_limits(spark, sf):
    a = flat(spark, sf, "agents").withColumn("k", F.expr("cast(substring(agent, 2) as bigint)"))
    version = F.when(F.col("k") % 6 == 5, F.lit("dev")).otherwise(
        F.concat_ws(".", (F.col("k") % 3).cast("string"), (F.col("k") % 12).cast("string"), F.concat((F.col("k") % 7).cast("string"), F.lit("-rc1"))))
    available = F.when(F.col("k") % 10 != 0, (F.col("k") % 100).cast("double"))
    p90 = F.col("headroom") * 1.3
    return a.select(
        "agent", queue.memory_level(available, F.lit(100.0)).alias("memory"),
        F.round(queue.cpu_budget(F.col("capacity"), F.lit(85.0), F.col("max_claims").cast("double")), 6).alias("budget"),
        queue.version_below(version, F.lit("1.9.3")).alias("below_floor"),
        runs.charge_estimate(p90, F.col("capacity")).alias("charge"), runs.raised_charge(p90, F.lit(6.0)).alias("raised"),
        round_to(F.col("headroom") / 7, 3).alias("rounded"))


@query("scalar_weekday_split", "SCL23", oracle(["tickets"], """
d AS (SELECT ticket_id, created_ms AS a, created_ms + (ticket_id % 200) * 3600000 + 12345678 AS b FROM tickets),
e AS (SELECT ticket_id, a, b, unnest(generate_series(a // 86400000, (b - 1) // 86400000)) AS day FROM d)
SELECT ticket_id, round(sum(CASE WHEN day % 7 IN (2, 3) THEN 0 ELSE least(b, (day + 1) * 86400000) - greatest(a, day * 86400000) END) / 86400000.0::DOUBLE, 6) AS weekday_days,
  round(sum(CASE WHEN day % 7 IN (2, 3) THEN least(b, (day + 1) * 86400000) - greatest(a, day * 86400000) ELSE 0 END) / 86400000.0::DOUBLE, 6) AS weekend_days,
  max(CASE WHEN dayofweek(make_timestamp(a * 1000)) IN (0, 6) THEN 1 ELSE 0 END) = 1 AS starts_weekend FROM e GROUP BY 1"""))
def scalar_weekday_split(spark, sf):
    t = flat(spark, sf, "tickets").select("ticket_id", F.col("created_ms").alias("a"),
                                          (F.col("created_ms") + (F.col("ticket_id") % 200) * 3600000 + 12345678).alias("b"))
    weekend = runs.weekend_ms_before(F.col("b").cast("double")) - runs.weekend_ms_before(F.col("a").cast("double"))
    return t.select("ticket_id", F.round((F.col("b") - F.col("a") - weekend) / 86400000.0, 6).alias("weekday_days"),
                    F.round(weekend / 86400000.0, 6).alias("weekend_days"), runs.is_weekend(F.col("a")).alias("starts_weekend"))
