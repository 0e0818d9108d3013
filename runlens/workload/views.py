"""Input shapes derived from the given tables.

Each view is one SELECT over whole tables, written once for Spark and DuckDB; only time, array and hash spelling
differ. Modulus arithmetic gives columns their values; no view leaves rows out. The registered queries read these views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Spark:
    name = "spark"

    def ms(self, col):
        return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ)) div 1000)"

    def div(self, a, b):
        return f"({a} div {b})"

    def arr(self, *xs):
        return f"array({', '.join(xs)})"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def no_strings(self):
        return "CAST(array() AS ARRAY<STRING>)"


class Duck:
    name = "duck"

    def ms(self, col):
        return f"(epoch_us({col}) // 1000)"

    def div(self, a, b):
        return f"({a} // {b})"

    def arr(self, *xs):
        return f"[{', '.join(xs)}]"

    def sha(self, x):
        return f"sha256({x})"

    def no_strings(self):
        return "CAST([] AS VARCHAR[])"


def _history(d) -> str:
    k, c = "o_orderkey", "o_custkey"
    run = f"CAST(1000 * (30 + ({k} * 7919) % 3600) AS DOUBLE)"
    start = f"({d.ms('o_orderdate')} + ({k} * 7919) % 86400000)"
    remote = f"({k} % 3 <> 0 AND {k} % 23 <> 1)"
    runner = f"CASE WHEN {remote} AND {k} % 53 <> 0 THEN 'r' || CAST({c} % 5 AS STRING) END"

    def phase(expr, missing):
        return f"CASE WHEN {remote} AND {k} % 16 <> 0 AND NOT ({missing}) THEN CAST({expr} AS DOUBLE) END"

    return f"""
SELECT {k} AS ord,
  CASE WHEN {k} % 97 = 0 THEN NULL WHEN {k} % 11 = 10 THEN 'o' || CAST({k} - 1 AS STRING) ELSE 'o' || CAST({k} AS STRING) END AS id,
  CASE {c} % 3 WHEN 0 THEN '_home_proj_foo_.git' WHEN 1 THEN '_home_proj_bar_.git' ELSE '_srv_merge-train_foo_clone_.git' END AS repo,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'prepush' WHEN '2-HIGH' THEN 'train' WHEN '3-MEDIUM' THEN 'unit'
    WHEN '4-NOT SPECIFIED' THEN 'sim-heavy' ELSE 'adhoc' || CAST({k} % 40 AS STRING) END AS lane,
  CASE WHEN o_orderpriority = '5-LOW' AND {k} % 2 = 0 THEN 'e2e' END AS config_lane,
  CASE WHEN {k} % 37 = 0 THEN 'sim' WHEN {k} % 41 = 0 THEN 'test' END AS class,
  CASE WHEN {k} % 5 = 0 THEN CAST(2 AS DOUBLE) END AS weight,
  CASE WHEN {k} % 7 <> 0 THEN CAST(1 + {c} % 8 AS DOUBLE) END AS res_cpu,
  CASE WHEN {k} % 7 <> 0 THEN CAST(1 AS DOUBLE) END AS res_min_cpu,
  CASE WHEN {k} % 7 <> 0 THEN CAST((1 + {c} % 4) * 1000000000 AS DOUBLE) END AS res_memory,
  CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 9 = 0 THEN CAST(0 AS DOUBLE)
    WHEN {k} % 10 = 1 THEN CAST(1 + {c} % 8 AS DOUBLE) / CAST(2 AS DOUBLE) ELSE CAST(1 + {c} % 8 AS DOUBLE) END AS granted,
  CASE {k} % 10 WHEN 0 THEN NULL
    WHEN 1 THEN 'env TRAIN_BASE=' || substring({d.sha(f"CAST({k} AS STRING)")}, 1, 12) || ' pnpm test src/a.test.js'
    WHEN 2 THEN 'env MODE=m' || CAST({c} % 4 AS STRING) || ' STAMP=2024-01-' || CAST(10 + {k} % 20 AS STRING) || 'T10:00 pnpm run gate'
    WHEN 3 THEN 'bash -lc pnpm test unit'
    WHEN 4 THEN 'pnpm test && pnpm build'
    WHEN 5 THEN 'MODE=m' || CAST({c} % 3 AS STRING) || ' SEED=s' || CAST({k} % 500 AS STRING) || ' node run.js --shard ' || CAST({c} % 4 AS STRING)
    WHEN 6 THEN 'timeout 600 make check'
    WHEN 7 THEN 'sh script.sh'
    WHEN 8 THEN 'env -u HOME A=1 sh -c make all now please'
    ELSE 'cargo test --release' END AS command,
  CASE WHEN {k} % 6 <> 0 THEN 'f' || CAST({c} % 10 AS STRING) END AS cmd_fp,
  CASE WHEN {k} % 3 = 0 THEN 'local' WHEN {k} % 23 = 1 THEN NULL ELSE 'remote' END AS executor,
  {runner} AS runner,
  CASE WHEN o_orderstatus = 'P' AND {k} % 4 = 1 THEN 1 WHEN {k} % 19 = 0 THEN NULL WHEN {k} % 31 = 0 THEN 124
    WHEN {k} % 43 = 0 THEN 127 ELSE 0 END AS exit_code,
  CASE WHEN {k} % 47 = 0 THEN 'SIGKILL' END AS signal,
  {k} % 59 = 0 AS cancelled,
  CASE WHEN {k} % 13 = 0 THEN CASE {c} % 6 WHEN 0 THEN 'runner-lost' WHEN 1 THEN 'runner-offline' WHEN 2 THEN 'runner-shutdown'
    WHEN 3 THEN 'runner-never-started' WHEN 4 THEN 'never-dispatched' ELSE 'no-progress' END END AS reason,
  CASE WHEN {k} % 103 <> 0 THEN CAST({start} AS DOUBLE) END AS started_at,
  CASE WHEN {k} % 101 <> 0 THEN CAST({start} + 1000 * (30 + ({k} * 7919) % 3600) + ({k} % 7) * 1000 AS DOUBLE) END AS ended_at,
  CASE WHEN {k} % 29 <> 0 THEN {run} END AS run_ms,
  CASE WHEN {k} % 8 <> 0 THEN CAST(({k} * 31) % 600000 AS DOUBLE) END AS waited_ms,
  CASE WHEN {k} % 14 <> 0 THEN CAST(({k} % 80) * 3 AS DOUBLE) / CAST(20 AS DOUBLE) END AS obs_peak,
  CASE WHEN {k} % 14 <> 0 THEN CAST({k} % 80 AS DOUBLE) / CAST(10 AS DOUBLE) END AS obs_mean,
  CASE WHEN {k} % 14 <> 0 THEN {k} % 9 END AS obs_samples,
  CASE WHEN {k} % 3 <> 1 THEN CAST(({c} % 50) * 1000000 AS DOUBLE) END AS rss_peak,
  CASE WHEN {k} % 5 <> 1 THEN CAST(({k} % 1000) * 3 AS DOUBLE) / CAST(2 AS DOUBLE) END AS cpu_seconds,
  CASE {c} % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' WHEN 2 THEN 'fallback' END AS deps_cache,
  {phase(f"({k} * 13) % 9000", f"{k} % 9 = 0")} AS upload_ms,
  {phase(f"({k} * 31) % 600000", f"{k} % 10 = 0")} AS queued_ms,
  {phase(f"({k} * 17) % 5000", f"{k} % 11 = 0")} AS snapshot_ms,
  {phase(f"({k} * 19) % 60000", f"{k} % 4 = 0")} AS deps_ms,
  {phase(f"({k} * 23) % 20000", f"{k} % 13 = 0")} AS setup_ms,
  {phase(f"1000 * (30 + ({k} * 7919) % 3600)", f"{k} % 5 = 0")} AS command_ms,
  {phase(f"({k} * 29) % 30000", f"{k} % 6 = 0")} AS artifacts_ms,
  {phase(f"({k} * 37) % 8000", f"{k} % 7 = 0")} AS artifact_return_ms,
  {remote} AND {k} % 16 <> 0 AS has_phases,
  CASE WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 7 = 0 THEN 'r' || CAST(({c} + 1) % 5 AS STRING) ELSE {runner} END AS placed_runner,
  CASE WHEN {k} % 12 <> 0 THEN CAST(({k} * 37) % 500000 AS DOUBLE) END AS predicted_wait_ms,
  CASE WHEN {k} % 15 <> 0 THEN CAST(1000 * (30 + ({k} * 7907) % 3600) AS DOUBLE) END AS predicted_run_ms,
  CASE WHEN {k} % 34 = 0 THEN {d.arr("'r0'", f"'r' || CAST(1 + {c} % 4 AS STRING)")}
    WHEN {k} % 17 = 0 THEN {d.arr(f"'r' || CAST({c} % 5 AS STRING)")} ELSE {d.no_strings()} END AS redispatched_from,
  CASE WHEN {k} % 17 = 0 THEN CASE WHEN {c} % 2 = 0 THEN 'runner-lost' ELSE 'runner-offline' END END AS redispatch_reason,
  CASE WHEN {k} % 3 = 0 AND {k} % 21 = 0 THEN 'fallback:runner-lost' WHEN {k} % 3 = 0 AND {k} % 15 = 0 THEN 'fallback:other' END AS local_reason,
  'ck' || CAST({c} % 500 AS STRING) AS content_key,
  {k} % 2 = 0 AS content_key_verified,
  CASE WHEN {k} % 25 = 3 THEN 'o1' END AS cached_from,
  CASE WHEN {k} % 26 = 5 THEN 'o2' END AS refused_from,
  CASE WHEN {remote} THEN CASE WHEN {k} % 20 = 1 THEN 'rejected' ELSE 'completed' END END AS remote_kind,
  CASE WHEN {remote} THEN CASE WHEN {k} % 9 = 2 THEN 'deps' ELSE 'command' END END AS remote_phase,
  {c} AS cust
FROM {{orders}}"""


def _journal(d) -> str:
    return f"""
SELECT event_id AS ord, {d.ms('ts')} AS t_ms,
  CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'lane-start' WHEN 'click' THEN 'batch-built'
    WHEN 'purchase' THEN 'landed' ELSE CASE WHEN event_id % 2 = 0 THEN 'remove' ELSE 'drop' END END AS event,
  CASE event_id % 3 WHEN 0 THEN 'foo' ELSE 'bar' END AS repo,
  CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'master-' ELSE 'run-' END || CAST(user_id % 20 AS STRING) AS run_id,
  'o' || CAST({d.div('event_id * 3', '2')} AS STRING) AS lane_id,
  user_id AS pr,
  {d.arr('user_id - user_id % 3', '(user_id + 7) % 1000 - (user_id + 7) % 1000 % 3', '(event_id * 5) % 1000 - (event_id * 5) % 1000 % 3')} AS prs
FROM {{events}}"""


def _prs(d) -> str:
    base = "(1704067200000 + CAST((c_custkey * 7919) % 30 AS BIGINT) * 86400000 + (c_custkey * 104729) % 86400000)"
    return f"""
SELECT CASE c_custkey % 2 WHEN 0 THEN 'foo' ELSE 'bar' END AS repo, c_custkey AS number,
  CASE WHEN c_custkey % 3 = 0 THEN {base} END AS merged_ms,
  CASE WHEN c_custkey % 5 <> 0 THEN {base} + 60000 END AS closed_ms,
  CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN {d.arr("'train-landed'", "'bug'")} ELSE {d.arr("'bug'")} END AS labels
FROM {{customer}}"""


def _heartbeats(d) -> str:
    return f"""
SELECT user_id AS lease_id, event_id AS ord, {d.ms('ts')} - CASE WHEN event_id % 37 = 0 THEN 200000000 ELSE 0 END AS t_ms,
  CASE WHEN event_id % 13 <> 0 THEN value / CAST(100 AS DOUBLE) END AS cores,
  CASE WHEN event_id % 11 <> 0 THEN CAST((event_id % 64) * 1000000 AS DOUBLE) END AS mem_bytes,
  CASE WHEN event_id % 9 <> 0 THEN value / CAST(400 AS DOUBLE) END AS interval_cores,
  event_type = 'click' AS wrote_output
FROM {{events}}"""


def _leases(d) -> str:
    return f"""
SELECT user_id AS lease_id, CAST(1 + user_id % 4 AS DOUBLE) / CAST(2 AS DOUBLE) AS charged_cores,
  min({d.ms('ts')}) - 60000 AS started_ms, max({d.ms('ts')}) + 30000 AS ended_ms
FROM {{events}} GROUP BY user_id"""


def _samples(d) -> str:
    return f"""
SELECT user_id % 5 AS host, event_id AS ord, {d.ms('ts')} AS t_ms,
  value / CAST(20 AS DOUBLE) AS load,
  CASE WHEN event_id % 17 <> 0 THEN value / CAST(3 AS DOUBLE) END AS busy_percent,
  CASE WHEN event_id % 19 <> 0 THEN value / CAST(4 AS DOUBLE) END AS temp_c
FROM {{events}}"""


def _counters(d) -> str:
    # cumulative per-core counters: two cores, mostly moving forward, sometimes standing still, going back or losing a core
    step = d.div("event_id", "40")
    return f"""
SELECT user_id % 5 AS host, event_id AS ord, {d.ms('ts')} AS t_ms,
  CASE WHEN event_id % 29 = 0 THEN 1 ELSE 2 END AS n_cores,
  CAST({step} * 1000 AS DOUBLE) AS total0, CAST({step} * 400 AS DOUBLE) AS idle0,
  CAST(CASE WHEN event_id % 31 = 0 THEN 0 ELSE {step} * 1000 END AS DOUBLE) AS total1,
  CAST(CASE WHEN event_id % 31 = 0 THEN 0 ELSE {step} * 700 END AS DOUBLE) AS idle1
FROM {{events}}"""


def _procs(d) -> str:
    # one process tree per host, read at two snapshots; ids are local to the host
    q = d.div("p_partkey", "2")
    pid = f"({d.div(q, '3')} + 1)"
    return f"""
SELECT {q} % 3 AS host, CAST(1704067200000 + (p_partkey % 2) * 60000 AS BIGINT) AS snapshot_ms,
  {pid} AS pid, {d.div(pid, '3')} AS ppid, {pid} % 40 + 1 AS pgid, {pid} % 20 AS nice,
  't' || CAST(CASE WHEN p_partkey % 46 = 5 THEN 1 ELSE 0 END AS STRING) AS token,
  CAST({q} % 50 * 10 + (p_partkey % 2) * ({q} % 31 - 3) AS DOUBLE) AS cpu_sec,
  CAST((p_partkey % 100) * 1024 AS DOUBLE) AS rss_kib, CAST(p_partkey % 37 AS DOUBLE) AS pcpu,
  CASE WHEN {pid} % 25 = 3 THEN '-bash' WHEN {pid} % 25 = 7 THEN '/usr/sbin/sshd -D' ELSE '/opt/bin/' || replace(p_brand, '#', '') || ' serve' END AS command
FROM {{part}}"""


def _tickets(d) -> str:
    k = "o_orderkey"
    return f"""
SELECT {k} AS ticket_id, {k} % 5 AS snapshot, 'h' || CAST(o_custkey % 4 AS STRING) AS host,
  CASE o_custkey % 3 WHEN 0 THEN 'foo' WHEN 1 THEN 'bar' ELSE 'baz' END AS repo,
  'p' || CAST(o_custkey % 50 AS STRING) AS owner,
  CASE {k} % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'claimed' WHEN 2 THEN 'running' WHEN 3 THEN 'done' WHEN 4 THEN 'lost' ELSE 'queued' END AS state,
  CASE {k} % 4 WHEN 0 THEN {d.arr("'gpu'", "'linux'")} WHEN 1 THEN {d.arr("'linux'")} WHEN 2 THEN {d.arr("'mac'")} ELSE {d.no_strings()} END AS requires_tags,
  CASE {k} % 7 WHEN 0 THEN {d.arr("'slow'")} ELSE {d.no_strings()} END AS avoid_tags,
  CASE {k} % 5 WHEN 0 THEN {d.arr("'node'", "'pnpm'")} WHEN 1 THEN {d.arr("'cargo'")} ELSE {d.no_strings()} END AS tools,
  CAST({k} % 10 AS INT) AS priority, CAST(1 + o_custkey % 8 AS DOUBLE) AS weight,
  {d.ms('o_orderdate')} + ({k} * 7919) % 86400000 AS created_ms,
  CASE WHEN {k} % 6 = 3 OR {k} % 6 = 4 THEN {d.ms('o_orderdate')} + 90000000 END AS finished_ms,
  CAST(floor(o_totalprice) AS BIGINT) * 10 AS max_ms, CAST({k} % 7 AS INT) AS requeues
FROM {{orders}}"""


def _agents(d) -> str:
    return f"""
SELECT 's' || CAST(s_suppkey AS STRING) AS agent,
  CASE s_suppkey % 4 WHEN 0 THEN {d.arr("'gpu'", "'linux'")} WHEN 1 THEN {d.arr("'linux'", "'slow'")} WHEN 2 THEN {d.arr("'mac'")} ELSE {d.arr("'linux'", "'mac'", "'gpu'")} END AS tags,
  CASE s_suppkey % 3 WHEN 0 THEN {d.arr("'*'")} WHEN 1 THEN {d.arr("'foo'", "'bar'")} ELSE {d.arr("'baz'")} END AS allowed_repos,
  CAST(s_suppkey % 5 AS INT) AS max_claims, CAST(4 + s_suppkey % 12 AS DOUBLE) AS capacity,
  CAST(s_suppkey % 9 AS DOUBLE) AS headroom
FROM {{supplier}}"""


def _jobs(d) -> str:
    return f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)
    || '-' || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING) AS job_id,
  l_orderkey AS group_id, l_linenumber AS stage, l_suppkey % 6 AS host,
  CASE WHEN l_partkey % 5 = 0 THEN 'sim' ELSE 'test' END AS class,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'DONE' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'RUNNING'
    WHEN l_returnflag = 'R' THEN 'ORPHANED' WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'QUEUED' END AS state,
  l_quantity * CAST(30 AS DOUBLE) AS est_p50_s, l_quantity * CAST(60 AS DOUBLE) AS est_p90_s,
  CAST(1 + l_suppkey % 8 AS DOUBLE) AS cpu_req, CAST((l_partkey % 2000) AS DOUBLE) AS elapsed_s,
  CAST((1 + l_suppkey % 16) * 600000 AS BIGINT) AS max_ms,
  {d.ms('l_shipdate')} AS enqueued_ms
FROM {{lineitem}}"""


def _groups(d) -> str:
    return f"""
SELECT o_orderkey AS group_id, o_custkey AS parent_id,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'active' ELSE 'paused' END AS state,
  {d.ms('o_orderdate')} AS created_ms, CAST(o_totalprice AS DOUBLE) AS urgency
FROM {{orders}}"""


def _parents(d) -> str:
    return """
SELECT c_custkey AS parent_id, 'p' || CAST(c_nationkey AS STRING) AS principal,
  c_acctbal AS usage_core_s, 1704067200000 - (c_custkey % 500) * 60000 AS usage_at_ms, CAST(c_custkey % 9 AS DOUBLE) AS running_cores,
  1704067200000 - (c_custkey % 2000) * 1000 AS oldest_ms, c_custkey % 3 = 0 AS interactive, c_custkey % 7 = 0 AS was_demoted
FROM {customer}"""


def _blobs(d) -> str:
    return f"""
SELECT 'store' || CAST(doc_id % 3 AS STRING) AS store, {d.sha('text')} AS sha, max(n_chars) AS size_bytes,
  max(1704067200000 - (doc_id * 7919) % 4000000 * 1000) AS mtime_ms
FROM {{documents}} GROUP BY 1, 2"""


def _manifest_entries(d) -> str:
    # one entry per document and manifest: each document is referenced by three manifests spread over the orders
    return f"""
SELECT 'job' || CAST((doc_id * 3 + j) % 400 AS STRING) AS job, 'src/d' || CAST(doc_id AS STRING) || '.txt' AS path, {d.sha('text')} AS sha,
  n_chars AS size_bytes, doc_id % 2 = 0 AS executable, doc_id
FROM {{documents}} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 5) reps"""


def _store_journal(d) -> str:
    return f"""
SELECT doc_id % 3 AS store, {d.div('doc_id', '3')} AS seq,
  CASE doc_id % 7 WHEN 5 THEN 'pin' WHEN 6 THEN 'delete' ELSE 'put' END AS kind,
  'blobs/' || substring({d.sha('text')}, 1, 2) || '/' || substring({d.sha('text')}, 3, 2) || '/' || {d.sha('text')} AS path,
  {d.sha('text')} AS sha, n_chars AS size_bytes, 1704067200000 + doc_id * 60000 AS created_ms
FROM {{documents}}"""


VIEWS = {
    "history": _history, "journal": _journal, "prs": _prs, "heartbeats": _heartbeats, "leases": _leases,
    "samples": _samples, "counters": _counters, "procs": _procs, "tickets": _tickets, "agents": _agents,
    "jobs": _jobs, "groups": _groups, "parents": _parents, "blobs": _blobs, "manifest_entries": _manifest_entries,
    "store_journal": _store_journal,
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_sql(name: str) -> str:
    """The view as DuckDB text over the registered tables."""
    return VIEWS[name](Duck()).replace("{", "").replace("}", "")


def oracle(views: list[str], body: str) -> str:
    """A DuckDB query over named views."""
    ctes = ",\n".join(f"{v} AS ({duck_sql(v)})" for v in views)
    if body.lstrip().upper().startswith("SELECT"):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes},\n{body}"


def flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a flat Spark DataFrame."""
    text = VIEWS[name](Spark())
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-history table in its canonical nested schema."""
    h = flat(spark, sf_dir, "history")
    return h.selectExpr(
        "ord", "id", "repo", "lane", "config_lane AS configLane", "class", "weight",
        "CASE WHEN res_cpu IS NOT NULL THEN struct(res_cpu AS cpuCores, res_min_cpu AS minCpuCores, res_memory AS memoryBytes) END AS resources",
        "command", "cmd_fp AS cmdFingerprint", "executor", "runner", "exit_code AS exit", "signal", "cancelled", "reason",
        "CAST(NULL AS STRING) AS error", "concat(repo, ':', lane) AS key", "started_at AS startedAt", "ended_at AS endedAt",
        "run_ms AS runMs", "waited_ms AS waitedMs", "granted AS grantedCpuCores",
        "CASE WHEN obs_mean IS NOT NULL THEN struct(obs_peak AS peak, obs_mean AS mean, CAST(obs_samples AS INT) AS samples) END AS observedCpu",
        "rss_peak AS observedRssPeakBytes", "cpu_seconds AS cpuSeconds", "deps_cache AS depsCache",
        "CASE WHEN has_phases THEN struct(upload_ms AS uploadMs, queued_ms AS queuedMs, snapshot_ms AS snapshotMs, deps_ms AS depsMs,"
        " setup_ms AS setupMs, command_ms AS commandMs, artifacts_ms AS artifactsMs, artifact_return_ms AS artifactReturnMs) END AS remotePhasesMs",
        "CASE WHEN placed_runner IS NOT NULL THEN struct(placed_runner AS runner, predicted_wait_ms AS predictedWaitMs,"
        " predicted_run_ms AS predictedRunMs) END AS placement",
        "redispatched_from AS redispatchedFrom", "redispatch_reason AS redispatchReason", "local_reason AS localReason",
        "content_key AS contentKey", "content_key_verified AS contentKeyVerified", "cached_from AS cachedFrom", "refused_from AS refusedFrom",
        "remote_kind AS remoteKind", "remote_phase AS remotePhase", "CAST(NULL AS STRING) AS remoteSignal", "CAST(NULL AS STRING) AS event", "cust")
