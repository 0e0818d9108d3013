"""Readers over JSON lines written from the given tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from runlens.session import cut_lineage, work_path
from runlens.sources import history as src
from runlens.plans import estimates, reports
from runlens.sources.growing import open_store
from runlens.sources.sinks import append_history, derived_table, write_report
from runlens.streaming import jobs
from runlens.workload import q_reports
from runlens.workload.registry import ORACLES, query
from runlens.workload.views import flat, history, oracle


def _lines(spark, sf):
    """History written as JSON lines and read back; `queuedAt` carries the row number. Torn, blank, null and diagnostic
    lines stand among them."""
    h = history(spark, sf).withColumn("queuedAt", F.col("ord").cast("double"))
    json_path, path = work_path(spark, "json"), work_path(spark, "lines")
    h.select("ord", F.to_json(F.struct(*[c for c in h.columns if c not in ("ord", "event", "cust")])).alias("json")).write.parquet(json_path)
    k = F.col("ord")
    line = (F.when(k % 67 == 1, F.expr("substring(json, 1, 40)")).when(k % 71 == 2, F.lit("   ")).when(k % 73 == 3, F.lit("null"))
            .when(k % 79 == 4, F.concat(F.lit('{"event":null,'), F.expr("substring(json, 2)"))).when(k % 83 == 5, F.concat(F.lit('{"event":"e",'), F.expr("substring(json, 2)")))
            .otherwise(F.col("json")))
    spark.read.parquet(json_path).select(line.alias("value")).write.text(path)
    return src.read_lines(spark, path)


BAD = "ord % 67 = 1 OR ord % 71 = 2 OR ord % 73 = 3"


@query("read_history", "SRC01", oracle(["history"], f"SELECT ord, id, lane, started_at, run_ms, upload_ms, res_cpu FROM history WHERE NOT ({BAD} OR ord % 79 = 4 OR ord % 83 = 5)"))
def read_history(spark, sf):
    return src.parse_history(_lines(spark, sf)).drop("ord").selectExpr("CAST(queuedAt AS BIGINT) AS ord", "id", "lane", "startedAt AS started_at", "runMs AS run_ms", "remotePhasesMs.uploadMs AS upload_ms", "resources.cpuCores AS res_cpu")


@query("read_rows", "SRC02", oracle(["history"], f"SELECT ord, id, CASE WHEN ord % 83 = 5 AND ord % 79 <> 4 THEN 'e' END AS event FROM history WHERE NOT ({BAD})"))
def read_rows(spark, sf):
    return src.parse_rows(_lines(spark, sf)).selectExpr("CAST(queuedAt AS BIGINT) AS ord", "id", "event")


@query("read_recent_history", "SRC03 SNK03", oracle(["history"], "SELECT ord, repo, started_at FROM history WHERE repo = '_home_proj_foo_.git' AND (started_at IS NULL OR started_at >= 900000000000) AND coalesce(ended_at, started_at, 900000000000) >= 900000000000 - 86400000"))
def read_recent_history(spark, sf):
    path = work_path(spark, "history")
    append_history(history(spark, sf), path, "month")
    rows = src.recent_history(spark.read.parquet(path), 900_000_000_000.0, "_home_proj_foo_.git", "month")
    return rows.selectExpr("ord", "repo", "startedAt AS started_at")


def _journal_lines(spark, sf):
    """Journal lines (ord, value), some without a time or an event, some torn."""
    j = flat(spark, sf, "journal")
    at = F.when(F.col("ord") % 50 == 7, "not a time").otherwise(F.concat(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    event = F.when(F.col("ord") % 61 != 8, F.col("event"))
    whole = F.to_json(F.struct(at.alias("at"), event.alias("event"), "pr", "prs", F.col("run_id").alias("runId"), F.col("lane_id").alias("laneId")))
    return j.select("ord", F.when(F.col("ord") % 53 == 9, F.substring(whole, 1, 25)).otherwise(whole).alias("value"))


def _journal_counts(rows):
    return rows.groupBy("t_ms", "event", "pr", "run_id", F.array_join("prs", ",").alias("prs")).agg(F.count("*").alias("n"))


@query("read_journal", "SRC04", oracle(["journal"], "SELECT t_ms, event, pr, run_id, array_to_string(prs, ',') AS prs, count(*) AS n FROM journal WHERE ord % 50 <> 7 AND ord % 61 <> 8 AND ord % 53 <> 9 GROUP BY ALL"))
def read_journal(spark, sf):
    path = work_path(spark, "journal")
    _journal_lines(spark, sf).select("value").write.text(path)
    return _journal_counts(src.read_journal(spark, path))


GROWN = 4  # files that a writer appends to
RANGES = 256  # byte ranges that large files are cut into, about


def _write_prefix(folder: str, sizes: dict[int, int], step: int, steps: int):
    """A writer at work: each task's file holds its lines up to a share of its bytes (`sizes`, by task), wherever that cuts a line."""

    def run(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        task, n = TaskContext.get().partitionId(), 0
        left = sizes.get(task, 0) * step // steps
        with store.open_output_stream(f"{root}/log-{task:03d}.txt") as f:
            for b in batches:
                n += b.num_rows
                if left > 0:
                    data = "".join(f"{v}\n" for v in b.column(0).to_pylist()).encode()[:left]
                    f.write(data)
                    left -= len(data)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _grown(spark, lines, stream, name):
    """The rows of `stream` over files that grow in three steps, each ending within a line but the last; one query run after each step."""
    folder, table, checkpoint = (work_path(spark, f"{name}-{x}") for x in ("files", "table", "checkpoint"))
    whole = cut_lineage(lines.select("ord", "value").repartition(GROWN, "ord").sortWithinPartitions("ord"), f"{name}-lines")
    dealt = whole.repartition(GROWN, "ord").sortWithinPartitions("ord").select("value")
    long = F.coalesce(F.octet_length("value"), F.lit(len("None"))) + F.lit(1)
    sizes = {r.task: r.bytes for r in dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(long).alias("bytes")).collect()}  # GROWN rows
    split = max(1 << 16, sum(sizes.values()) // RANGES)
    for step in (1, 2, 3):
        dealt.mapInArrow(_write_prefix(folder, sizes, step, 3), "n long").agg(F.sum("n")).collect()
        rows = stream(spark, folder, split_bytes=split)
        jobs.append_available(rows, table, checkpoint)
    return spark.read.schema(rows.schema).parquet(table)


@query("stream_journal", "SRC04", ORACLES["read_journal"])
def stream_journal(spark, sf):
    return _journal_counts(_grown(spark, _journal_lines(spark, sf), src.stream_journal, "journal"))


def _decision_lines(spark, sf):
    """Decision-log lines (ord, value), among lines of other events."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    stamp = F.concat(F.date_format(F.timestamp_millis(F.lit(1704067200000) + F.col("event_id") * 7000), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    verdict = F.when(F.col("event_type") == "purchase", "admit").otherwise("deny")
    cur = F.when(F.col("event_id") % 5 < 2, "admit:ok").otherwise("deny:load")
    line = F.concat_ws(" ", stamp, F.when(F.col("event_id") % 40 == 3, "other-event").otherwise("host-admission"), F.concat(F.lit("candidate=c"), (F.col("user_id") % 30).cast("string")), F.lit("mode=shadow"),
                       F.concat(F.lit("current="), cur), F.concat(F.lit("new="), verdict, F.lit(":r"), (F.col("event_id") % 4).cast("string")), F.concat(F.lit("cores="), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("ord"), line.alias("value"))


def _decision_rows(rows):
    """The line's own number is its `cores`, as the files' order is another."""
    return rows.withColumn("ord", F.element_at("fields", "cores").cast("long")).select("ord", "t_ms", "candidate", "current_admit", "current_reason", "admit", "reason")


@query("read_decision_log", "SRC09", """SELECT event_id AS ord, 1704067200000 + event_id * 7000 AS t_ms, 'c' || (user_id % 30)::VARCHAR AS candidate, event_id % 5 < 2 AS current_admit, CASE WHEN event_id % 5 < 2 THEN 'ok' ELSE 'load' END AS current_reason,
  event_type = 'purchase' AS admit, 'r' || (event_id % 4)::VARCHAR AS reason FROM events WHERE event_id % 40 <> 3""")
def read_decision_log(spark, sf):
    path = work_path(spark, "decisions")
    _decision_lines(spark, sf).select("value").write.text(path)
    return _decision_rows(src.read_decision_log(spark, path))


@query("stream_decision_log", "SRC09", ORACLES["read_decision_log"])
def stream_decision_log(spark, sf):
    return _decision_rows(_grown(spark, _decision_lines(spark, sf), src.stream_decision_log, "decisions"))


@query("read_store_journal", "SRC06", oracle(["store_journal"], "SELECT 's' || store::VARCHAR AS store, seq, path, sha, size_bytes, created_ms FROM store_journal WHERE seq % 29 <> 3"))
def read_store_journal(spark, sf):
    j = flat(spark, sf, "store_journal").withColumn("kind", F.lit("blob"))
    whole = F.to_json(F.struct("seq", "kind", "path", F.col("sha").alias("sha256"), F.col("size_bytes").alias("size"), F.col("created_ms").alias("createdAt")))
    paths = {}
    for store in (0, 1, 2):
        path = paths[f"s{store}"] = work_path(spark, f"store-journal-{store}")
        # torn lines end early, and blank ones stand between
        j.filter(F.col("store") == store).select(F.when(F.col("seq") % 29 == 3, F.substring(whole, 1, 30)).otherwise(F.concat(whole, F.when(F.col("seq") % 31 == 4, "\n").otherwise(""))).alias("value")).write.text(path)
    return src.read_store_journal(spark, paths).drop("kind")


@query("read_process_table", "SRC10", oracle(["procs"], "SELECT host, snapshot_ms, pid, ppid, pgid, pcpu, rss_kib FROM procs WHERE pid % 30 <> 4 AND pid % 41 <> 5"))
def read_process_table(spark, sf):
    p = flat(spark, sf, "procs")
    line = F.concat_ws("  ", F.lit(""), "pid", F.when(F.col("pid") % 30 == 4, "x").otherwise(F.col("ppid").cast("string")), "pgid", "pcpu", F.when(F.col("pid") % 41 != 5, F.col("rss_kib").cast("string")))
    return src.parse_process_table(p.select("host", "snapshot_ms", line.alias("line")))


@query("report_as_json", "SNK01", ORACLES["losses_per_runner"])
def report_as_json(spark, sf):
    report = reports.losses_report(history(spark, sf), q_reports.REPOS, q_reports.SINCE, q_reports.UNTIL)
    path = work_path(spark, "report")
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("derived_express_table", "SNK02 AGG18", ORACLES["express_table"])
def derived_express_table(spark, sf):
    path = work_path(spark, "express")

    def build():
        return estimates.express_table(history(spark, sf))

    derived_table(spark, path, "min3", 1_000, 300_000, build)
    return derived_table(spark, path, "min3", 200_000, 300_000, build)


@query("read_prs", "SRC05", oracle(["prs"], "SELECT repo, number, merged_ms, closed_ms, array_to_string(labels, ',') AS labels FROM prs"))
def read_prs(spark, sf):
    p = flat(spark, sf, "prs")
    iso = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    plain = p.select("repo", "number", iso("merged_ms").alias("mergedAt"), iso("closed_ms").alias("closedAt"), "labels")
    by_repo = {}
    for repo in ("foo", "bar"):
        path = work_path(spark, f"prs-{repo}")
        rows = plain.filter(F.col("repo") == repo)
        named = rows.withColumn("labels", F.transform("labels", lambda x: F.struct(x.alias("name")))) if repo == "bar" else rows
        named.drop("repo").write.json(path)
        by_repo[repo] = [path]
    return src.read_prs(spark, by_repo, multi_line=False).select("repo", "number", "merged_ms", "closed_ms", F.array_join("labels", ",").alias("labels"))


SNAPSHOT = ["tickets", "agents", "jobs", "groups", "parents"]


@query("read_queue_snapshot", "SRC08 AGG29", oracle(SNAPSHOT, "SELECT 'tickets' AS name, snapshot AS snapshot_ts, state, count(*) AS n FROM tickets GROUP BY 1, 2, 3"
       + "".join(f" UNION ALL SELECT '{t}', 7, NULL, count(*) FROM {t}" for t in SNAPSHOT[1:])))
def read_queue_snapshot(spark, sf):
    root = work_path(spark, "queue")
    for t in SNAPSHOT:
        rows = flat(spark, sf, t)
        (rows.withColumnRenamed("snapshot", "snapshot_ts") if t == "tickets" else rows.withColumn("snapshot_ts", F.lit(7))).write.partitionBy("snapshot_ts").parquet(f"{root}/{t}")
    out = []
    for t, rows in src.read_queue_snapshot(spark, root, SNAPSHOT).items():
        state = F.col("state") if t == "tickets" else F.lit(None).cast("string")
        out.append(rows.groupBy(F.lit(t).alias("name"), F.col("snapshot_ts").cast("long").alias("snapshot_ts"), state.alias("state")).agg(F.count("*").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


def _write_objects(root: str):
    """Writes one file for each (path, size)."""

    def run(batches):
        store, base = open_store(root)
        for batch in batches:
            for path, size in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(b"x" * size)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


@query("read_inventory", "SRC07 SCL17", oracle(["store_journal"], """
p AS (SELECT DISTINCT store, seq % 4 AS kind, seq, path, sha FROM store_journal),
f AS (SELECT CASE kind WHEN 0 THEN path WHEN 1 THEN 'manifests/j' || seq::VARCHAR || '.json' END AS path, CASE kind WHEN 0 THEN 'blob' ELSE 'manifest' END AS object_kind, CASE kind WHEN 0 THEN sha END AS object_sha, CASE kind WHEN 1 THEN 'j' || seq::VARCHAR END AS object_job FROM p WHERE kind < 2)
SELECT DISTINCT path, object_kind, object_sha, object_job, length(path) * 7 % 50 AS size_bytes FROM f"""))
def read_inventory(spark, sf):
    """Objects among files with foreign names: below another folder, or with a fan-out that isn't the sha's."""
    name = "CASE seq % 4 WHEN 0 THEN path WHEN 1 THEN concat('manifests/j', seq, '.json') WHEN 2 THEN concat('tmp/', path) ELSE concat('blobs/zz/zz/', sha) END AS path"
    files = flat(spark, sf, "store_journal").selectExpr(name).distinct().selectExpr("path", "length(path) * 7 % 50 AS size")
    root = work_path(spark, "objects")
    files.mapInArrow(_write_objects(root), "n long").agg(F.sum("n")).collect()
    return src.read_inventory(spark, root).select("path", "object_kind", "object_sha", "object_job", F.col("size_bytes").cast("int").alias("size_bytes"))
