"""State carried over micro-batches, ingest of raw rows, and process trees deeper than the report bound."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from runlens.plans import inventory, telemetry
from runlens.streaming import jobs, state


@pytest.fixture
def batches(spark, tmp_path):
    """A stream that delivers rows in several micro-batches, one file each, in order."""

    def build(rows, schema, parts=4):
        size = -(-len(rows) // parts)
        folder = str(tmp_path / "rows")
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.02)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def test_gates_carry_state_and_restart_on_new_thresholds(spark, batches):
    loads = [13, 5, 5, 5, 4, 13, 5, 5, 5, 5, 7, 13, 3, 3, 3, 20, 1, 1, 1, 1]
    rows = [("h", i, float(x), "a" if i < 8 or i > 13 else "b") for i, x in enumerate(loads)]
    schema = "host string, ord long, load double, th string"
    want = telemetry.load_gate(spark.createDataFrame(rows, schema), 12, 6, 3, F.col("th"))
    out = jobs.run_to_table(state.hysteresis(batches(rows, schema), "host", "load", 12, 6, 3, thresholds="th"), "t-gate")
    assert rows_of(out, "ord", "closed") == rows_of(want, "ord", "closed")


def test_device_gate_over_batches(spark, batches):
    rows = [("h", i, v, inf, "a") for i, (v, inf) in enumerate([("hot", True), (None, True), (None, False), (None, True), (None, True), ("low", True), (None, True), (None, True), (None, True)])]
    schema = "host string, ord long, violation string, informative boolean, th string"
    want = telemetry.device_gate(spark.createDataFrame(rows, schema), F.col("violation"), F.col("informative"), 3, F.col("th"))
    out = jobs.run_to_table(state.device_hysteresis(batches(rows, schema), 3, "th"), "t-device")
    assert rows_of(out, "ord", "closed", "reason") == rows_of(want, "ord", "closed", "reason")


def test_silence_over_batches(spark, batches):
    rows = [("l", i, i * 1000 + (5000 if i > 12 else 0), 1.0 if i % 5 else None, 0.1 if i % 7 else 3.0, i in (2, 9), 2.0, 0) for i in range(20)]
    schema = "lease_id string, ord long, t_ms long, cores double, interval_cores double, wrote_output boolean, charged_cores double, started_ms long"
    limits = dict(max_gap_ms=3000, below_fraction=0.5, hung_cores=0.2, hung_after_ms=2000, idle_after_ms=2000)
    leases = spark.createDataFrame([("l", 2.0, 0)], "lease_id string, charged_cores double, started_ms long")
    want = telemetry.silence(spark.createDataFrame(rows, schema).drop("charged_cores", "started_ms"), leases, **limits)
    out = jobs.run_to_table(state.silence_flags(batches(rows, schema), **limits), "t-silence")
    cols = ["ord", "silent_ms", "idle_ms", "idle", "silent", "hung"]
    assert rows_of(out, *cols) == rows_of(want, *cols)


def test_ingest_keeps_idless_and_late_rows(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    day = 86_400_000
    files = [
        [dict(id="a", endedAt=20 * day), dict(endedAt=20 * day), dict(id="", endedAt=20 * day)],
        [dict(id="b", endedAt=21 * day), dict(id="a", endedAt=20 * day), dict(endedAt=20 * day), dict(id="n")],
        [dict(id="late", endedAt=3 * day), dict(id="b", endedAt=21 * day), dict(id="b", endedAt=21 * day)],
        [dict(id="late", endedAt=3 * day), dict(), dict(id="n")],
    ]
    for i, rows in enumerate(files):
        (source / f"{i}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{i}.jsonl", (1_000_000 + i, 1_000_000 + i))
    for _ in range(2):  # nothing new the second time
        jobs.ingest_history(spark, str(source), target, str(tmp_path / "check"), max_files=1).awaitTermination()
    got = sorted((r["id"] or "-", r["endedAt"]) for r in spark.read.parquet(target).fillna(0, ["endedAt"]).collect())
    assert got == sorted([("a", 20.0 * day), ("b", 21.0 * day), ("late", 3.0 * day), ("n", 0.0), ("-", 0.0), ("-", 20.0 * day), ("-", 20.0 * day), ("-", 20.0 * day)])


def test_lease_holds_members_beyond_64_levels(spark):
    procs = [("h", 0, 1000 + i, 999 + i if i else 1, 7 if i == 0 else 50 + i, 1.0, 1.0) for i in range(150)]
    procs += [("h", 0, 5001, 5002, 1, 1.0, 1.0), ("h", 0, 5002, 5003, 1, 1.0, 1.0), ("h", 0, 5003, 5001, 1, 1.0, 1.0)]  # a cycle outside
    df = spark.createDataFrame(procs, "host string, snapshot_ms long, pid long, ppid long, pgid long, pcpu double, rss_kib double")
    leases = spark.createDataFrame([("h", "L", 7, None)], "host string, lease_id string, pgid long, supervisor_pid long")
    members = telemetry.lease_members(df, leases)
    assert sorted(r["pid"] for r in members.collect()) == [1000 + i for i in range(150)]


def test_manifest_entries_compare_in_canonical_form(spark):
    schema = "job string, path string, type string, exec boolean, size_bytes long, sha string, target string"
    e = spark.createDataFrame([("j", "a", "file", None, 1, "s", None), ("j", "b", "symlink", None, None, None, "t"), ("j", "c", "symlink", None, None, None, "t"), ("j", "d", "file", True, 1, "s", "x")], schema)
    p = spark.createDataFrame([("j", "a", "file", False, 1, "s", "left over"), ("j", "b", "symlink", False, 0, "x", "t"), ("j", "c", "symlink", None, None, None, "u"), ("j", "d", "file", None, 1, "s", None)], schema)
    assert sorted((r["path"], r["difference"], r["first"]) for r in inventory.manifest_diff(e, p).collect()) == [("c", "target mismatch", True), ("d", "exec mismatch", False)]


def test_manifest_hash_has_lower_case_escapes(spark):
    import hashlib

    path = "a\x1fb\\u001Fc"
    df = spark.createDataFrame([([(path, "symlink", None, None, None, "t")],)], "entries array<struct<path: string, type: string, exec: boolean, size: long, sha256: string, target: string>>")
    text = '[{"path":"a\\u001fb\\\\u001Fc","type":"symlink","target":"t"}]'
    assert df.select(inventory.manifest_hash(F.col("entries"))).first()[0] == hashlib.sha256(text.encode()).hexdigest()
