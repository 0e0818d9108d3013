"""Reports on small rows with known answers."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from runlens.plans import reports
from runlens.schema import HISTORY
from runlens.sources import history as src


def T(text):
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc).timestamp() * 1000


#: One week from Monday; the rows below are made up for these tests and the expectations worked out by hand.
SINCE, UNTIL = T("2025-03-03T00:00:00Z"), T("2025-03-10T00:00:00Z")
FOO, BAR = "_srv_ci_proj_foo_.git", "_srv_ci_proj_bar_.git"


def _history(spark, rows):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(HISTORY)

    def fill(value, t):
        if value is None or not hasattr(t, "fields"):
            return value
        return tuple(fill(value.get(f.name), f.dataType) for f in t.fields)

    data = [tuple(fill(r.get(f.name), f.dataType) for f in schema.fields) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema.add("ord", "long")).repartition(3)


@pytest.fixture(scope="module")
def cost(spark):
    at = lambda day, clock: T(f"2025-03-{day:02d}T{clock}:00Z")
    retry = dict(repo=FOO, lane="prepush", startedAt=at(5, "10:00"), endedAt=at(5, "10:09"), runMs=180_000.0, grantedCpuCores=1.0, exit=0, executor="remote", runner="kiwi")
    rows = [
        dict(id="q1", repo=FOO, lane="prepush", startedAt=at(4, "08:00"), endedAt=at(4, "08:07"), waitedMs=30_000.0, grantedCpuCores=4.0, exit=0, executor="local", cpuSeconds=50.0),
        retry, retry,  # without an id both rows count
        dict(id="t1", repo=FOO, lane="train", startedAt=at(6, "12:00"), endedAt=at(6, "12:20"), resources=dict(cpuCores=2.0), exit=2, executor="remote", runner="kiwi"),
        dict(id="t2", repo=FOO, lane="train", startedAt=at(6, "13:00"), endedAt=at(6, "13:10"), weight=3.0, exit=0, executor="local"),
        dict(id="z1", repo=FOO, lane="lint", startedAt=at(8, "09:00"), endedAt=at(8, "09:04"), exit=0),
        dict(id="z2", repo=FOO, lane="lint", startedAt=SINCE, endedAt=SINCE + 1, runMs=60_000.0, exit=0),  # the window holds its start
        dict(id="q1", repo=FOO, lane="prepush", startedAt=at(7, "08:00"), endedAt=at(7, "09:00"), exit=1),  # a later row of a known id
        dict(id="late", repo=FOO, lane="prepush", startedAt=UNTIL, endedAt=UNTIL + 60_000.0, exit=0),  # but not its end
        dict(id="b9", repo=BAR, lane="prepush", startedAt=at(4, "08:00"), endedAt=at(4, "08:30"), exit=0),
    ]
    events = [
        (4, "06:00", "enqueue", 11, None, None, None), (4, "06:10", "enqueue", 12, None, None, None), (4, "06:10", "enqueue", 12, None, None, None),
        (4, "06:30", "remove", 12, None, None, None), (4, "08:00", "enqueue", 12, None, None, None), (4, "09:00", "batch-built", None, [11, 12], "n1", None),
        (6, "12:00", "lane-start", None, None, "n1", "t1"), (6, "13:00", "lane-start", None, None, "master-77", "t2"), (4, "09:30", "landed", None, None, "n1", None),
        (8, "10:00", "enqueue", 13, None, None, None), (8, "10:45", "batch-built", None, [13, 14], "n2", None), (8, "11:00", "landed", None, None, "n2", None),
        (9, "12:00", "landed", None, None, "n2", None),  # landing twice: the first counts
        (9, "15:00", "enqueue", 15, None, None, None), (2, "20:00", "enqueue", 16, None, None, None), (10, "02:00", "landed", None, None, "n1", None),
    ]
    journal = spark.createDataFrame([("foo", i, int(at(d, c)), e, pr, prs, run, lane) for i, (d, c, e, pr, prs, run, lane) in enumerate(events)],
                                    "repo string, ord long, t_ms long, event string, pr long, prs array<long>, run_id string, lane_id string")
    ms = lambda x: None if x is None else int(at(*x))
    prs = spark.createDataFrame([("foo", n, ms(m), ms(c), labels) for n, m, c, labels in [
        (11, None, (4, "09:31"), ["train-landed"]), (13, (8, "11:01"), (8, "11:01"), ["x"]), (20, (7, "16:00"), (7, "16:00"), []), (21, None, (5, "10:00"), []), (22, (1, "10:00"), (1, "10:00"), [])]],
        "repo string, number long, merged_ms long, closed_ms long, labels array<string>")
    return reports.cost_report(_history(spark, rows), journal, prs, ["foo"], SINCE, UNTIL)


def test_cost_spend(cost):
    spend = {r["cls"]: r for r in cost.spend.collect()}
    assert {c: (r["runs"], r["wall_min"], r["reserved_core_min"]) for c, r in spend.items()} == {
        "gate": (3, 13, 34), "train-batch": (1, 20, 40), "master-verify": (1, 10, 30), "ad-hoc": (2, 5, 5), "TOTAL": (7, 48, 109)}
    assert (spend["gate"]["cpu_seconds"], spend["gate"]["cpu_runs"], spend["gate"]["wait_min"]) == (50, 1, 0.5)
    assert spend["train-batch"]["failed"] == 1 and spend["TOTAL"]["failed"] == 1
    assert {r["cls"]: r["reserved_core_min"] for r in cost.per_pr.collect()}["TOTAL"] == pytest.approx(109 / 5)


def test_cost_prs_and_latency(cost):
    c = cost.counts.first()
    assert (c["github_merged"], c["github_train_landed"], c["journal_landed"], c["union"], c["only_journal"], c["only_github"]) == (2, 1, 4, 5, 2, 1)
    assert (c["landed_weekday"], c["landed_weekend"]) == (3, 2)
    lat = cost.latency.first()  # waits of 210, 90 and 60 minutes
    assert (lat["n"], lat["p50"], lat["p90"], lat["max"], lat["prs_without_enqueue"]) == (3, 90, 210, 210, 2)
    assert sorted((r["pr"], r["age_min"], r["before_window"]) for r in cost.unfinished.collect()) == [(15, 540, False), (16, 10_320, True)]
    assert {r["executor"]: r["runs"] for r in cost.executors.collect()} == {"local": 4, "remote:kiwi": 3}


def test_phases(spark):
    base = dict(repo=FOO, executor="remote", startedAt=T("2025-03-05T05:00:00Z"))
    rows = [
        base | dict(id="a", runner="kiwi", depsCache="hit", remotePhasesMs=dict(snapshotMs=200.0, depsMs=600.0, setupMs=200.0, commandMs=3000.0)),
        base | dict(id="b", runner="kiwi", depsCache="hit", remotePhasesMs=dict(snapshotMs=100.0, setupMs=300.0, commandMs=1500.0, artifactsMs=100.0)),
        base | dict(id="a", runner="kiwi", depsCache="miss", remotePhasesMs=dict(depsMs=9999.0)), base | dict(id="c", remotePhasesMs=dict(snapshotMs=50.0)),
        base | dict(id="d", runner="kiwi"), base | dict(id="e", executor="local", remotePhasesMs=dict(commandMs=7.0))]
    h = _history(spark, rows)
    got = {(r["runner"], r["phase"]): r for r in reports.phases_report(h, ["foo"], SINCE, UNTIL).collect()}
    assert [got["kiwi", "snapshotMs"][k] for k in ("runs", "n", "p50", "p90", "max")] == [2, 2, 100, 200, 200]
    assert (got["kiwi", "depsMs"]["n"], got["kiwi", "depsMs"]["p50"]) == (1, 600) and got["unknown", "commandMs"]["p50"] is None
    share = {r["runner"]: r for r in reports.phase_overhead(h, ["foo"], SINCE, UNTIL).collect()}
    assert share["kiwi"]["overhead_share"] == pytest.approx(1400 / 6000) and share["kiwi"]["depsCache"] == {"hit": 2}
    assert share["unknown"]["overhead_share"] is None


def test_reader_skips_torn_blank_null_and_diagnostic_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id":"1","startedAt":1}\n\nnull\n7\n{"event":null,"id":"d"}\n{"id":"2","startedAt":"x","endedAt":5}\n{"id":"3","ru')
    (tmp_path / "a.jsonl").write_text('{"id":"0"}\n{"event":"supervisor-error"}\n')
    rows = src.read_history(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["0", "1", "2"]
    assert rows[2]["startedAt"] is None and rows[2]["endedAt"] == 5
    assert src.read_rows(spark, str(tmp_path)).count() == 5


def test_derived_table_is_reused_until_stale(spark, tmp_path):
    from runlens.sources.sinks import derived_table

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for now, params in [(1000, "a"), (1500, "a"), (1500, "b"), (9000, "a")]:
        assert derived_table(spark, str(tmp_path / "t"), params, now, 5000, build).count() == 3
    assert len(calls) == 3


def test_prs_accept_both_label_shapes(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"number": 1, "mergedAt": null, "closedAt": "2026-10-09T00:00:00Z", "labels": [{"name": "train-landed"}]},\n {"number": 2, "labels": ["bug"]}]')
    got = {r["number"]: r for r in src.read_prs(spark, {"foo": [str(tmp_path / "p.json")]}).collect()}
    assert got[1]["labels"] == ["train-landed"] and got[2]["labels"] == ["bug"] and got[1]["closed_ms"] == T("2026-10-09T00:00:00Z")


def test_availability_follows_local_time(spark):
    from runlens.plans.placement import availability

    sched = spark.sql("SELECT 'r' AS runner, 'America/New_York' AS timezone, array('mon') AS days, 1320L AS from_min, 120L AS to_min")
    at = spark.createDataFrame([(int(T(x)),) for x in ("2026-10-13T01:00:00Z", "2026-10-13T03:00:00Z", "2026-10-13T05:59:00Z", "2026-10-13T06:00:00Z")], "t_ms long")
    got = {r["t_ms"]: r["closes_at"] for r in availability(at, sched).collect()}
    assert [got[r["t_ms"]] for r in at.collect()] == [None, int(T("2026-10-13T06:00:00Z")), int(T("2026-10-13T06:00:00Z")), None]
