"""Bucketed upserts: touched buckets only, repeated and out-of-order batches, readers between batches, and object states of a journal."""

import os

from pyspark.sql import functions as F

from runlens.sources.upserts import BucketedTable
from runlens.streaming import jobs

S = "id long, name string, seq long"


def table(spark, tmp_path, buckets=16):
    return BucketedTable(spark, str(tmp_path / "t"), S, ["id"], "seq", buckets)


def batch(spark, *rows):
    return spark.createDataFrame(rows, S)


def rows_of(t):
    return sorted(map(tuple, t.read().collect()))


def test_newest_row_wins_in_any_order(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows_of(t) == []
    t.upsert(batch(spark, (1, "a", 5), (2, "b", 1), (1, "old", 2)), 0)
    assert rows_of(t) == [(1, "a", 5), (2, "b", 1)]
    t.upsert(batch(spark, (1, "older", 3), (2, "new", 9), (None, "no key", 1)), 1)
    assert t.read().filter("id = 1").first().name == "a" and t.read().filter("id IS NULL").count() == 1 and t.read().count() == 3


def test_a_batch_rewrites_only_what_it_touches_and_a_repeated_one_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    all_ = t.upsert(batch(spark, *[(k, "x", 0) for k in range(200)]), 0)
    assert all_ == list(range(16))
    before = t.manifests()[0]
    touched = t.upsert(batch(spark, (7, "y", 1)), 1)
    after = t.manifests()[1]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    files = sorted(os.listdir(tmp_path / "t" / "data" / "epoch=1"))
    assert [f for f in files if f.startswith("bucket=")] == [f"bucket={touched[0]}"]
    assert t.upsert(batch(spark, (7, "again", 99)), 1) == [] and t.upsert(batch(spark, (7, "again", 99)), 0) == []
    assert t.read().filter("id = 7").first().name == "y" and t.read().count() == 200


def test_a_batch_that_stopped_before_its_manifest_is_not_seen(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, (1, "a", 0)), 0)
    half = batch(spark, (1, "half", 5)).withColumn("bucket", F.lit(3))
    half.write.partitionBy("bucket").parquet(str(tmp_path / "t" / "data" / "epoch=1"))
    assert rows_of(t) == [(1, "a", 0)]
    t.upsert(batch(spark, (1, "whole", 5)), 1)  # run again
    assert rows_of(t) == [(1, "whole", 5)]


def test_old_versions_go_and_a_reader_of_the_last_one_goes_on(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)
    t.upsert(batch(spark, *[(k, "0", 0) for k in range(20)]), 0)
    reader = t.read()
    t.upsert(batch(spark, (1, "1", 1)), 1)
    assert reader.filter("name = '0'").count() == 20
    for e in range(2, 6):
        t.upsert(batch(spark, *[(k, str(e), e) for k in range(20)]), e)
    assert sorted(t.manifests()) == [4, 5]
    assert not (tmp_path / "t" / "data" / "epoch=0" / "bucket=0").exists() and t.read().filter("name = '5'").count() == 20
    assert t.upsert(batch(spark), 6) == []


def test_pins_and_terminals_are_kept_apart_from_objects(spark, tmp_path):
    schema = "store long, seq long, kind string, path string"
    files = [
        [(0, 4, "delete", "a"), (0, 1, "blob", "a"), (0, 5, "pin", "a"), (1, 1, "manifest", "a")],
        [(0, 2, "delete-intent", "a"), (0, 6, "blob", "b"), (0, 9, "terminal", "b"), (0, 3, "delete-cancel", "a"), (0, 7, "delete-intent", "b")], [(0, 8, "unknown", "c"), (0, 2, "pin", "a")]]
    path = str(tmp_path / "journal")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    target, checkpoint = str(tmp_path / "target"), str(tmp_path / "checkpoint")
    jobs.follow_objects(s, target, checkpoint, buckets=4)
    objects, marks = jobs.object_tables(spark, target, buckets=4)
    assert sorted(map(tuple, objects.read().collect())) == [(0, "a", "delete", 4), (0, "b", "intent", 7), (1, "a", "put", 1)]
    assert sorted(map(tuple, marks.read().collect())) == [(0, "a", "pin", 5), (0, "b", "terminal", 9)]
    spark.createDataFrame([(0, 11, "blob", "a")], schema).write.mode("append").parquet(path)
    jobs.follow_objects(s, target, checkpoint, buckets=4)
    assert objects.read().filter("path = 'a' AND store = 0").first().state == "put"


H = "repo string, lane string, command string, cmdFingerprint string, executor string, exit int, startedAt double, endedAt double, runMs double, ord long"


def run_row(lane, k, ms, fp="f"):
    return ("r", lane, "make all", fp, "local", 0, 1000.0 * k, 1000.0 * k + ms, ms, k)


def frame(spark, rows):
    from runlens.schema import HISTORY

    full = spark.createDataFrame([], HISTORY)
    return spark.createDataFrame(rows, H).select(*[F.col(c) if c in H else F.lit(None).cast(full.schema[c].dataType).alias(c) for c in full.columns], "ord")


def test_a_batch_of_two_lanes_rewrites_two_and_ttl_or_parameters_rebuild(spark, tmp_path):
    from runlens.plans import estimates
    from runlens.sources.sinks import bypass_summaries

    t = bypass_summaries(spark, str(tmp_path / "b"), ttl_ms=1000, buckets=512)
    everything = [run_row(f"lane{i}", 10 * j + i, 100.0 * (j + 1)) for i in range(6) for j in range(4)]
    assert len(t.refresh(frame(spark, []), 0, 5_000, lambda: frame(spark, everything))) == 6
    more = [run_row("lane1", 900 + j, 5.0) for j in range(30)] + [run_row("lane4", 1, 7.0), run_row("lane4", 14, 200.0)]
    assert len(t.refresh(frame(spark, more), 1, 5_500, lambda: 1 / 0)) == 2
    assert t.refresh(frame(spark, more), 1, 5_600, lambda: 1 / 0) == []
    once = {(x[1], x[9]): x for x in [*everything, *more]}.values()  # lane4's run 14 came twice
    want = sorted(map(tuple, estimates.bypass_table(frame(spark, list(once)), 250.0).select("lane", "kind", "n", "median_ms", "strikes").collect()))
    got = estimates.bypass_of(t.read(5_900), 250.0)
    assert sorted(map(tuple, got.select("lane", "kind", "n", "median_ms", "strikes").collect())) == want and len(want) == 12
    assert t.read(6_000) is None
    assert len(t.refresh(frame(spark, more), 2, 6_000, lambda: frame(spark, everything[:4]))) == 1  # too old: built anew
    assert t.read(6_000).count() == 2
    other = bypass_summaries(spark, str(tmp_path / "b"), ttl_ms=1000)
    other.params = "runs5"
    assert other.read(6_000) is None


def test_inventory_lists_objects_only(spark, tmp_path):
    from runlens.sources import history

    sha = "ab" + "0" * 62
    for name, size in ((f"blobs/ab/00/{sha}", 3), (f"blobs/ab/01/{sha}", 1), ("manifests/job-1.json", 9), ("manifests/deep/x.json", 1), (f"tmp/blobs/ab/00/{sha}", 4), ("manifests/.hidden.json", 1), ("readme", 1)):
        path = tmp_path / "store root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    got = history.read_inventory(spark, str(tmp_path / "store root"))
    assert sorted((r.path, r.size_bytes, r.object_kind, r.object_job) for r in got.collect()) == [(f"blobs/ab/00/{sha}", 3, "blob", None), ("manifests/job-1.json", 9, "manifest", "job-1")]
    assert got.first().mtime_ms > 1_600_000_000_000
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[-1]


def test_inventory_is_listed_by_tasks(spark, tmp_path):
    from runlens.sources import history

    for i in range(300):
        path = tmp_path / "store" / "blobs" / f"{i % 16:02x}" / "00" / (f"{i % 16:02x}00" + f"{i:060x}")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (i % 7))
    for name in ("_tmp/x.json", ".hid/y.json", "manifests/_part.json", "manifests/a.json", "manifests/b.json._COPYING_"):
        path = tmp_path / "store" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
    root = f"file://{tmp_path}/store"
    got = history.read_inventory(spark, root)
    assert sorted(r.size_bytes for r in got.filter("object_kind = 'blob'").collect()) == sorted(i % 7 for i in range(300))
    assert [r.path for r in got.filter("object_kind = 'manifest'").collect()] == ["manifests/a.json"]
    # the files scanned are those of the listing's rows, not the objects: the driver never had them in an index
    assert not any(f"{tmp_path}/store" in f for f in got.inputFiles())
