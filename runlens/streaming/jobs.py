"""Streaming jobs: history ingest, windowed tallies, and running a stream over files to completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.runs import finite
from runlens.plans.inventory import MARK_KINDS, object_records
from runlens.plans.telemetry import cpu_seconds
from runlens.session import work_path
from runlens.sources.history import parse_history, settled_day, stream_lines
from runlens.sources.sinks import MaintainedTable
from runlens.sources.upserts import BucketedTable


def history_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Run rows of a growing folder of history files; `max_files` bounds a micro-batch."""
    return parse_history(stream_lines(spark, path, max_files))


def ingest_history(spark: SparkSession, source: str, target: str, checkpoint: str, unit: str = "day", max_files: int | None = None):
    """Appends the stream to the stored history: an id is stored once for its day, however late; rows without an id all pass.

    A batch looks only at the stored days that it touches. A repeated batch rewrites its own files.
    """

    def stored(epoch: int) -> DataFrame | None:
        try:
            return spark.read.parquet(target).filter(F.col("epoch") != epoch).select("id", "dt")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumns({"dt": settled_day(unit), "epoch": F.lit(epoch)})
        named = F.coalesce("id", F.lit("")) != ""
        once = rows.filter(named).dropDuplicates(["id", "dt"])
        before = stored(epoch)
        if before is not None:
            old = before.filter(named).withColumnsRenamed({"id": "old_id", "dt": "old_dt"})
            once = once.join(old, (F.col("id") == F.col("old_id")) & F.col("dt").eqNullSafe(F.col("old_dt")), "left_anti")
        once.unionByName(rows.filter(~named)).hint("rebalance", "dt").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("epoch", "dt").parquet(target)

    return history_stream(spark, source, max_files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_rates(decisions: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Decisions per host, window, verdict and reason; a window is emitted once the watermark passes it."""
    ts = decisions.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return ts.groupBy(span, "host", F.when(F.col("admit"), "admit").otherwise("deny").alias("verdict"), "reason").agg(F.count("*").alias("n")).select(
        "host", F.unix_millis("window.start").alias("hour_ms"), "verdict", "reason", "n")


def wait_sessions(polls: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Wait sessions per ticket and reason, closed after a gap."""
    ts = polls.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay)
    return ts.groupBy(F.session_window("ts", gap), "ticket", "reason").agg(F.count("*").alias("polls")).select(
        "ticket", "reason", F.unix_millis("session_window.start").alias("since_ms"), "polls")


def finished_cpu(readings: DataFrame, ends: DataFrame, max_run: str = "2 days", reading_delay: str = "10 minutes", end_delay: str = "10 minutes") -> DataFrame:
    """CPU seconds of each lease once its end is known (lease_id, cpu_seconds), as integrated_cpu gives them.

    readings: lease_id, ord, t_ms, cores; ends: lease_id, started_ms, ended_ms, each lease once. The two streams are joined on the lease and a
    time range: readings wait for an end until none can come that is within `max_run` of them, ends wait for readings of their run that are late by
    `reading_delay`. A result is emitted when both watermarks have passed the lease's end; it holds the readings of that run, folded in
    arrival order. Readings further than `max_run` before the end, or `reading_delay` behind it, don't count.
    """
    r = readings.filter(finite(F.col("cores")).isNotNull()).select("lease_id", "ord", "t_ms", "cores", F.timestamp_millis("t_ms").alias("read_ts")).withWatermark("read_ts", reading_delay)
    e = ends.select(F.col("lease_id").alias("of_lease"), "started_ms", "ended_ms", F.timestamp_millis("ended_ms").alias("end_ts")).withWatermark("end_ts", end_delay)
    near = (F.col("read_ts") >= F.col("end_ts") - F.expr(f"INTERVAL {max_run}")) & (F.col("read_ts") <= F.col("end_ts") + F.expr(f"INTERVAL {reading_delay}"))
    rows = r.join(e, (F.col("lease_id") == F.col("of_lease")) & near)
    runs = rows.groupBy("lease_id", "end_ts", "started_ms", "ended_ms").agg(F.array_sort(F.collect_list(F.struct("ord", "t_ms", "cores"))).alias("readings"))
    first = F.struct(F.col("readings")[0]["t_ms"].alias("t_ms"), F.col("readings")[0]["cores"].alias("cores"))

    def step(acc, x):
        later = x["t_ms"] > acc["last"]["t_ms"]
        held = F.struct(x["t_ms"].alias("t_ms"), x["cores"].alias("cores"))
        return F.struct((acc["area"] + F.when(later, acc["last"]["cores"] * (x["t_ms"] - acc["last"]["t_ms"])).otherwise(0.0)).alias("area"), F.when(later, held).otherwise(acc["last"]).alias("last"))

    folded = F.aggregate("readings", F.struct(F.lit(0.0).alias("area"), first.alias("last")), step)
    return runs.withColumns({"first": first, "fold_": folded}).withColumns({"area": F.col("fold_.area"), "last": F.col("fold_.last")}).select("lease_id", cpu_seconds().alias("cpu_seconds"))


def object_tables(spark: SparkSession, target: str, buckets: int = 64) -> tuple[BucketedTable, BucketedTable]:
    """The state of each object (store, path, state, seq), and apart from it each path's newest record of each kind of mark (store, path, mark, seq)."""
    return (BucketedTable(spark, f"{target}/objects", "store long, path string, state string, seq long", ["store", "path"], "seq", buckets),
            BucketedTable(spark, f"{target}/marks", "store long, path string, mark string, seq long", ["store", "path", "mark"], "seq", buckets))


def follow_objects(journal: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> None:
    """Keeps both object tables up to date with a stream of journal records (store, seq, kind, path), whatever their order; runs over what is there now."""
    objects, marks = object_tables(journal.sparkSession, target, buckets)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("store", F.col("store").cast("long")).persist()
        try:
            objects.upsert(object_records(rows).select("store", "path", "state", "seq"), epoch)
            marks.upsert(rows.filter(F.col("kind").isin(MARK_KINDS)).select("store", "path", F.col("kind").alias("mark"), "seq"), epoch)
        finally:
            rows.unpersist()

    journal.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow_bypass(history: DataFrame, table: MaintainedTable, checkpoint: str, everything: Callable[[], DataFrame], clock: Callable[[], int]) -> None:
    """Keeps the summaries of the bypass table up to date with a stream of run rows; runs over what is there now."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.refresh(batch, epoch, clock(), everything)

    history.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an append stream over what is there now; a later call with the same folders goes on from there."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over the input available now and returns what it wrote."""
    spark = stream.sparkSession
    path, checkpoint = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
