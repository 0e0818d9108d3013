"""Report files, the derived-table cache and the stored history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.history import settled_day
from runlens.sources.upserts import BucketedTable


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def append_history(rows: DataFrame, path: str, unit: str = "day") -> None:
    """Adds run rows to the stored history, partitioned by the day (or month) they settled."""
    # rebalancing by day writes few files per day and splits a day that is too big for one task
    # the same layout as the streaming ingest, whose batches count from 0
    rows.withColumns({"dt": settled_day(unit), "epoch": F.lit(-1)}).hint("rebalance", "dt").write.mode("append").partitionBy("epoch", "dt").parquet(path)


def _newest_build(spark: SparkSession, path: str, params: str, now: int, ttl_ms: int, mark: str) -> int | None:
    """Build time of the newest finished build below `path` with these `params` that is younger than `ttl_ms`."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    best = None
    for status in fs.listStatus(fs_path) if fs.exists(fs_path) else ():
        stamp, _, tag = status.getPath().getName().partition("-")
        done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), mark))
        if done and stamp.isdigit() and tag == params and 0 <= now - int(stamp) < ttl_ms:
            best = max(best or 0, int(stamp))
    return best


def derived_table(
    spark: SparkSession, path: str, params: str, now: int, ttl_ms: int, build: Callable[[], DataFrame], write: bool = True,
) -> DataFrame:
    """The stored table while it is younger than `ttl_ms` and was built with the same `params`, else a new one.

    Tables are kept below `path` by build time and parameters; a finished write is recognised by its success marker.
    """
    best = _newest_build(spark, path, params, now, ttl_ms, "_SUCCESS")
    if best is None:
        table = build()
        if not write:
            return table
        best = now
        table.withColumn("built_at", F.lit(now)).write.mode("overwrite").parquet(f"{path}/{now}-{params}")
    return spark.read.parquet(f"{path}/{best}-{params}").drop("built_at")


class MaintainedTable:
    """A derived table kept as mergeable summaries, which each batch of a stream brings up to date.

    A batch merges its own summaries into the buckets they fall in. Past `ttl_ms`, or with other `params`, the next batch builds the table
    anew from all rows (`everything`), below a name of its own.
    """

    def __init__(self, spark: SparkSession, path: str, params: str, ttl_ms: int, schema: str, keys: list[str], by: list[str], summarise: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.params, self.ttl_ms, self.summarise = spark, path.rstrip("/"), params, ttl_ms, summarise
        self.table = lambda stamp: BucketedTable(spark, f"{self.path}/{stamp}-{params}", schema, keys, merge, buckets, by)

    def _stamp(self, now: int) -> int | None:
        return _newest_build(self.spark, self.path, self.params, now, self.ttl_ms, "manifests")

    def refresh(self, batch: DataFrame, epoch: int, now: int, everything: Callable[[], DataFrame]) -> list[int]:
        """The buckets that were rewritten."""
        stamp = self._stamp(now)
        return self.table(now if stamp is None else stamp).upsert(self.summarise(everything() if stamp is None else batch), epoch)

    def read(self, now: int) -> DataFrame | None:
        """The summaries while they are fresh."""
        stamp = self._stamp(now)
        return None if stamp is None else self.table(stamp).read()


def bypass_summaries(spark: SparkSession, path: str, ttl_ms: int, buckets: int = 64) -> MaintainedTable:
    """The summaries behind the bypass table, in buckets of lanes; the limit is applied by estimates.bypass_of."""
    from runlens.plans import estimates as e

    return MaintainedTable(spark, path, f"runs{e.BYPASS_RUNS}", ttl_ms, e.BYPASS_SUMMARY, e.BYPASS_KEYS, ["repo", "lane"], e.bypass_summary, e.merge_bypass_summaries, buckets)
