"""A table with one row per key, brought up to date by the batches of a stream: the newest row, or a summary that merges.

Rows live in hash buckets, each a folder of Parquet files that is never changed once written. A batch writes new versions of the buckets it touches
and then one manifest, a single file that names the version of every bucket; readers take the newest manifest, so they see a batch as a
whole or not at all, and a batch that is run again finds its epoch done. Versions that no kept manifest names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedTable:
    """`merge` makes one row of the rows with equal `keys`; given a column's name it keeps the row where that is largest.

    Rows are dealt to buckets by `by`, some or all of the keys. A merge must not mind order or repeated rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: str | Callable[[DataFrame], DataFrame], buckets: int = 64, by: list[str] | None = None):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.by, self.merge = by or keys, merge if callable(merge) else lambda rows: self._newest(rows, merge)

    def manifests(self) -> dict[int, dict[int, int]]:
        """Epoch -> bucket -> version, of the manifests that are kept."""
        out: dict[int, dict[int, int]] = {}
        try:
            rows = self.spark.read.schema("bucket int, version long, epoch long").parquet(f"{self.path}/manifests").collect()  # `buckets` rows each
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        for r in rows:
            out.setdefault(r.epoch, {})[r.bucket] = r.version
        return out

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/epoch={version}/bucket={bucket}"

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(b, v) for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        """The table as of the newest manifest."""
        manifests = self.manifests()
        return self._rows(manifests[max(manifests)] if manifests else {})

    def _newest(self, rows: DataFrame, order: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("x_")).select(*self.keys, "x_.*")

    def upsert(self, batch: DataFrame, epoch: int, keep: int = 2) -> list[int]:
        """Brings the table up to date with `batch`; the buckets that were rewritten. An epoch that is done changes nothing."""
        manifests = self.manifests()
        done = max(manifests, default=-1)
        if done >= epoch:
            return []
        now = manifests.get(done, {})
        batch = batch.persist()
        try:
            fresh = self.merge(batch.select(*self.spark.createDataFrame([], self.schema).columns))
            bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
            touched = sorted(r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect())  # at most `buckets`
            if not touched:
                return []
            merged = self.merge(self._rows({b: now[b] for b in touched if b in now}).unionByName(fresh)).withColumn("bucket", bucket)
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/epoch={epoch}")
        finally:
            batch.unpersist()
        now = now | dict.fromkeys(touched, epoch)
        # one file, renamed into place when it is complete: this is the switch
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/epoch={epoch}")
        self._vacuum(manifests | {epoch: now}, keep)
        return touched

    def _vacuum(self, manifests: dict[int, dict[int, int]], keep: int) -> None:
        kept = sorted(manifests)[-keep:]
        used = {x for e in kept for x in manifests[e].items()}
        gone = {x for e in manifests if e not in kept for x in manifests[e].items()} - used
        for folder in [*[self._folder(*x) for x in sorted(gone)], *[f"{self.path}/manifests/epoch={e}" for e in sorted(manifests) if e not in kept]]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
