"""Session defaults and the shared work folder."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the Python workers once a session, unless their search path holds it already."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if here in os.environ.get("PYTHONPATH", "").split(os.pathsep) or importlib.util.find_spec("runlens") is None or spark.conf.get("runlens.shipped", None):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="runlens-"), "runlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(here, "runlens")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, here))
    spark.sparkContext.addPyFile(path)  # the driver hands it to every executor
    spark.conf.set("runlens.shipped", "true")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local temporary one only for a local master where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = spark.conf.get("runlens.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("runlens.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so later steps survive a lost executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
