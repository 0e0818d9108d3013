"""Readers of run history, train journals, PR lists, store journals, decision logs and process tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.schema import HISTORY, JOURNAL, PR_LIST, STORE_JOURNAL
from runlens.session import cut_lineage
from runlens.sources.growing import growing_lines, open_store

MARGIN_MS = 86_400_000
BLOCK_BITS = 44
#: Tasks that list the folders of one level, and rows that a task hands over at once.
LIST_TASKS = 64
LIST_ROWS = 10_000


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with `ord`, a number that grows with file name, then position in the file.

    A task numbers its rows in reading order; the first number of each file block is taken off and the block's byte
    offset added, so numbers of different blocks never meet (a line is at least a byte long).
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    blocks = raw.groupBy("src_file", "block").agg(F.min("row").alias("first_row"))
    # one row per file split; Spark broadcasts it when it is small enough
    files = blocks.select("src_file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("src_file")) - 1)
    places = blocks.join(files, "src_file").select("src_file", "block", "first_row", "file_no")
    # 44 bits hold the offsets of a file of 16 TB and leave room for half a million files; beyond, fail rather than mix the order
    fits = (F.col("file_no") < 1 << (63 - BLOCK_BITS)) & (F.col("block") + F.col("row") - F.col("first_row") < 1 << BLOCK_BITS)
    at = F.when(~fits, F.raise_error(F.lit("too many or too large files for one read"))).otherwise(F.shiftleft(F.col("file_no").cast("long"), BLOCK_BITS) + F.col("block") + F.col("row") - F.col("first_row"))
    return raw.join(places, ["src_file", "block"]).select("line", "src_file", at.alias("ord"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """JSON objects only: blank and torn lines, scalars, arrays and `null` are left out."""
    doc = F.try_parse_json("line")
    shaped = lines.filter(F.trim("line") != "").withColumn("v_", doc).filter("v_ IS NOT NULL AND schema_of_variant(v_) LIKE 'OBJECT<%'")
    return shaped.withColumn("row_", F.from_json("line", schema)).drop("v_")


def parse_rows(lines: DataFrame, schema: str = HISTORY) -> DataFrame:
    """Every readable row, diagnostics included."""
    keep = [c for c in lines.columns if c != "line"]
    return _parsed(lines, schema).select("row_.*", *keep)


def parse_history(lines: DataFrame) -> DataFrame:
    """Run rows: a row that names `event`, even as null, is a diagnostic."""
    keep = [c for c in lines.columns if c != "line"]
    runs = _parsed(lines, HISTORY).filter(~F.array_contains(F.json_object_keys("line"), "event"))
    return runs.select("row_.*", *keep)


def read_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_history(read_lines(spark, path))


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_rows(read_lines(spark, path))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The streaming twin of read_lines, without `ord`; `max_files` bounds a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    return reader.text(path).select(F.col("value").alias("line"))


def recent_history(stored: DataFrame, since: float, repo: str | None = None, unit: str = "day") -> DataFrame:
    """Rows started since `since`, or never started, of stored history partitioned by `dt` (the day a row settled).

    Rows that settled more than a day before the window are behind it, whatever the partition unit; rows without any time
    are not. Only partitions from a day before the window are read.
    """
    first_day = F.to_date(F.timestamp_millis(F.lit(int(since - MARGIN_MS))))
    first_day = F.trunc(first_day, "MM") if unit == "month" else first_day
    settled = F.coalesce("endedAt", "startedAt")
    rows = stored.filter(F.col("dt").isNull() | (F.col("dt") >= first_day)).filter(settled.isNull() | (settled >= since - MARGIN_MS))
    rows = rows.filter(F.col("startedAt").isNull() | (F.col("startedAt") >= since))
    return rows.filter(F.col("repo") == repo) if repo else rows


def settled_day(unit: str = "day") -> Column:
    """The day (or the first of the month) a row settled: the partition column of stored history."""
    day = F.to_date(F.timestamp_millis(F.coalesce("endedAt", "startedAt").cast("long")))
    return F.trunc(day, "MM") if unit == "month" else day


def _ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def parse_journal(lines: DataFrame) -> DataFrame:
    """Train-journal events with a readable time; further columns of `lines` stay in front."""
    keep = [c for c in lines.columns if c != "line"]
    packed = lines.select("line", F.struct(*keep).alias("keep_")) if keep else lines
    rows = parse_rows(packed, JOURNAL).withColumn("t_ms", _ms(F.col("at")))
    return rows.filter("event IS NOT NULL AND t_ms >= 0").select(
        *[F.col(f"keep_.`{c}`").alias(c) for c in keep], "t_ms", "event", "pr", "prs", F.col("runId").alias("run_id"), F.col("laneId").alias("lane_id"))


def read_journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Train-journal events with a readable time, in file order."""
    return parse_journal(read_lines(spark, path).select("line", "ord"))


def stream_journal(spark: SparkSession, path: str, **options) -> DataFrame:
    """Journal events of growing files, each once: src_file and line_at say where a row stands."""
    return parse_journal(growing_lines(spark, path, **options).withColumnRenamed("at", "line_at"))


def read_prs(spark: SparkSession, by_repo: dict[str, list[str]], multi_line: bool = True) -> DataFrame:
    """PR lists of several repos, as JSON arrays or (without `multi_line`, splittable) JSON lines; labels are plain strings or
    objects with a name."""
    frames = []
    for repo, paths in by_repo.items():
        raw = spark.read.schema(PR_LIST).option("multiLine", multi_line).json(paths)
        # an object label arrives as its JSON text
        name = F.transform("labels", lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
        frames.append(raw.select(F.lit(repo).alias("repo"), "number", _ms(F.col("mergedAt")).alias("merged_ms"), _ms(F.col("closedAt")).alias("closed_ms"), name.alias("labels")))
    return reduce(DataFrame.unionByName, frames)


def read_store_journal(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Object-store journals by store name; a torn last line is left out."""
    frames = [parse_rows(read_lines(spark, p), STORE_JOURNAL).filter("seq IS NOT NULL").withColumn("store", F.lit(s)) for s, p in paths.items()]
    return reduce(DataFrame.unionByName, frames).select(
        "store", "seq", "kind", "path", F.col("sha256").alias("sha"), F.col("size").alias("size_bytes"), F.col("createdAt").alias("created_ms"))


def _listed(name: str) -> bool:
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _list_task(root: str, top: bool):
    """What lies in folders below `root` (paths relative to it). A folder that went away meanwhile is empty; the root must be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                prefix = f"{folder}/" if folder else ""
                inside = store.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base or "/", allow_not_found=not top))
                inside = [i for i in inside if _listed(i.base_name)]
                for at in range(0, len(inside), LIST_ROWS):
                    part = inside[at : at + LIST_ROWS]
                    is_dir = [i.type == pafs.FileType.Directory for i in part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([prefix + i.base_name for i in part], pa.string()), pa.array(is_dir, pa.bool_()),
                        pa.array([None if d else i.size for i, d in zip(part, is_dir, strict=True)], pa.int64()),
                        pa.array([None if d or i.mtime_ns is None else i.mtime_ns // 1_000_000 for i, d in zip(part, is_dir, strict=True)], pa.int64())],
                        names=["path", "folder", "size_bytes", "mtime_ms"])

    return run


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of the objects below `root`, with kind, sha and job; other files are left out.

    Tasks list the folders, one level in a round, and write what they find: neither the driver nor one task sees all files. No file is opened. Names that
    begin with `_` or `.` are no objects and are not followed, as in Spark's own listings. `root` is on a store that pyarrow opens.
    """
    from runlens.plans.inventory import canonical_objects

    open_folders, found = spark.createDataFrame([("",)], "path string"), []
    while found == [] or not open_folders.isEmpty():
        level = open_folders.repartition(LIST_TASKS) if found else open_folders
        level = cut_lineage(level.mapInArrow(_list_task(root, not found), "path string, folder boolean, size_bytes long, mtime_ms long"), "listing")
        open_folders = level.filter("folder").select("path")
        found.append(level.filter("NOT folder").drop("folder"))
    return canonical_objects(reduce(DataFrame.unionByName, found))


def read_queue_snapshot(spark: SparkSession, root: str, tables: list[str]) -> dict[str, DataFrame]:
    """Queue tables exported as parquet, partitioned by `snapshot_ts`."""
    return {t: spark.read.parquet(f"{root}/{t}") for t in tables}


def parse_decisions(lines: DataFrame) -> DataFrame:
    """Decision-log lines: time, candidate, both verdicts with their reasons, and all fields as a map."""
    keep = [c for c in lines.columns if c != "line"]
    stamp = F.split_part("line", F.lit(" "), F.lit(1))
    body = F.regexp_extract("line", r"^\S+ \S+ (.*)$", 1)
    d = lines.filter(F.split_part("line", F.lit(" "), F.lit(2)).endswith("admission")).select(
        *keep, _ms(stamp).alias("t_ms"), F.str_to_map(body, F.lit(" "), F.lit("=")).alias("fields")).filter("t_ms IS NOT NULL")

    def half(name: str, i: int) -> Column:
        return F.split_part(F.try_element_at("fields", F.lit(name)), F.lit(":"), F.lit(i))

    return d.select(
        *keep, "t_ms", F.try_element_at("fields", F.lit("candidate")).alias("candidate"), (half("current", 1) == "admit").alias("current_admit"), half("current", 2).alias("current_reason"),
        (half("new", 1) == "admit").alias("admit"), half("new", 2).alias("reason"), "fields")


def read_decision_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decision-log lines of files, with `ord` in file order."""
    return parse_decisions(read_lines(spark, path).select("line", "ord"))


def stream_decision_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decision-log lines of growing files, each once, with src_file and line_at."""
    return parse_decisions(growing_lines(spark, path, **options).withColumnRenamed("at", "line_at"))


def parse_process_table(lines: DataFrame) -> DataFrame:
    """`pid ppid pgid pcpu rss` lines; a line without five numbers is dropped."""
    keep = [c for c in lines.columns if c != "line"]
    parts = F.split(F.trim("line"), r"\s+")
    names = [("pid", "long"), ("ppid", "long"), ("pgid", "long"), ("pcpu", "double"), ("rss_kib", "double")]
    rows = lines.withColumn("f_", parts).filter(F.size("f_") == 5).select(*keep, *[F.get("f_", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)])
    return rows.dropna(subset=[n for n, _ in names])
