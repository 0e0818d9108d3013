"""Streaming reader of text files that grow: journals and logs that a writer appends to.

Spark's own text stream takes a file once and never looks at it again. This source keeps a byte offset per file in the query's
checkpoint and reads on from there. A last line without its line end is held back until the writer completes it. New files
are read from their start; a file that has become shorter than its offset was replaced and is read anew; a file that is gone is
forgotten. (A file replaced by one at least as long can't be told from one that grew.)

What is new in a micro-batch is cut into ranges of `splitBytes`; a range yields the lines that start in it, so one huge file is read
by many tasks. Only the driver looks for the last line end, at the tail of files whose size changed.

Options: `path` (a folder, read with its subfolders, or one file; any URI that pyarrow.fs opens), `pathGlobFilter`, `splitBytes`. Files whose
names begin with `_` or `.` are left out. Rows: line (without its line end), src_file, at (the byte at which the line starts).
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
BATCH_ROWS = 4096


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain local path, and the path on it."""
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def last_line_end(store: pafs.FileSystem, path: str, size: int, known: int) -> int:
    """The byte after the last line end between `known` and `size`; `known` if there is none."""
    with store.open_input_file(path) as f:
        high = size
        while high > known:
            low = max(known, high - BLOCK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return known


def lines_between(store: pafs.FileSystem, path: str, low: int, high: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(start, line) of the lines that start in [low, high); they end at `end` at the latest. `first`: a line starts at `low`."""
    with store.open_input_file(path) as f:
        at = low if first else low - 1  # a line starts at `low` too if the byte before ends one
        f.seek(at)
        skip, rest = not first, b""
        while True:
            here = at + len(rest)
            if not rest and not skip and at >= high:
                return
            block = f.read(min(BLOCK, end - here))
            if not block:
                raise OSError(f"{path} ends at byte {here}, before the {end} bytes seen earlier")
            data = rest + block
            pos = 0
            while (nl := data.find(b"\n", max(pos, len(rest)))) >= 0:
                if skip:
                    skip = False
                elif at + pos >= high:
                    return
                else:
                    yield at + pos, data[pos:nl]
                pos = nl + 1
                if pos > len(rest):
                    rest = b""
            at, rest = at + pos, data[pos:]
            if at >= end or (at >= high and not skip):
                return


class FileRange(InputPartition):
    def __init__(self, path: str, low: int, high: int, end: int, first: bool):
        self.path, self.low, self.high, self.end, self.first = path, low, high, end, first


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"]
        self.glob = options.get("pathGlobFilter", "*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.seen: dict[str, tuple[int, int]] = {}  # size and offset at the last look, to leave quiet files unopened

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def files(self) -> tuple[pafs.FileSystem, dict[str, int]]:
        store, root = open_store(self.root)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.File:
            return store, {root: info.size}
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        below = len(root.rstrip("/")) + 1
        hidden = lambda p: any(x[:1] in ("_", ".") for x in p[below:].split("/"))
        return store, {f.path: f.size for f in found if f.type == pafs.FileType.File and not hidden(f.path) and fnmatch.fnmatch(posixpath.basename(f.path), self.glob)}

    def latestOffset(self) -> dict:
        store, sizes = self.files()
        now = {}
        for path, size in sorted(sizes.items()):
            before, offset = self.seen.get(path, (0, 0))
            if size < offset:
                before, offset = 0, 0
            now[path] = (size, offset if size == before else last_line_end(store, path, size, offset))
        self.seen = now
        return {"files": json.dumps({p: o for p, (_, o) in now.items() if o})}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        old, new, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, to in new.items():
            since = old.get(path, 0)
            since = since if since <= to else 0  # shorter than before: another file
            out += [FileRange(path, low, min(to, low + self.split), to, low == since) for low in range(since, to, self.split)]
        return out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.root)
        starts, lines = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([partition.path] * len(lines), pa.string()), pa.array(starts, pa.int64())], names=["line", "src_file", "at"])

        held = 0
        for at, raw in lines_between(store, partition.path, partition.low, partition.high, partition.end, partition.first):
            starts.append(at)
            lines.append(raw.removesuffix(b"\r").decode("utf-8", "replace"))
            held += len(raw)
            if len(lines) >= BATCH_ROWS or held >= 8 * BLOCK:
                yield batch()
                starts, lines, held = [], [], 0
        if lines:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing to release: offsets live in the query's checkpoint."""


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "line string, src_file string, at long"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, path: str, glob: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The stream of complete lines below `path`: line, src_file, at."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(GrowingLines.name()).option("splitBytes", split_bytes)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
