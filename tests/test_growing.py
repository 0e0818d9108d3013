"""Growing files: lines cut into byte ranges, and streams over files that are appended to, replaced and removed."""

import random

import pytest

from runlens.sources import growing, history
from runlens.streaming.jobs import append_available


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_ranges_yield_each_line_once(tmp_path, monkeypatch, block):
    monkeypatch.setattr(growing, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        lines = [bytes(rng.choices(b"ab\r", k=rng.choice([0, 0, 1, 2, 5, 40]))) for _ in range(rng.randrange(8))]
        data = b"".join(x + b"\n" for x in lines)
        torn = bytes(rng.choices(b"xy", k=rng.randrange(4)))
        path = tmp_path / "f"
        path.write_bytes(data + torn)
        store, p = growing.open_store(str(path))
        assert growing.last_line_end(store, p, len(data + torn), 0) == len(data)
        for size in (1, 2, 5, 1000):
            got = [x for low in range(0, len(data), size) for x in growing.lines_between(store, p, low, min(len(data), low + size), len(data), low == 0)]
            assert [x for _, x in got] == lines
            assert all(data[at : at + len(x) + 1] == x + b"\n" for at, x in got)


def test_a_file_cut_behind_our_back_fails_the_batch(tmp_path):
    (tmp_path / "f").write_bytes(b"abc\n")
    store, p = growing.open_store(str(tmp_path / "f"))
    with pytest.raises(OSError):
        list(growing.lines_between(store, p, 0, 8, 8, True))


class Stream:
    """A query that is run again and again over a folder."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.root, self.options = spark, tmp_path, options
        self.files = tmp_path / "in"
        self.files.mkdir()

    def run(self):
        append_available(growing.growing_lines(self.spark, str(self.files), **self.options), str(self.root / "out"), str(self.root / "checkpoint"))
        return sorted((r.src_file.rsplit("/", 1)[1], r.at, r.line) for r in self.spark.read.schema("line string, src_file string, at long").parquet(str(self.root / "out")).collect())


def test_appended_lines_come_once_and_torn_ones_when_complete(spark, tmp_path):
    s = Stream(spark, tmp_path, split_bytes=5)
    log = s.files / "a.log"
    log.write_bytes(b"one\ntw")
    assert s.run() == [("a.log", 0, "one")]
    with log.open("ab") as f:
        f.write("o\r\n\ndrei é".encode())
    (s.files / "b.log").write_bytes(b"never ended")
    assert s.run() == [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 9, "")]
    assert len(s.run()) == 3  # nothing new
    with log.open("ab") as f:
        f.write(b"\n" + b"x" * 40 + b"\n")
    (s.files / "sub").mkdir()
    (s.files / "sub" / "c.log").write_bytes(b"deep\n")
    (s.files / "_hidden").write_bytes(b"no\n")
    assert s.run()[3:] == [("a.log", 10, "drei é"), ("a.log", 18, "x" * 40), ("c.log", 0, "deep")]


def test_replaced_and_removed_files(spark, tmp_path):
    s = Stream(spark, tmp_path, glob="*.log")
    a, b = s.files / "a.log", s.files / "b.log"
    a.write_bytes(b"first file, long\n")
    b.write_bytes(b"b\n")
    (s.files / "a.txt").write_bytes(b"another name\n")
    assert len(s.run()) == 2
    a.write_bytes(b"new\n")
    b.unlink()
    assert s.run() == [("a.log", 0, "first file, long"), ("a.log", 0, "new"), ("b.log", 0, "b")]
    b.write_bytes(b"again\n")
    assert ("b.log", 0, "again") in s.run()


def test_streamed_journal_equals_the_batch_reader(spark, tmp_path):
    rows = [f'{{"at":"2024-01-0{1 + i % 9}T00:00:00.000Z","event":"landed","pr":{i},"runId":"r{i}"}}' for i in range(50)]
    rows[7], rows[11], rows[13] = "", '{"at":"2024-01-01T0', '{"at":"never","event":"x"}'
    data = "".join(x + "\n" for x in rows).encode()
    folder = tmp_path / "journal"
    folder.mkdir()
    for size in (len(data) // 3, len(data) // 2, len(data)):
        (folder / "journal.jsonl").write_bytes(data[:size])
        append_available(history.stream_journal(spark, str(folder), split_bytes=100), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    cols = ["t_ms", "event", "pr", "run_id"]
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = history.read_journal(spark, str(folder))
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert [r.pr for r in got.orderBy("line_at").collect()] == [r.pr for r in batch.orderBy("ord").collect()]
