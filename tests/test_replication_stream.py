"""Gap tracking against plain sets, and lag while records come out of order."""

import random

from runlens.streaming import replication as r
from runlens.streaming import timers


def test_seen_numbers_against_a_set():
    rng = random.Random(4)
    for _ in range(300):
        seen, plain = r.Seen(), set()
        for _ in range(rng.randrange(1, 8)):
            new = [rng.randrange(40) for _ in range(rng.randrange(6))]
            seen.add_all(new)
            plain |= set(new)
            seen = r.Seen(seen.starts, seen.ends)
            got = {x for a, b in zip(seen.starts, seen.ends, strict=True) for x in range(a, b + 1)}
            assert got == plain and all(b + 1 < a for b, a in zip(seen.ends, seen.starts[1:], strict=False))
            above = rng.randrange(-1, 45)
            want = [x for x in range(above + 1, max(plain, default=0)) if x not in plain]
            assert seen.missing(above) == (len(want), want[0] if want else None)


def run(spark, tmp_path, journal, marks):
    for name, schema, files in (("j", "store string, seq long, created_ms long", journal), ("m", "store string, at long, replicated_seq long, failed_rounds long", marks)):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    s = [spark.readStream.schema(x).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, x in (("j", "store string, seq long, created_ms long"), ("m", "store string, at long, replicated_seq long, failed_rounds long"))]
    out, checkpoint = timers.run_stateful(r.replication_lag(*s), "lag")
    return sorted(map(tuple, out.collect())), out, checkpoint


def test_lag_follows_marks_and_late_records(spark, tmp_path):
    journal = [[("s", 2, 200), ("s", 9000, 900)], [("s", 1, 100), ("s", 4, 400), ("s", 2, 200)], [("s", 3, 300), ("t", 1, 5)], [("s", 5, 500)]]
    marks = [[("s", 1, 0, 7)], [("t", 1, 3, 0)], [("s", 3, 2, 0)], [("s", 2, 1, 9)]]
    rows, out, checkpoint = run(spark, tmp_path, journal, marks)
    s = [x[1:] for x in rows if x[0] == "s"]
    assert s[0] == (1, 200, 0, 9000, 7, 8998, 1)  # record 1 is missing: 200 may not be the oldest
    assert s[1] == (2, 100, 0, 9000, 7, 8996, 3)
    assert s[2] == (3, 300, 2, 9000, 0, 8995, 5)
    assert s[3] == (4, 300, 2, 9000, 0, 8994, 6)  # the older mark does not count
    assert [x[1:] for x in rows if x[0] == "t"][-1] == (2, None, 3, 1, 0, 0, None)
    newest = {x.store: x for x in r.newest_lag(out, 1300).collect()}
    assert (newest["s"].oldest_age_s, newest["s"].missing, newest["t"].oldest_age_s) == (1.0, 8994, 0.0)
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "above").load()
    assert sorted(x for v in kept.select("user_map_value.seqs").collect() for x in v[0]) == [3, 4, 5, 9000]
