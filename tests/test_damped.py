"""The damped signal: run tables against the walk, slices of any width, and one long group cut over many tasks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.operators import damped as d


def walk(cycles, state=d.START, level=0.0):
    out = []
    for raw, slack, s0 in cycles:
        state = d.switch(state, slack, s0)
        level = d.follow(level, raw if state[0] else 0.0)
        out.append((level, state[0]))
    return out, state, level


def cycles(n, r):
    slack = 0.0
    out = []
    for _ in range(n):
        slack = r.choice([slack, r.uniform(-500, 3000), 900.0, 1125.0, 1200.0])
        out.append((r.choice([0.0, 150.0, r.uniform(0, 150)]), slack, 900.0))
    return out


def test_dwell_and_hysteresis():
    on = (150.0, 0.0, 900.0)
    off = (0.0, 2000.0, 900.0)
    between = (150.0, 1000.0, 900.0)
    got, _, _ = walk([off, on, off, off, off, between, on, between, off])
    assert [x for _, x in got] == [False, True, True, True, False, False, False, False, False]
    # the first switch is free, the next one three cycles later; switching on again has to wait as long
    assert [x for x, _ in got][:5] == [0.0, 25.0, 0.0, 0.0, 0.0]
    assert [x for _, x in walk([on, between, between, between])[0]] == [True] * 4


@pytest.mark.parametrize("seed", range(6))
def test_a_table_does_what_the_walk_does(seed):
    r = random.Random(seed)
    for n in (1, 2, 3, 10, 200):
        run = cycles(n, r)
        table = d.RunTable()
        for c in run:
            table.step(*c)
        for (entry, on, left, xs, ys), state in zip(table.rows(), d.STATES, strict=True):
            assert d.STATES[entry] == state
            for level in (0.0, 150.0, r.uniform(0, 150), 25.0, 75.0):
                _, end, value = walk(run, state, level)
                assert (on, left) == end and d.LevelMap(xs, ys)(level) == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("width", [1, 3, 50, 10_000])
def test_any_slice_width_gives_the_walk(spark, width):
    r = random.Random(width)
    groups = {g: [(k * r.choice([1, 1, 5]), *c) for k, c in enumerate(cycles(90, r))] for g in "ab"}
    groups = {g: [(j, *c[1:]) for j, c in zip(sorted(r.sample(range(400), len(rows))), rows, strict=True)] for g, rows in groups.items()}
    rows = [(g, j, 75.0 if k == 0 else 1.0, raw, slack, s0) for g, own in groups.items() for k, (j, raw, slack, s0) in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, cycle long, start double, raw double, slack double, s0 double").repartition(4)
    got = {(x.g, x.cycle): (x.level, x.on) for x in d.damped(df, width).collect()}
    for g, own in groups.items():
        want, _, _ = walk([c[1:] for c in own], level=75.0)
        for (j, *_), (level, on) in zip(own, want, strict=True):
            assert got[g, j][1] == on and got[g, j][0] == pytest.approx(level, abs=1e-9)


def test_one_group_of_many_cycles_is_cut_over_tasks(spark):
    n, width = 200_000, 10_000
    k = F.col("id")
    df = spark.range(0, n, 1, 4).select(F.lit(1).alias("g"), k.alias("cycle"), F.lit(0.0).alias("start"), (F.pmod(k * 7919, F.lit(1501)) / 10.0).alias("raw"), (F.pmod(k * k * 31 + k * 17, F.lit(2500)) - 300.0).alias("slack"), F.lit(900.0).alias("s0"))
    got = d.damped(df, width)
    assert got.count() == n
    rows = [(x.level, x.on) for x in got.orderBy("cycle").select("level", "on").collect()]
    cells = [((i * 7919 % 1501) / 10.0, (i * i * 31 + i * 17) % 2500 - 300.0, 900.0) for i in range(n)]
    want, _, _ = walk(cells)
    assert [on for _, on in rows] == [on for _, on in want]
    assert max(abs(a - b) for (a, _), (b, _) in zip(rows, want, strict=True)) < 1e-6
    assert "MapInPandas" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows", [1, 7, 30, 1_000])
def test_narrow_slices_are_put_together(spark, rows):
    r = random.Random(rows)
    groups = {g: [(j, *c) for j, c in zip(sorted(r.sample(range(10**6), 90)), cycles(90, r), strict=True)] for g in "ab"}
    df = spark.createDataFrame([(g, j, 75.0, *c) for g, own in groups.items() for j, *c in own], "g string, cycle long, start double, raw double, slack double, s0 double").repartition(4)
    got = {(x.g, x.cycle): (x.level, x.on) for x in d.damped(df, 10, slice_rows=rows).collect()}
    for g, own in groups.items():
        want, _, _ = walk([c[1:] for c in own], level=75.0)
        for (j, *_), (level, on) in zip(own, want, strict=True):
            assert got[g, j][1] == on and got[g, j][0] == pytest.approx(level, abs=1e-9)


def test_the_tables_of_a_batch_come_together():
    pdf = pd.DataFrame([("a", i, 0.0, 150.0, 0.0, 900.0) for i in range(50)], columns=["g", "slice", "start", *d.COLUMNS])
    made = list(d._tables(iter([pdf])))
    assert len(made) <= 2 and sum(len(x) for x in made) == 50 * len(d.STATES)
