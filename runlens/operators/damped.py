"""A damped on/off signal per group, split in time.

Each cycle says where the signal wants to be; it switches with hysteresis, stays at least `DWELL` cycles after a switch, and the level
follows the wanted value by at most `SLEW` a cycle. Between two cycles only six switch states can stand: on or off, with no, one or two cycles
of dwell left. What a run of cycles does is therefore kept as a small table: for each of the six, the state it ends in and a piecewise-linear map
of the level. Tables of consecutive runs compose, so the cycles of one group are cut over tasks: pass 1 makes the table of each slice but
the last of its group, pass 2 walks the few tables of a group, pass 3 replays each slice from the state that enters it. Narrow slices
that hold few rows are put together first, so a group has no more tables than its rows call for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DWELL = 3
SLEW = 25.0
OFF_FACTOR = 1.25
LEVELS = (0.0, 150.0)

STATES = [(on, left) for on in (False, True) for left in range(DWELL)]
START = (False, 0)


def switch(state: tuple[bool, int], slack: float, s0: float) -> tuple[bool, int]:
    """The switch state after a cycle: (on, cycles of dwell left)."""
    on, left = state
    want = on if left else (not slack > OFF_FACTOR * s0 if on else slack < s0)
    return (want, DWELL - 1) if want != on else (on, max(0, left - 1))


def follow(level: float, target: float) -> float:
    return level + min(SLEW, max(-SLEW, target - level))


class LevelMap:
    """Where a level in LEVELS is after a run of cycles: nodes of a non-decreasing piecewise-linear function."""

    def __init__(self, xs=LEVELS, ys=LEVELS):
        self.xs, self.ys = np.array(xs, float), np.array(ys, float)

    def _split(self, at: float) -> None:
        if self.ys[0] < at < self.ys[-1]:
            j = int(np.searchsorted(self.ys, at))
            if self.ys[j] != at:
                u = (at - self.ys[j - 1]) / (self.ys[j] - self.ys[j - 1])
                self.xs = np.insert(self.xs, j, self.xs[j - 1] + (self.xs[j] - self.xs[j - 1]) * u)
                self.ys = np.insert(self.ys, j, at)

    def step(self, target: float) -> None:
        target = -np.inf if target != target else target  # as `follow` takes an unknown target
        self._split(target - SLEW)
        self._split(target + SLEW)
        self.ys = self.ys + np.clip(target - self.ys, -SLEW, SLEW)
        if len(self.ys) > 2:  # inner nodes on a flat part say nothing
            flat = np.diff(self.ys) == 0
            keep = np.ones(len(self.ys), bool)
            keep[1:-1] = ~(flat[:-1] & flat[1:])
            self.xs, self.ys = self.xs[keep], self.ys[keep]

    def __call__(self, level):
        return np.interp(level, self.xs, self.ys)

    def then(self, later: LevelMap) -> LevelMap:
        """This map, then `later`."""
        out = LevelMap(self.xs, self.ys)
        for at in later.xs:
            out._split(float(at))
        out.ys = later(out.ys)
        return out


class RunTable:
    """The table of a run: entries that have come to the same switch state share what follows."""

    def __init__(self):
        self.now = list(STATES)  # switch state of each entry
        self.maps = [LevelMap() for _ in STATES]  # each entry's own part
        self.shared: dict[tuple[bool, int], LevelMap] = {s: LevelMap() for s in STATES}

    def step(self, raw: float, slack: float, s0: float) -> None:
        after = {s: switch(s, slack, s0) for s in self.shared}
        for s, m in self.shared.items():
            m.step(raw if after[s][0] else 0.0)
        if len(set(after.values())) < len(after):  # some meet: what was shared so far becomes their own
            self.maps = [m.then(self.shared[s]) for m, s in zip(self.maps, self.now, strict=True)]
            self.shared = {s: LevelMap() for s in after.values()}
        else:
            self.shared = {after[s]: m for s, m in self.shared.items()}
        self.now = [after[s] for s in self.now]

    def rows(self) -> list[tuple]:
        """(entry, ends on, dwell left, xs, ys) of each entry."""
        out = []
        for i, (m, s) in enumerate(zip(self.maps, self.now, strict=True)):
            whole = m.then(self.shared[s])
            out.append((i, *s, whole.xs.tolist(), whole.ys.tolist()))
        return out


COLUMNS = ["raw", "slack", "s0"]


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, table, first, out = None, None, None, []

    def handed() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["g", "slice", "start", "entry", "on_", "left_", "xs", "ys"])

    for pdf in batches:
        for g, s, start, *cycle in zip(*[pdf[c].tolist() for c in ("g", "slice", "start", *COLUMNS)], strict=True):
            if (g, s) != current:
                if current is not None:
                    out += [(*current, first, *r) for r in table.rows()]
                current, table, first = (g, s), RunTable(), start
            table.step(*cycle)
        if out:
            yield handed()
            out = []
    if current is not None:
        out += [(*current, first, *r) for r in table.rows()]
        yield handed()


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state that enters each slice after a group's first; a group's slices come in order, the six rows of one together."""
    group, state, level, current = None, START, 0.0, None
    for pdf in batches:
        out = []
        for g, s, start, entry, on, left, xs, ys in zip(*[pdf[c].tolist() for c in ("g", "slice", "start", "entry", "on_", "left_", "xs", "ys")], strict=True):
            if g != group:
                group, state, level, current = g, START, start, None
            if s != current:
                current, before = s, state
            if STATES[entry] == before:
                state, level = (bool(on), int(left)), float(np.interp(level, xs, ys))
                out.append((g, s, *state, level))
        yield pd.DataFrame(out, columns=["g", "slice", "on_", "left_", "level_"])


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state, level = None, START, 0.0
    for pdf in batches:
        out = []
        for g, s, c, start, on, left, entry, *cycle in zip(*[pdf[x].tolist() for x in ("g", "slice", "cycle", "start", "on_", "left_", "level_", *COLUMNS)], strict=True):
            if (g, s) != current:
                current = (g, s)
                known = entry == entry and entry is not None
                state, level = ((bool(on), int(left)), entry) if known else (START, start)
            state = switch(state, *cycle[1:])
            level = follow(level, cycle[0] if state[0] else 0.0)
            out.append((g, c, level, state[0]))
        yield pd.DataFrame(out, columns=["g", "cycle", "level", "on"])


def damped(cycles: DataFrame, slice_cycles: int = 100_000, slice_rows: int = 1_000) -> DataFrame:
    """Level and switch after each cycle: g, cycle, level, on.

    cycles: g, cycle (a number that grows with time), start (the level before the group's first cycle), raw, slack, s0. A slice is
    `slice_cycles` numbers wide, or as many such widths as it takes to hold `slice_rows` rows; results don't depend on either.
    """
    kind = cycles.schema["g"].dataType.simpleString()
    rows = cycles.select("g", "cycle", F.floor(F.col("cycle") / slice_cycles).cast("long").alias("width_"), "start", *COLUMNS)
    # widths whose rows before them fill the same number of slices go together; a group has at most rows / slice_rows + 1 slices
    group = Window.partitionBy("g")
    earlier = group.orderBy("width_").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.floor(F.coalesce(F.sum("rows_").over(earlier), F.lit(0)) / slice_rows).cast("long")
    cuts = rows.groupBy("g", "width_").agg(F.count("*").alias("rows_")).withColumn("slice", filled).withColumn("last_", F.max("slice").over(group)).drop("rows_")
    rows = rows.join(cuts, ["g", "width_"], "left").select("g", "cycle", F.coalesce("slice", "width_").alias("slice"), "last_", "start", *COLUMNS)
    inner = rows.filter("slice < last_").drop("last_")  # what the last slice does is not needed
    rows = rows.drop("last_")
    tables = inner.repartition("g", "slice").sortWithinPartitions("g", "slice", "cycle").mapInPandas(
        _tables, f"g {kind}, slice long, start double, entry int, on_ boolean, left_ int, xs array<double>, ys array<double>")
    left = tables.repartition("g").sortWithinPartitions("g", "slice", "entry").mapInPandas(_entries, f"g {kind}, slice long, on_ boolean, left_ int, level_ double")
    # what leaves a slice enters the group's next one, which need not be the next number; a group has few slices
    slices = cuts.select("g", "slice").distinct().withColumn("from_", F.lag("slice").over(group.orderBy("slice")))
    after = slices.join(left.withColumnRenamed("slice", "from_"), ["g", "from_"]).select("g", "slice", F.struct("on_", "left_", "level_").alias("e"))
    entered = rows.join(after, ["g", "slice"], "left").select(*rows.columns, "e.*")
    return entered.repartition("g", "slice").sortWithinPartitions("g", "slice", "cycle").mapInPandas(_replay, f"g {kind}, cycle long, level double, on boolean")
