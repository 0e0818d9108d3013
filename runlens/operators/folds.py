"""Ordered folds over history, split in time.

An EWMA that clips each observation against its current state has no associative merge, yet each observation maps the
state through a non-decreasing piecewise-linear function, and such functions compose. A key's observations are cut into
time slices. Pass 1 composes each slice's function from its own rows (it soon becomes a constant, because every step
contracts), pass 2 walks the few slice functions of a key to get the state entering each slice, pass 3 replays the
slices from those known states. Keys of ordinary size are folded in one piece; only keys over `hot_rows` are cut, and
their number is at most the row count over `hot_rows`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import cut_lineage

# Fixed values of the estimator.
ALPHA = 0.1
RATIO_MIN = 0.2
RATIO_MAX = 5.0
INITIAL_VARIANCE = 0.36
FLAT = 1e-13


class LogStep:
    """State ln(ref-seconds); the observation is ln(ref-seconds)."""

    low, high = math.log(RATIO_MIN), math.log(RATIO_MAX)

    @classmethod
    def breaks(cls, v: float) -> tuple[float, float]:
        return v - cls.high, v - cls.low

    @classmethod
    def step(cls, y, v):
        return y + ALPHA * np.clip(v - y, cls.low, cls.high)

    @classmethod
    def scalar(cls, y: float, v: float) -> float:
        return y + ALPHA * min(max(v - y, cls.low), cls.high)

    @staticmethod
    def first(v: float, censored: bool) -> float:
        return v


class FactorStep:
    """State speed factor; the observation is wall seconds over reference seconds. An empty cell reads as 1."""

    @staticmethod
    def breaks(v: float) -> tuple[float, float]:
        return v / RATIO_MAX, v / RATIO_MIN

    @staticmethod
    def step(y, v):
        return y + ALPHA * (np.clip(v, y * RATIO_MIN, y * RATIO_MAX) - y)

    @staticmethod
    def scalar(y: float, v: float) -> float:
        return y + ALPHA * (min(max(v, y * RATIO_MIN), y * RATIO_MAX) - y)

    @staticmethod
    def first(v: float, censored: bool) -> float:
        return max(1.0, v) if censored else v


class StateMap:
    """A slice's effect on the state: nodes (xs, ys) of a non-decreasing piecewise-linear function."""

    def __init__(self, lo: float, hi: float):
        self.xs = np.array([lo, hi]) if hi > lo else np.array([lo])
        self.ys = self.xs.copy()

    def _split(self, at: float) -> None:
        ys = self.ys
        if not ys[0] < at < ys[-1]:
            return
        j = int(np.searchsorted(ys, at))
        if ys[j] == at:
            return
        x0, x1, y0, y1 = self.xs[j - 1], self.xs[j], ys[j - 1], ys[j]
        self.xs = np.insert(self.xs, j, x0 + (x1 - x0) * (at - y0) / (y1 - y0))
        self.ys = np.insert(ys, j, at)

    def apply(self, kind, v: float, censored: bool) -> None:
        if len(self.ys) > 1:
            for at in (v,) if censored else kind.breaks(v):
                self._split(at)
        self.ys = np.maximum(self.ys, v) if censored else kind.step(self.ys, v)
        if len(self.ys) > 1:
            if self.ys[-1] - self.ys[0] < FLAT:
                self.xs, self.ys = self.xs[:1], np.array([(self.ys[0] + self.ys[-1]) / 2])
            elif len(self.ys) > 64:
                keep = np.concatenate(([True], np.diff(self.ys[:-1]) > FLAT, [True]))
                self.xs, self.ys = self.xs[keep], self.ys[keep]


def _rows(pdf: pd.DataFrame, *cols: str):
    return zip(*[pdf[c].tolist() for c in cols])


def _slice_maps(kind):
    cols = ["k", "slice", "xs", "ys", "from_empty"]

    def run(batches: Iterator[pd.DataFrame]):
        current, state, empty = None, None, None
        for pdf in batches:
            out = []
            for k, s, v, c, lo, hi in _rows(pdf, "k", "slice", "v", "censored", "lo", "hi"):
                if (k, s) != current:
                    if current is not None:
                        out.append((*current, state.xs, state.ys, empty))
                    current, state, empty = (k, s), StateMap(lo, hi), None
                state.apply(kind, v, c)
                empty = kind.first(v, c) if empty is None else max(empty, v) if c else kind.scalar(empty, v)
            yield pd.DataFrame(out, columns=cols)
        if current is not None:
            yield pd.DataFrame([(*current, state.xs, state.ys, empty)], columns=cols)

    return run


def _entries(batches):
    """State entering each slice, walking a key's slices in order; NULL for its first."""
    key, state = None, None
    for pdf in batches:
        out = []
        for k, s, xs, ys, empty in zip(pdf["k"], pdf["slice"], pdf["xs"], pdf["ys"], pdf["from_empty"]):
            if k != key:
                key, state = k, None
            out.append((k, s, state))
            state = empty if state is None else float(np.interp(state, xs, ys))
        yield pd.DataFrame(out, columns=["k", "slice", "entry"]).astype({"entry": "float64"})


def _replay(kind):
    cols = ["k", "slice", "n", "censored_n", "state", "keep", "add"]

    def run(batches: Iterator[pd.DataFrame]):
        current, state, n, cn, keep, add = None, None, 0, 0, 1.0, 0.0
        for pdf in batches:
            out = []
            for k, s, v, c, entry in _rows(pdf, "k", "slice", "v", "censored", "entry"):
                if (k, s) != current:
                    if current is not None:
                        out.append((*current, n, cn, state, keep, add))
                    current, n, cn, keep, add = (k, s), 0, 0, 1.0, 0.0
                    state = None if math.isnan(entry) else entry
                n += 1
                cn += c
                if state is None:
                    state = kind.first(v, c)
                elif c:
                    state = max(state, v)
                else:
                    nxt = kind.scalar(state, v)
                    delta = (nxt - state) / ALPHA
                    keep *= 1 - ALPHA
                    add = (1 - ALPHA) * (add + ALPHA * delta * delta)
                    state = nxt
            yield pd.DataFrame(out, columns=cols)
        if current is not None:
            yield pd.DataFrame([(*current, n, cn, state, keep, add)], columns=cols)

    return run


def sliced_fold(
    obs: DataFrame, keys: list[str], value: Column, censored: Column, time: Column, ord_col: str, kind,
    slice_ms: float = 86_400_000.0, hot_rows: int = 2_000_000,
) -> DataFrame:
    """Folded state per key: `n`, `censored_n`, `state`, `variance` (of LogStep deltas)."""
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = obs.select(packed.alias("k"), time.cast("double").alias("t"), F.col(ord_col).alias("o"), value.cast("double").alias("v"),
                      censored.alias("censored")).filter(F.col("v").isNotNull())
    # at most (rows / hot_rows) keys, so the broadcast is bounded; written once, as the branches below all read it
    hot = cut_lineage(rows.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") > hot_rows).select("k"), "hot-keys")
    any_hot = not hot.isEmpty()
    order = ["k", "slice", "t", "o"]
    out = "k string, slice long, n long, censored_n long, state double, keep double, add double"
    cold = (rows.join(F.broadcast(hot), "k", "left_anti") if any_hot else rows).withColumns({"slice": F.lit(0).cast("long"), "entry": F.lit(float("nan"))})
    cold = cold.repartition("k").sortWithinPartitions(*order).mapInPandas(_replay(kind), out)

    replay = cold
    if any_hot:
        cut = rows.join(F.broadcast(hot), "k", "left_semi").withColumn("slice", F.floor(F.col("t") / slice_ms).cast("long"))
        one = F.lit(1.0 if kind is FactorStep else None).cast("double")
        bounds = cut.agg(F.least(F.min("v"), one).alias("lo"), F.greatest(F.max("v"), one).alias("hi"))
        # `bounds` is a one-row aggregate
        maps = cut.crossJoin(F.broadcast(bounds)).repartition("k", "slice").sortWithinPartitions(*order).mapInPandas(
            _slice_maps(kind), "k string, slice long, xs array<double>, ys array<double>, from_empty double")
        entries = maps.repartition("k").sortWithinPartitions("k", "slice").mapInPandas(_entries, "k string, slice long, entry double")
        entries = entries.select("k", "slice", F.coalesce("entry", F.lit(float("nan"))).alias("entry"))
        # a size estimated from the compressed input says nothing about the rows of the hot keys: neither side may be broadcast
        again = cut.join(entries.hint("merge"), ["k", "slice"]).repartition("k", "slice").sortWithinPartitions(*order)
        replay = replay.unionByName(again.mapInPandas(_replay(kind), out))
    # the variance of a key is a short chain over its slices: v <- keep * v + add
    chain = F.aggregate(
        F.array_sort(F.collect_list(F.struct("slice", "keep", "add"))), F.lit(INITIAL_VARIANCE),
        lambda acc, s: acc * s["keep"] + s["add"])
    folded = replay.groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("censored_n").alias("censored_n"), F.max_by("state", "slice").alias("state"), chain.alias("variance"))
    types = ", ".join(f"{c} {obs.schema[c].dataType.simpleString()}" for c in keys)
    return folded.withColumn("k", F.from_json("k", types)).select(*[F.col(f"k.{c}").alias(c) for c in keys], "n", "censored_n", "state", "variance")
