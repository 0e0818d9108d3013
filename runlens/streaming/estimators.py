"""The duration estimator over a stream whose rows come in any order.

The estimator is an ordered fold: each observation moves the state by a clipped step, and the variance follows the steps. A
key's observations are cut into time slices. What a slice does to any state that enters it is kept as a summary: the state that leaves is
piecewise linear in the one that enters, and what the slice adds to the variance is a quadratic on each of the same pieces. Summaries
compose by evaluation, so a late row changes the summary of its own slice, and the slices after it are only evaluated, not folded again.

Per key the state store holds one entry per slice. A slice keeps its rows as long as late ones may come (`open_slices`), then its summary only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from runlens.operators.folds import ALPHA, INITIAL_VARIANCE, LogStep
from runlens.plans import estimates

#: ln(seconds) the estimator is made for: a microsecond to forty years.
DOMAIN = (-14.0, 21.0)


class SliceSummary:
    """A slice's effect: nodes (xs, ys) of the state map, and per piece the added variance as a quadratic in the place within the piece."""

    def __init__(self, kind, domain: tuple[float, float] = DOMAIN):
        self.kind = kind
        self.xs, self.ys = np.array(domain), np.array(domain)
        self.poly = np.zeros((1, 3))
        self.keep, self.n, self.censored_n = 1.0, 0, 0
        # what the slice makes of no state at all: its own first observation starts one
        self.alone, self.alone_keep, self.alone_add = float("nan"), 1.0, 0.0

    def add_all(self, rows: list[tuple[float, bool]]) -> None:
        """The observations in order. Once every state that may enter leaves as the same one, the rest is a plain fold of that state, and all pieces of the
        variance fade and rise alike.
        """
        for i, (v, censored) in enumerate(rows):
            if self.ys[0] == self.ys[-1]:
                break
            self.add(v, censored)
        else:
            return
        y, fade, rise, alone = float(self.ys[0]), 1.0, 0.0, self.alone
        add = self.alone_add
        scalar, same = self.kind.scalar, self.alone == y
        alone_fade, left = 1.0, rows[i:]
        for v, censored in left:
            if censored:
                y = max(y, v)
                alone = y if same else max(alone, v)
            else:
                new = scalar(y, v)
                d = (new - y) / ALPHA
                step = ALPHA * d * d
                y, fade, rise = new, fade * (1 - ALPHA), (1 - ALPHA) * (rise + step)
                if same:
                    alone = y
                else:
                    new = scalar(alone, v)
                    d = (new - alone) / ALPHA
                    alone, step = new, ALPHA * d * d
                    same = alone == y
                add = (1 - ALPHA) * (add + step)
                alone_fade *= 1 - ALPHA
        self.n += len(left)
        self.censored_n += sum(c for _, c in left)
        self.ys = np.full(len(self.ys), y)
        self.poly = self.poly * fade
        self.poly[:, 0] += rise
        self.keep *= fade
        self.alone, self.alone_keep, self.alone_add = alone, self.alone_keep * alone_fade, add

    def _split(self, at: float) -> None:
        """A node where the leaving state is `at`."""
        ys = self.ys
        if not ys[0] < at < ys[-1]:
            return
        j = int(np.searchsorted(ys, at))
        if ys[j] == at:
            return
        u = (at - ys[j - 1]) / (ys[j] - ys[j - 1])
        self.xs = np.insert(self.xs, j, self.xs[j - 1] + (self.xs[j] - self.xs[j - 1]) * u)
        self.ys = np.insert(ys, j, at)
        a, b, c = self.poly[j - 1]
        w = 1 - u
        self.poly = np.insert(self.poly, j, (a + b * u + c * u * u, (b + 2 * c * u) * w, c * w * w), axis=0)
        self.poly[j - 1] = (a, b * u, c * u * u)

    def add(self, v: float, censored: bool) -> None:
        self.n += 1
        self.censored_n += censored
        for at in (v,) if censored else self.kind.breaks(v):
            self._split(at)
        if censored:
            self.ys = np.maximum(self.ys, v)
        else:
            new = self.kind.step(self.ys, v)
            d = (new - self.ys) / ALPHA
            low, rise = d[:-1], np.diff(d)
            self.poly = (1 - ALPHA) * (self.poly + ALPHA * np.stack([low * low, 2 * low * rise, rise * rise], axis=1))
            self.ys = new
            self.keep *= 1 - ALPHA
        if self.alone != self.alone:
            self.alone = self.kind.first(v, censored)
        elif censored:
            self.alone = max(self.alone, v)
        else:
            nxt = self.kind.scalar(self.alone, v)
            d = (nxt - self.alone) / ALPHA
            self.alone, self.alone_keep, self.alone_add = nxt, self.alone_keep * (1 - ALPHA), (1 - ALPHA) * (self.alone_add + ALPHA * d * d)

    def leave(self, state: float | None, variance: float) -> tuple[float, float]:
        """State and variance after the slice."""
        if state is None:
            return self.alone, variance * self.alone_keep + self.alone_add
        i = min(max(int(np.searchsorted(self.xs, state, "right")) - 1, 0), len(self.xs) - 2)
        u = (state - self.xs[i]) / (self.xs[i + 1] - self.xs[i])
        a, b, c = self.poly[i]
        return float(self.ys[i] + (self.ys[i + 1] - self.ys[i]) * u), float(variance * self.keep + a + u * (b + u * c))

    FIELDS = "xs array<double>, ys array<double>, poly array<double>, keep double, n long, censored_n long, alone double, alone_keep double, alone_add double"

    def packed(self) -> tuple:
        return self.xs.tolist(), self.ys.tolist(), self.poly.ravel().tolist(), self.keep, self.n, self.censored_n, self.alone, self.alone_keep, self.alone_add

    @classmethod
    def unpacked(cls, kind, row: tuple) -> SliceSummary:
        out = cls(kind)
        out.xs, out.ys, out.poly = np.array(row[0]), np.array(row[1]), np.array(row[2]).reshape(-1, 3)
        out.keep, out.n, out.censored_n, out.alone, out.alone_keep, out.alone_add = row[3:9]
        return out


class LateFold(StatefulProcessor):
    """Folds a key's observations by time slice; after each micro-batch one row with the state over all rows so far."""

    def __init__(self, key_columns: list[str], kind, slice_ms: float, open_slices: int | None):
        self.key_columns, self.kind, self.slice_ms, self.open_slices = key_columns, kind, slice_ms, open_slices

    def init(self, handle) -> None:
        self.slices = handle.getMapState("slices", "slice long", "t array<double>, o array<long>, v array<double>, c array<boolean>, open boolean, " + SliceSummary.FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple]] = {}
        for pdf in rows:
            for t, o, v, c in zip(*[pdf[x].tolist() for x in ("t", "o", "v", "c")], strict=True):
                if not DOMAIN[0] < v < DOMAIN[1]:
                    raise ValueError(f"an observation of e^{v} seconds is beyond the estimator's range")
                fresh.setdefault(int(t // self.slice_ms), []).append((t, o, v, bool(c)))
        held = {k[0]: v for k, v in self.slices.iterator()}
        newest = max([*held, *fresh])
        for s, new in fresh.items():
            before = held.get(s)
            if (before is not None and not before[4]) or (before is None and self._closed(s, newest)):
                continue  # behind the horizon: the rows to fold again are gone
            own = sorted([*(zip(*before[:4], strict=True) if before is not None else ()), *new], key=lambda r: r[:2])
            summary = SliceSummary(self.kind)
            summary.add_all([(v, c) for _, _, v, c in own])
            held[s] = (*[list(x) for x in zip(*own, strict=True)], True, *summary.packed())
            if not self._closed(s, newest):
                self.slices.updateValue((s,), held[s])
        for s, row in list(held.items()):
            if row[4] and self._closed(s, newest):
                held[s] = ([], [], [], [], False, *row[5:])
                self.slices.updateValue((s,), held[s])
        state, variance, n, censored = None, INITIAL_VARIANCE, 0, 0
        for s in sorted(held):
            summary = SliceSummary.unpacked(self.kind, held[s][5:])
            state, variance = summary.leave(state, variance)
            n, censored = n + summary.n, censored + summary.censored_n
        if n:
            yield pd.DataFrame([(*key, n, censored, state, variance)], columns=[*self.key_columns, "n", "censored_n", "state", "variance"])

    def _closed(self, s: int, newest: int) -> bool:
        return self.open_slices is not None and s <= newest - self.open_slices

    def close(self) -> None:
        pass


def fold_durations(observations: DataFrame, slice_ms: float = 30 * 86_400_000.0, open_slices: int | None = None) -> DataFrame:
    """The streaming form of estimates.fold_durations: for each level and key that a micro-batch touches, the state over all rows so far.

    Of a key's rows the one with the largest `n` is the newest. With `open_slices` rows older than that many slices before a key's newest one don't
    count any more; without it every row does, however late.
    """
    wide = estimates.at_levels(observations).select("level", *estimates.PARTS, F.col("t").cast("double").alias("t"), F.col("ord").cast("long").alias("o"), F.ln("ref_s").alias("v"), F.col("censored").alias("c"))
    keys = ["level", *estimates.PARTS]
    kinds = ", ".join(f"{k} {wide.schema[k].dataType.simpleString()}" for k in keys)
    return wide.groupBy(*keys).transformWithStateInPandas(LateFold(keys, LogStep, slice_ms, open_slices), f"{kinds}, n long, censored_n long, state double, variance double", "Append", "None")
