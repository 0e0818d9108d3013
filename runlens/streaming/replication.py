"""Replication lag of object stores over a journal whose records come in any order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from runlens.streaming.timers import plain

#: Sequence numbers that share a state entry.
BLOCK = 4096


class Seen:
    """A set of sequence numbers as disjoint, not touching intervals [starts[i], ends[i]]."""

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or ()), list(ends or ())

    def add_all(self, numbers: list[int]) -> None:
        """Adds numbers, neighbours together."""
        numbers = sorted(set(numbers))
        k = 0
        while k < len(numbers):
            low = high = numbers[k]
            while k + 1 < len(numbers) and numbers[k + 1] == high + 1:
                k, high = k + 1, high + 1
            k += 1
            i, j = bisect_left(self.ends, low - 1), bisect_right(self.starts, high + 1)
            if i < j:
                low, high = min(low, self.starts[i]), max(high, self.ends[j - 1])
            self.starts[i:j], self.ends[i:j] = [low], [high]

    def missing(self, above: int) -> tuple[int, int | None]:
        """How many numbers above `above` and below the largest are not there, and the first of them."""
        count, first, at = 0, None, above + 1
        for low, high in zip(self.starts, self.ends, strict=True):
            if high < at:
                continue
            if low > at:
                count, first = count + low - at, at if first is None else first
            at = high + 1
        return count, first


class Lag(StatefulProcessor):
    """Per store: which records were seen, the newest mark, and the creation times of the records above it.

    Records up to the mark leave only their interval behind, so the state is as large as the lag and the gaps.
    """

    columns = ["store", "version", "oldest_ms", "replicated_seq", "head_seq", "failed_rounds", "missing", "first_missing"]

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "starts array<long>, ends array<long>")
        self.above = handle.getMapState("above", "block long", "seqs array<long>, created array<long>")
        self.mark = handle.getValueState("mark", "at long, replicated_seq long, failed_rounds long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        records, marks = {}, []
        for pdf in rows:
            for seq, created, at, replicated, failed in zip(*[[plain(v, "long") for v in pdf[c].tolist()] for c in ("seq", "created_ms", "at", "replicated_seq", "failed_rounds")], strict=True):
                if at is None:
                    records[seq] = created
                else:
                    marks.append((at, replicated, failed))
        held = self.mark.get() or (-1, -1, 0, 0)
        at, replicated, failed = max([tuple(held[:3]), *marks])
        seen = Seen(*(self.seen.get() or ()))
        seen.add_all(list(records))
        self.seen.update((seen.starts, seen.ends))
        fresh: dict[int, dict[int, int]] = {}
        for seq, created in records.items():
            if seq > replicated:
                fresh.setdefault(seq // BLOCK, {})[seq] = created
        blocks = {k[0]: v for k, v in self.above.iterator()}
        oldest = None
        for b in sorted({*blocks, *fresh}):
            old = dict(zip(*blocks[b], strict=True)) if b in blocks else {}
            now = {s: c for s, c in {**old, **fresh.get(b, {})}.items() if s > replicated}
            if now and now != old:
                self.above.updateValue((b,), (list(now), list(now.values())))
            elif not now and b in blocks:
                self.above.removeKey((b,))
            if now and oldest is None:
                oldest = now[min(now)]
        self.mark.update((at, replicated, failed, held[3] + 1))
        if at >= 0:
            missing, first = seen.missing(replicated)
            yield pd.DataFrame([(key[0], held[3] + 1, oldest, replicated, seen.ends[-1] if seen.ends else 0, failed, missing, first)], columns=self.columns).astype(
                {"oldest_ms": "Int64", "first_missing": "Int64"})

    def close(self) -> None:
        pass


def replication_lag(journal: DataFrame, marks: DataFrame) -> DataFrame:
    """After each micro-batch that touches a store: the creation time of the first record seen above its newest mark, and the gaps above it.

    journal: store, seq, created_ms, in any order, repeats allowed. marks: store, at, replicated_seq, failed_rounds; the one with the largest `at` counts. Of a
    store's rows the one with the largest `version` is the newest. While `missing` is above 0 an older record may still come.
    """
    none = F.lit(None).cast("long")
    a = journal.select("store", "seq", "created_ms", none.alias("at"), none.alias("replicated_seq"), none.alias("failed_rounds"))
    b = marks.select("store", none.alias("seq"), none.alias("created_ms"), *[F.col(c).cast("long").alias(c) for c in ("at", "replicated_seq", "failed_rounds")])
    kind = journal.schema["store"].dataType.simpleString()
    return a.unionByName(b).groupBy("store").transformWithStateInPandas(
        Lag(), f"store {kind}, version long, oldest_ms long, replicated_seq long, head_seq long, failed_rounds long, missing long, first_missing long", "Append", "None")


def newest_lag(lags: DataFrame, now: int) -> DataFrame:
    """The newest row of each store with its age at `now`, as inventory.replication_lag gives it, and the number of missing records."""
    rest = [c for c in lags.columns if c not in ("store", "version")]
    n = lags.groupBy("store").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("store", "x.*")
    age = F.coalesce(F.greatest(F.when(F.col("oldest_ms").isNotNull(), F.lit(0.0)), (F.lit(now) - F.col("oldest_ms")) / 1000), F.lit(0.0))
    return n.select("store", age.alias("oldest_age_s"), "replicated_seq", "head_seq", "failed_rounds", "missing")
