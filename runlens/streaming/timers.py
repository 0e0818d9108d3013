"""Streams whose rules need event-time order, timers and keyed maps (transformWithState; state lives in RocksDB).

`InOrder` holds a key's rows back until the watermark has passed their time and then hands them over in order, whatever files or
micro-batches they came in. A processor asks for wake-ups with `wake_at`, also in the past of the watermark, and gets them in their place
among the rows. Rows wait in spans of consecutive times, and a key has one timer, at the first instant it waits for: an access to the state or a
timer costs far more than a row. A task holds the rows that one key gets in a micro-batch, and when they are handed over the spans of one instant.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from runlens.functions.queue import MAX_REQUEUES
from runlens.plans.queue import AMNESTY_AFTER_MS, LEASE_TTL_MS, LOST_AFTER_MS
from runlens.plans.telemetry import MAX_PING_MS, MIN_PING_MS, NO_PROGRESS_CORES
from runlens.session import work_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The bucket of rows that only move the watermark.
MARK = -1
#: Rows that wait together, and result rows that are handed over, at a time.
SPAN = 1000
#: Parts that the leases of a bucket of tickets are kept in.
BLOCKS = 64
#: After every instant.
NEVER = 2**63 - 1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which transformWithState needs; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def append_stateful(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Like jobs.append_available, for streams of this module."""
    with rocksdb_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def run_stateful(stream: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Runs a stream over what is there now; what it wrote, and its checkpoint (for a look at the state)."""
    spark = stream.sparkSession
    path, checkpoint = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    append_stateful(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path), checkpoint


def plain(value, kind: str):
    """A cell as pandas hands it over, as a plain value of its kind: missing cells of number columns arrive as NaN."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return {"long": int, "double": float, "boolean": bool, "string": str}.get(kind, lambda x: x)(value)


class InOrder(StatefulProcessor):
    """Rows with `t_ms` by time, then by `order`. Subclasses name their `fields`, open their state in `open`, and answer `rows_at` and `woken_at`.

    All that the watermark has passed is handed over in one call, between `begin` and `finish`, so a subclass may read its state once a call.
    """

    fields: dict[str, str] = {}
    order: str | None = None

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "t long", "rows string")  # by a span's first time: [call, [[t, *fields], ...]], ...
        self.soon = handle.getValueState("soon", "times array<long>, timer long, calls long")  # wake-ups, the timer set, calls that brought rows
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def begin(self, key: tuple) -> None:
        """Called before the instants of a call."""

    def finish(self, key: tuple) -> None:
        """Called after the instants of a call."""

    def rows_at(self, key: tuple, t: int, rows: list[dict]) -> Iterator[tuple]:
        """Result rows for the rows of one instant."""
        raise NotImplementedError

    def woken_at(self, key: tuple, t: int) -> Iterator[tuple]:
        """Called before the rows of the same instant."""
        return iter(())

    columns: list[str] = []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] == MARK:  # a row that only moves the watermark
            return iter(())
        fresh: list[tuple] = []
        for pdf in rows:
            cells = [[plain(v, k) for v in pdf[c].tolist()] for c, k in self.fields.items()]
            fresh += zip(map(int, pdf["t_ms"].tolist()), *cells, strict=True)
        if fresh:
            fresh.sort(key=itemgetter(0))
            times, timer, calls = self.soon.get() or ([], None, 0)
            for low in range(0, len(fresh), SPAN):
                self._hold([(calls, fresh[low : low + SPAN])])
            self._set(times, timer, calls + 1, fresh[0][0] if timer is None else min(timer, fresh[0][0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        times, _, calls = self.soon.get() or ([], None, 0)
        # read and written once a call; an ascending list is a heap, and `live` tells which of its times still count
        self.heap, self.live = list(times), set(times)
        spans = deque(sorted(t for (t,) in self.pending.keys()))
        ready: list[tuple] = []  # a heap of the rows of opened spans: t, call, number, row
        self.begin(key)
        while True:
            t = min(ready[0][0] if ready else NEVER, self._first_soon())
            if spans and spans[0] <= min(t, mark):
                self._open_span(spans.popleft(), ready)
            elif t <= mark:
                out += self._at(key, t, ready)
                if len(out) >= SPAN:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
            else:
                break
        self.finish(key)
        if ready:  # the end of a span that the watermark has not passed
            parts: dict[int, list] = {}
            for _, call, _, row in sorted(ready):
                parts.setdefault(call, []).append(row)
            self._hold(list(parts.items()))
        first = min(t, spans[0] if spans else NEVER)
        if first < NEVER:
            self._set(sorted(self.live), None, calls, first)
        else:
            self.soon.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _hold(self, parts: list[tuple[int, list]]) -> None:
        """Puts rows away as a span; with one that begins at the same instant if there is one."""
        first = min(rows[0][0] for _, rows in parts)
        held = self.pending.getValue((first,))
        self.pending.updateValue((first,), (json.dumps([*(json.loads(held[0]) if held else ()), *parts], separators=(",", ":")),))

    def _open_span(self, first: int, ready: list[tuple]) -> None:
        parts = json.loads(self.pending.getValue((first,))[0])
        self.pending.removeKey((first,))
        for call, rows in parts:
            for row in rows:
                self.opened += 1
                heapq.heappush(ready, (row[0], call, self.opened, row))

    opened = 0

    def _set(self, times: list[int], timer: int | None, calls: int, first: int) -> None:
        """Moves the key's timer (None: it has fired or there is none) to the first instant that is waited for."""
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.soon.update((times, first, calls))

    def _first_soon(self) -> int:
        while self.heap and self.heap[0] not in self.live:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else NEVER

    def _at(self, key, t: int, ready: list[tuple]) -> list[tuple]:
        self.live.discard(t)
        rows = []
        while ready and ready[0][0] == t:
            rows.append(dict(zip(self.fields, heapq.heappop(ready)[3][1:], strict=True)))
        out = list(self.woken_at(key, t))
        if rows:
            out += self.rows_at(key, t, sorted(rows, key=lambda r: r[self.order]) if self.order else rows)
        return out

    def wake_at(self, t: int) -> None:
        if t not in self.live:
            self.live.add(t)
            heapq.heappush(self.heap, t)

    def sleep_at(self, t: int) -> None:
        """Takes a wake-up back."""
        self.live.discard(t)

    def close(self) -> None:
        pass


# ---- lease expiry -------------------------------------------------------------------------------------------------

class LeaseExpiry(InOrder):
    """The leases of one bucket of tickets: a timer at the first deadline, verdicts at the first tick after each. Only the time of the last tick stays for good.

    The leases are kept in BLOCKS blocks by a hash of the ticket, each with its first deadline or a time before it. Once that has passed, the block is
    overdue: the next tick opens it, and no other. A call reads and writes a block once, whatever number of its leases change.
    A tick more than AMNESTY_AFTER_MS after the one before first extends every lease to now + LEASE_TTL_MS, which moves the timer.
    """

    fields = {"ticket_id": "long", "state": "string", "lease_until_ms": "long", "requeues": "long", "cancel_requested": "boolean"}
    columns = ["cluster", "ticket_id", "verdict", "not_before_ms", "lease_until_ms", "t_ms"]

    def open(self, handle) -> None:
        self.leases = handle.getMapState("leases", "block long", "leases string")  # [ticket, state, until, requeues, cancel], ...
        self.due = handle.getValueState("due", "times array<long>")  # of each block
        self.overdue = handle.getValueState("overdue", "blocks array<long>")
        self.tick = handle.getValueState("tick", "t long")

    def begin(self, key) -> None:
        due, overdue = self.due.get(), self.overdue.get()
        self.first, self.late = list(due[0]) if due else [NEVER] * BLOCKS, set(overdue[0]) if overdue else set()
        self.had_due, self.had_late = bool(due), bool(overdue)
        self.opened_blocks: dict[int, dict] = {}
        self.stored: set[int] = set()
        self.changed: set[int] = set()
        self.aimed = self._next_deadline()

    def finish(self, key) -> None:
        for b in sorted(self.changed):
            held = self.opened_blocks[b]
            if held:
                self.leases.updateValue((b,), (json.dumps([(i, *x) for i, x in held.items()], separators=(",", ":")),))
            elif b in self.stored:
                self.leases.removeKey((b,))
        if any(t < NEVER for t in self.first):
            self.due.update((self.first,))
        elif self.had_due:
            self.due.clear()
        if self.late:
            self.overdue.update((sorted(self.late),))
        elif self.had_late:
            self.overdue.clear()

    @staticmethod
    def deadline(state: str, until: int) -> int:
        """The first instant at which a tick finds the lease expired."""
        return until + 1 + (LOST_AFTER_MS - LEASE_TTL_MS if state == "running" else 0)

    @staticmethod
    def block_of(ticket: int) -> int:
        return (ticket * 0x9E3779B97F4A7C15 >> 40) % BLOCKS

    def _block(self, b: int) -> dict[int, tuple]:
        if b not in self.opened_blocks:
            text = self.leases.getValue((b,))
            if text:
                self.stored.add(b)
            self.opened_blocks[b] = {i: tuple(x) for i, *x in json.loads(text[0])} if text else {}
        return self.opened_blocks[b]

    def _next_deadline(self) -> int:
        return min((t for b, t in enumerate(self.first) if b not in self.late), default=NEVER)

    def _aim(self) -> None:
        t = self._next_deadline()
        if t != self.aimed:
            self.sleep_at(self.aimed)
            if t < NEVER:
                self.wake_at(t)
            self.aimed = t

    def _look_again(self, b: int) -> None:
        self.first[b] = min((self.deadline(x[0], x[1]) for x in self._block(b).values()), default=NEVER)

    def woken_at(self, key, t: int) -> Iterator[tuple]:
        if self.aimed <= t:
            self.late.update(b for b, first in enumerate(self.first) if first <= t)
            self._aim()
        return iter(())

    def rows_at(self, key, t: int, rows: list[dict]) -> Iterator[tuple]:
        changed = set()
        for r in (r for r in rows if r["ticket_id"] is not None):
            ticket = r["ticket_id"]
            b = self.block_of(ticket)
            held = self._block(b)
            before = held.get(ticket)
            if r["state"] in ("claimed", "running"):
                held[ticket] = (r["state"], r["lease_until_ms"], r["requeues"] or 0, bool(r["cancel_requested"]))
                self.first[b] = min(self.first[b], self.deadline(r["state"], r["lease_until_ms"]))
            elif before:
                del held[ticket]
                yield (key[0], ticket, "kept", None, before[1], t)
                if not held:
                    self.first[b] = NEVER
                    self.late.discard(b)
            else:
                continue
            changed.add(ticket)
            self.changed.add(b)
        if any(r["ticket_id"] is None for r in rows):
            yield from self._ticked(key, t, changed)
        self._aim()

    def _ticked(self, key, now: int, changed: set[int]) -> Iterator[tuple]:
        """A lease that changed at this instant is not looked at before the next tick, unless an amnesty moves it."""
        before = self.tick.get()
        self.tick.update((now,))
        if before and now - before[0] > AMNESTY_AFTER_MS:
            floor = now + LEASE_TTL_MS
            for b in (b for b, t in enumerate(self.first) if t < NEVER):
                held = self._block(b)
                for ticket, (state, until, requeues, cancel) in held.items():
                    if until < floor:
                        held[ticket] = (state, floor, requeues, cancel)
                        self.changed.add(b)
                self._look_again(b)
            self.late.clear()
        for b in sorted(self.late):
            held = self._block(b)
            for ticket, (state, until, requeues, cancel) in list(held.items()):
                if ticket in changed or self.deadline(state, until) > now:
                    continue
                del held[ticket]
                self.changed.add(b)
                if state == "running":
                    yield (key[0], ticket, "lost", None, until, now)
                else:
                    back = "cancelled" if cancel else "lost" if requeues >= MAX_REQUEUES else "queued"
                    yield (key[0], ticket, back, now + int(min(5000 * 2.0**requeues, 60000)) if back == "queued" else None, until, now)
            self._look_again(b)
        self.late.clear()


def lease_verdicts(tickets: DataFrame, ticks: DataFrame, buckets: int = 256, delay: str = "0 seconds") -> DataFrame:
    """Verdicts as leases expire or end: cluster, ticket_id, verdict, not_before_ms, lease_until_ms, t_ms.

    tickets: a row each time a ticket's lease changes (cluster, ticket_id, t_ms, state, lease_until_ms, requeues, cancel_requested); any state but
    claimed and running ends the lease, which was kept. ticks: cluster, t_ms; each goes to every bucket. A ticket row with a null id only
    moves the watermark; rows without a cluster are left out.
    """
    bucket = F.when(F.col("ticket_id").isNull(), MARK).otherwise(F.pmod(F.xxhash64("ticket_id"), F.lit(buckets)).cast("int"))
    rows = tickets.select(
        "cluster", bucket.alias("bucket"), "t_ms", "ticket_id", "state", "lease_until_ms", F.col("requeues").cast("long").alias("requeues"), "cancel_requested")
    none = {c: F.lit(None).cast(k) for c, k in LeaseExpiry.fields.items()}
    beats = ticks.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "t_ms", *[c.alias(n) for n, c in none.items()])
    timed = rows.unionByName(beats).filter("cluster IS NOT NULL").withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay)
    kind = tickets.schema["cluster"].dataType.simpleString()
    return timed.groupBy("cluster", "bucket").transformWithStateInPandas(
        LeaseExpiry(), f"cluster {kind}, ticket_id long, verdict string, not_before_ms long, lease_until_ms long, t_ms long", "Append", "EventTime")


def state_rows(spark: SparkSession, checkpoint: str, *names: str) -> int:
    """Rows left in the named state variables of a finished query."""
    store = spark.read.format("statestore").option("path", checkpoint)
    return sum(store.option("stateVarName", n).load().count() for n in names)


# ---- no progress --------------------------------------------------------------------------------------------------

class NoProgress(InOrder):
    """The processes of a lease as a map from identity to CPU seconds; each observation is held against the one before.

    A lease that is not observed for `forget_ms` is forgotten, as if it came anew.
    """

    fields = {"output_bytes": "long", "identity": "string", "cpu_sec": "double"}
    columns = ["lease_id", "t_ms", "interval_cores", "idle_ms"]

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def open(self, handle) -> None:
        self.procs = handle.getMapState("procs", "identity string", "cpu_sec double")
        self.last = handle.getValueState("last", "t long, output_bytes long, busy_ms long")

    def woken_at(self, key, t: int) -> Iterator[tuple]:
        last = self.last.get()
        if last and t - last[0] >= self.forget_ms:
            self.procs.clear()
            self.last.clear()
        return iter(())

    def rows_at(self, key, t: int, rows: list[dict]) -> Iterator[tuple]:
        now = {r["identity"]: r["cpu_sec"] for r in rows}
        output, last = max(r["output_bytes"] for r in rows), self.last.get()
        before = {k[0]: v[0] for k, v in self.procs.iterator()} if last else {}
        cores, idle = None, False
        if last and now.keys() == before.keys():
            cores = sum(max(0.0, c - before[i]) for i, c in now.items()) / ((t - last[0]) / 1000)
            idle = output == last[1] and cores <= NO_PROGRESS_CORES
        for identity in before.keys() - now.keys():
            self.procs.removeKey((identity,))
        for identity, cpu in now.items():
            if before.get(identity) != cpu:
                self.procs.updateValue((identity,), (cpu,))
        busy = last[2] if idle else t
        if last:
            self.sleep_at(last[0] + self.forget_ms)
        self.last.update((t, output, busy))
        self.wake_at(t + self.forget_ms)
        yield key[0], t, cores, t - busy if idle else 0


def no_progress(members: DataFrame, forget_ms: int = 86_400_000, delay: str = "10 minutes") -> DataFrame:
    """The streaming form of telemetry.no_progress: interval cores and idle streak of each observation, in order.

    members: one row per process of an observation (lease_id, t_ms, output_bytes, identity, cpu_sec), in any order within `delay`. A row with a
    null identity only moves the watermark; rows without a lease are left out.
    """
    rows = members.filter("lease_id IS NOT NULL").select("lease_id", F.when(F.col("identity").isNull(), MARK).otherwise(0).alias("bucket"), "t_ms", "output_bytes", "identity", "cpu_sec")
    kind = members.schema["lease_id"].dataType.simpleString()
    return rows.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay).groupBy("lease_id", "bucket").transformWithStateInPandas(
        NoProgress(forget_ms), f"lease_id {kind}, t_ms long, interval_cores double, idle_ms long", "Append", "EventTime")


# ---- runner states ------------------------------------------------------------------------------------------------

class RunnerStates(StatefulProcessor):
    """A runner's state changes: at its pings, and by timers when it has been unreachable for too long.

    Deadlines behind a ping are passed before the ping counts, so the changes are the same however rows fall into micro-batches; the
    timers only bring them forward to when the clock passes, without any row of that runner.
    """

    columns = ["runner", "t_ms", "state", "unreachable_since", "last_ok_ms", "next_ping_ms", "lost_settle_ms"]

    def __init__(self, down_after_ms: int, lost_after_ms: int):
        self.down_after_ms, self.lost_after_ms = down_after_ms, lost_after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("runner", "state string, since long, last_ok long, next_ping long, offline boolean, available boolean")

    def _deadlines(self, since: int) -> list[tuple[int, str]]:
        return sorted([(since + self.down_after_ms, "down"), (since + self.lost_after_ms, "lost")])

    def _pass(self, key, s: dict, t: int, out: list[tuple]) -> None:
        """The deadlines up to t."""
        if s["since"] is not None and not s["offline"]:
            rank = ["unreachable", "down", "lost"]
            for at, name in self._deadlines(s["since"]):
                if at <= t and rank.index(name) > rank.index(s["state"]):
                    s["state"] = name
                    out.append(self._row(key, at, s))

    def _row(self, key, t: int, s: dict) -> tuple:
        settle = s["since"] + self.lost_after_ms if s["since"] is not None and not s["offline"] else None
        return key[0], t, s["state"], s["since"], s["last_ok"], None if s["offline"] else s["next_ping"], settle

    def _load(self) -> dict:
        row = self.held.get()
        return dict(zip(("state", "since", "last_ok", "next_ping", "offline", "available"), row or (None, None, None, None, False, True), strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] == MARK:
            return
        cells = [r for pdf in rows for r in zip(*[pdf[c].tolist() for c in ("ord", "t_ms", "ok", "offline", "available")], strict=True)]
        s, out = self._load(), []
        old = s["since"]
        for _, t, ok, offline, available in sorted(cells):
            self._pass(key, s, t, out)
            s["offline"], s["available"] = bool(offline), bool(available)
            if ok:
                s["since"], s["last_ok"], s["next_ping"] = None, t, None
            else:
                s["since"] = t if s["since"] is None else s["since"]
                s["next_ping"] = t + min(MAX_PING_MS, max(MIN_PING_MS, t - s["since"]))
            now = "offline" if offline else ("up" if available else "off-schedule") if ok else s["state"] if s["state"] in ("down", "lost") else "unreachable"
            if now != s["state"]:
                s["state"] = now
                out.append(self._row(key, t, s))
        if s["since"] != old:
            for at, _ in self._deadlines(old) if old is not None else ():
                self.handle.deleteTimer(at)
            for at, _ in self._deadlines(s["since"]) if s["since"] is not None and not s["offline"] else ():
                self.handle.registerTimer(at)
        self.held.update(tuple(s.values()))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        self._pass(key, s, expiredTimerInfo.getExpiryTimeInMs(), out)
        if out:
            self.held.update(tuple(s.values()))
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def runner_states(pings: DataFrame, runners: DataFrame, down_after_ms: int, lost_after_ms: int, clock: str = "event", delay: str = "10 minutes") -> DataFrame:
    """State changes of the runners: offline, lost, down, unreachable, off-schedule, up (runner, t_ms, state, ...).

    pings: runner, ord, t_ms, ok; a ping without `ok` only moves the watermark. runners: a static table of runner, offline, available; an unlisted one is
    neither offline nor off schedule. With `clock` "event" time is the pings' watermark; with "processing" it is the wall clock, by which `t_ms` must
    then have been taken, and a runner goes down even if no ping of any runner comes.
    """
    timed = pings.filter("runner IS NOT NULL").withColumn("ts", F.timestamp_millis("t_ms"))
    timed = timed.withWatermark("ts", delay) if clock == "event" else timed
    no, yes = F.lit(False), F.lit(True)
    rows = timed.join(runners, "runner", "left").withColumns({"offline": F.coalesce("offline", no), "available": F.coalesce("available", yes), "bucket": F.when(F.col("ok").isNull(), MARK).otherwise(0)})
    return rows.groupBy("runner", "bucket").transformWithStateInPandas(
        RunnerStates(down_after_ms, lost_after_ms), "runner string, t_ms long, state string, unreachable_since long, last_ok_ms long, next_ping_ms long, lost_settle_ms long",
        "Append", "EventTime" if clock == "event" else "ProcessingTime")
