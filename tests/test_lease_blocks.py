"""Lease expiry against plain rules on random rows, cut into micro-batches in several ways, and how often it goes to the state."""

import random

import pandas as pd
import pytest

from runlens.plans.queue import AMNESTY_AFTER_MS, LEASE_TTL_MS, LOST_AFTER_MS
from runlens.streaming import timers

COLUMNS = ["t_ms", "ticket_id", "state", "lease_until_ms", "requeues", "cancel_requested"]
KEY = (1, 0)


class Handle:
    """State variables and timers of one key in plain dicts; counts the accesses."""

    def __init__(self):
        self.vars, self.timers, self.accesses = {}, set(), 0

    def getMapState(self, name, *_):
        return self.vars.setdefault(name, Map(self))

    def getValueState(self, name, *_):
        return self.vars.setdefault(name, Value(self))

    def registerTimer(self, t):
        self.accesses += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.accesses += 1
        self.timers.discard(t)

    def listTimers(self):
        self.accesses += 1
        return iter(sorted(self.timers))


class Map:
    def __init__(self, handle):
        self.handle, self.data = handle, {}

    def _get(self):
        self.handle.accesses += 1
        return self.data

    def getValue(self, key):
        return self._get().get(key)

    def containsKey(self, key):
        return key in self._get()

    def updateValue(self, key, value):
        self._get()[key] = value

    def removeKey(self, key):
        del self._get()[key]

    def keys(self):
        return iter(list(self._get()))

    def iterator(self):
        return iter(list(self._get().items()))

    def clear(self):
        self._get().clear()


class Value(Map):
    def get(self):
        return self._get().get(0)

    def update(self, value):
        self._get()[0] = value

    def exists(self):
        return 0 in self._get()


class Clock:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):
        return self.t

    def getExpiryTimeInMs(self):
        return self.t


def drive(batches):
    """What comes of micro-batches (rows, the watermark after them), and the handle."""
    handle, out = Handle(), []
    processor = timers.LeaseExpiry()
    processor.init(handle)
    for rows, mark in batches:
        if rows:
            frame = pd.DataFrame(rows, columns=COLUMNS)
            for pdf in processor.handleInputRows(KEY, iter([frame]), Clock(mark)):
                out += pdf.itertuples(index=False, name=None)
        while handle.timers and min(handle.timers) <= mark:
            t = min(handle.timers)
            for pdf in processor.handleExpiredTimer(KEY, Clock(mark), Clock(t)):
                out += pdf.itertuples(index=False, name=None)
            handle.timers.discard(t)
    return sorted(tuple(None if x != x else x for x in r) for r in out), handle


def plain(rows):
    """The rules, row by row: a tick finds what expired up to it and did not change at its own instant."""
    leases, last, out = {}, None, []
    for t in sorted({r[0] for r in rows}):
        now = [r for r in rows if r[0] == t]
        for _, ticket, state, until, requeues, cancel in now:
            if ticket is None:
                continue
            if state in ("claimed", "running"):
                leases[ticket] = (state, until, requeues, cancel, t)
            elif ticket in leases:
                out.append((1, ticket, "kept", None, leases.pop(ticket)[1], t))
        if all(r[1] is not None for r in now):
            continue
        if last is not None and t - last > AMNESTY_AFTER_MS:
            leases = {i: (s, max(u, t + LEASE_TTL_MS), n, c, at) for i, (s, u, n, c, at) in leases.items()}
        last = t
        for ticket, (state, until, requeues, cancel, at) in list(leases.items()):
            if at < t and until + (LOST_AFTER_MS - LEASE_TTL_MS if state == "running" else 0) < t:
                del leases[ticket]
                verdict = "lost" if state == "running" else "cancelled" if cancel else "lost" if requeues >= 5 else "queued"
                out.append((1, ticket, verdict, t + min(5000 * 2**requeues, 60_000) if verdict == "queued" else None, until, t))
    return sorted(out), leases


def some_rows(r, n, tickets, span):
    rows = []
    for _ in range(n):
        t, kind = r.randrange(span) // 7 * 7, r.random()
        if kind < 0.15:
            rows.append((t, None, None, None, None, None))
        else:
            state = r.choice(["claimed", "claimed", "running", "finished"])
            rows.append((t, r.randrange(tickets), state, None if state == "finished" else t + r.choice([-200_000, -1, 0, 1, 30_000, -LOST_AFTER_MS, r.randrange(200_000)]), r.randrange(7), r.random() < 0.2))
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_random_rows_in_any_micro_batches(seed, monkeypatch):
    monkeypatch.setattr(timers, "SPAN", 5)
    monkeypatch.setattr(timers, "BLOCKS", 3 if seed % 2 else 64)
    r = random.Random(seed)
    span = r.choice([300_000, 3_000_000, 12_000_000])
    rows = some_rows(r, 400, r.choice([4, 40]), span)
    # rows of one instant stay in order, however they are cut: a row comes before the watermark passes it
    want, left = plain(rows)
    for delay in (0, span // 10, 2 * span):
        ordered = sorted(rows, key=lambda x: x[0])
        batches, mark = [], -1
        while ordered:
            size = r.choice([1, 3, 20, 60])
            taken = ordered[:size]
            while len(taken) < len(ordered) and ordered[len(taken)][0] == taken[-1][0]:  # whole instants
                taken.append(ordered[len(taken)])
            ordered = ordered[len(taken) :]
            mark = max(mark, taken[-1][0] - delay)
            batches.append((taken, mark))
        # neighbouring batches trade places where the delay allows for it
        for i in range(len(batches) - 1):
            (a, m), (b, m2) = batches[i], batches[i + 1]
            before = batches[i - 1][1] if i else -1
            top = max(x[0] for x in b) - delay
            if min(x[0] for x in a) > max(before, top):
                batches[i], batches[i + 1] = (b, max(before, top)), (a, m2)
        got, handle = drive([*batches, ([], 10**9)])
        assert got == want
        assert bool(left) == bool(handle.vars["leases"].data) == bool(handle.vars["due"].data or handle.vars["overdue"].data)
        assert not handle.vars["pending"].data


def test_a_row_costs_no_access_to_the_state():
    """Leases with a deadline each, that come at a time each: before, about a dozen accesses and a timer for each of them."""
    n = 3000
    rows = [(1000 + i, i, "claimed", 10_000 + 3 * i, 0, False) for i in range(n)]
    ticks = [(60_000, None, None, None, None, None)]
    ends = [(61_000 + i, i, "finished", None, 0, False) for i in range(n)]
    got, handle = drive([(rows[::2], 0), (rows[1::2], 5_000), (ticks, 60_500), (ends, 100_000)])
    assert [x[2] for x in got] == ["queued"] * n and not handle.vars["leases"].data
    assert handle.accesses < n / 2


def test_leases_that_stay_are_read_once_a_call():
    n = 3000
    rows = [(1000 + i, i, "claimed", 10**8 + 3 * i, 0, False) for i in range(n)]
    got, handle = drive([(rows, 10_000)])
    before = handle.accesses
    assert not got and before < n / 4
    assert sum(len(x[0]) for x in handle.vars["leases"].data.values()) < 60 * n
