"""Keyed state machines over event streams.

Each is a small step function over plain values. The keys are dealt over a fixed number of groups by hash; Spark keeps one row of state per
group, with an array per field that holds the states of its keys. So a micro-batch costs a call of Python per group and a step per row, however
many keys it touches. A micro-batch's rows of a group are put in arrival order and walked once, so the trigger's size (files or offsets per
trigger) bounds what a task holds; only a chunk of them stands as Python objects at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlens.operators.damped import follow, switch
from runlens.plans import telemetry as tel
from runlens.plans.queue import forecast_cycles


#: Rows that are made into Python objects, and result rows that are handed over, at a time.
CHUNK = 20_000
#: Groups that the keys are dealt over; a group's state is read and written as a whole. A checkpoint holds only for the number it was made with.
BUCKETS = 1024
#: The group of the rows without a key: a column of whole numbers holds no nulls beside other keys, which pandas would make floats.
NO_KEY = -1


def stateful(
    stream: DataFrame, key: str, order: str, state_schema: str, out_schema: str, start: tuple, step: Callable[[tuple, dict], tuple[tuple, tuple | None]],
    last_only: bool = False,
) -> DataFrame:
    """Runs `step(state, row) -> (state, output or None)` per key; with `last_only` one output per key and batch."""
    columns = [c.strip().split(" ")[0] for c in out_schema.split(",")]
    fields = [c.strip().split(" ") for c in state_schema.split(",")]
    kind = stream.schema[key].dataType.simpleString()
    held_schema = ", ".join(f"{name} array<{k}>" for name, k in [("keys", kind), *fields])

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {}
        if state.exists:
            keys, *held = state.get
            known = dict(zip(keys, zip(*held, strict=True), strict=True))
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        last = {}
        for low in range(0, len(rows), CHUNK):
            out = []
            for row in rows.iloc[low : low + CHUNK].to_dict("records"):
                k = None if group[0] == NO_KEY else row[key]
                known[k], made = step(known.get(k, start), row)
                if made is None:
                    continue
                if last_only:
                    last[k] = (k, *made)
                else:
                    out.append((k, *made))
            if out:
                yield pd.DataFrame(out, columns=columns)
        state.update((list(known), *map(list, zip(*known.values(), strict=True))))
        if last:
            yield pd.DataFrame(list(last.values()), columns=columns)

    group = F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")
    return stream.withColumn("group_", group).groupBy("group_").applyInPandasWithState(run, out_schema, held_schema, "append", GroupStateTimeout.NoTimeout)


def _num(x) -> bool:
    return x is not None and x == x


def _named(samples: DataFrame, thresholds: str | None) -> DataFrame:
    """Names of thresholds as text: whole numbers would read otherwise beside a missing one of another key."""
    return samples.withColumn(thresholds, F.col(thresholds).cast("string")) if thresholds else samples


def live_usage(heartbeats: DataFrame) -> DataFrame:
    """Usage so far of each lease after every batch (lease_id, ord, t_ms, cores)."""

    def step(s, r):
        peak, area, span, n, last_t, last_c = s
        if not _num(r["cores"]):
            return s, None
        t, c = int(r["t_ms"]), float(r["cores"])
        if n == 0:
            s = (c, 0.0, 0, 1, t, c)
        elif t <= last_t:
            s = (max(peak, c), area, span, n + 1, last_t, last_c)
        else:
            s = (max(peak, c), area + last_c * (t - last_t), span + t - last_t, n + 1, t, c)
        mean = s[1] / s[2] if s[2] > 0 else s[5]
        return s, (s[0], mean, s[3], s[2])

    return stateful(heartbeats.select("lease_id", "ord", "t_ms", "cores"), "lease_id", "ord", "peak double, area double, span long, n long, last_t long, last_c double",
                    "lease_id long, peak double, mean double, samples long, span_ms long", (0.0, 0.0, 0, 0, 0, 0.0), step, last_only=True)


def overrun_alerts(readings: DataFrame, max_gap_ms: int, min_ms: int) -> DataFrame:
    """One alert when a lease has been over its booking long enough (lease_id, ord, t_ms, cores, charged_cores)."""

    def step(s, r):
        since, last, peak, told = s
        t = int(r["t_ms"])
        over = _num(r["cores"]) and r["charged_cores"] > 0 and r["cores"] > tel.OVERRUN_FACTOR * r["charged_cores"]
        if not over:
            return (-1, -1, 0.0, False), None
        if since < 0 or not 0 < t - last <= max_gap_ms:
            since, peak, told = t, 0.0, False
        peak = max(peak, float(r["cores"]))
        alert = not told and t - since >= min_ms
        return (since, t, peak, told or alert), ((since, t, peak) if alert else None)

    return stateful(readings.select("lease_id", "ord", "t_ms", "cores", "charged_cores"), "lease_id", "ord", "since long, last long, peak double, told boolean",
                    "lease_id long, since_ms long, alert_ms long, peak double", (-1, -1, 0.0, False), step)


def hysteresis(
    samples: DataFrame, key: str, value: str, close: float, open_: float, open_samples: int, at_close: bool = False, thresholds: str | None = None,
) -> DataFrame:
    """Gate state after each sample (key, ord, value); `at_close` closes on the threshold itself. A missing sample is skipped.

    A change in the column `thresholds` restarts the countdown and leaves the state.
    """

    def step(s, r):
        closed, under, before = s
        x = r[value]
        if not _num(x):
            return s, None
        named = str(r[thresholds]) if thresholds else ""
        if named != before:
            under = 0
        if x > close or (at_close and x == close):
            closed, under = True, 0
        elif closed:
            under = under + 1 if x < open_ else 0
            if under >= open_samples:
                closed, under = False, 0
        return (closed, under, named), (int(r["ord"]), closed)

    kind = samples.schema[key].dataType.simpleString()
    samples = _named(samples, thresholds)
    return stateful(samples, key, "ord", "closed boolean, under long, thresholds string", f"{key} {kind}, ord long, closed boolean", (False, 0, ""), step)


def reachability(pings: DataFrame) -> DataFrame:
    """First failure since the last answer and the next ping after each ping (runner, ord, t_ms, ok)."""

    def step(s, r):
        since, last_ok = s
        t = int(r["t_ms"])
        if r["ok"]:
            since, last_ok = -1, t
        elif since < 0:
            since = t
        nxt = None if since < 0 else t + min(tel.MAX_PING_MS, max(tel.MIN_PING_MS, t - since))
        return (since, last_ok), (int(r["ord"]), bool(r["ok"]), None if since < 0 else since, None if last_ok < 0 else last_ok, nxt)

    return stateful(pings, "runner", "ord", "since long, last_ok long",
                    "runner string, ord long, ok boolean, unreachable_since long, last_ok_ms long, next_ping_ms long", (-1, -1), step)


def compact_decisions(decisions: DataFrame) -> DataFrame:
    """Decision lines worth writing (candidate, ord, t_ms, signature, admit)."""

    def step(s, r):
        signature, written = s
        t = int(r["t_ms"])
        if signature == r["signature"] and t - written < tel.LOG_REFRESH_MS:
            return s, None
        return ("" if r["admit"] else r["signature"], t), (int(r["ord"]), t, r["signature"])

    return stateful(decisions, "candidate", "ord", "signature string, written long", "candidate string, ord long, t_ms long, signature string", ("", 0), step)


def starvation(polls: DataFrame, sample_ms: int = 5_000) -> DataFrame:
    """Start, last refresh and length of the current starvation after each starved poll (host, ord, t_ms, denied, external_busy, budget)."""
    stale = max(30_000, 6 * sample_ms)

    def step(s, r):
        since, last = s
        t = int(r["t_ms"])
        if not (r["denied"] and r["budget"] > 0 and _num(r["external_busy"]) and r["external_busy"] >= tel.STARVED_SHARE * r["budget"]):
            return (-1, -1), None
        if since < 0 or t - last > stale:
            since, last = t, t
        elif t - last >= sample_ms:
            last = t
        return (since, last), (int(r["ord"]), since, last)

    return stateful(polls, "host", "ord", "since long, last long", "host long, ord long, since_ms long, last_ms long", (-1, -1), step)


def wait_since(polls: DataFrame) -> DataFrame:
    """Start of the current wait after each poll (ticket, ord, t_ms, reason, cause, ended)."""

    def step(s, r):
        reason, cause, since = s
        if r["ended"]:
            return ("", "", -1), None
        c = r["cause"] or ""
        if since < 0 or reason != r["reason"] or cause != c:
            since = int(r["t_ms"])
        return (r["reason"], c, since), (int(r["ord"]), r["reason"], since)

    return stateful(polls.select("ticket", "ord", "t_ms", "reason", "cause", "ended"), "ticket", "ord", "reason string, cause string, since long", "ticket long, ord long, reason string, since_ms long", ("", "", -1), step)


def silence_flags(
    readings: DataFrame, *, max_gap_ms: float, below_fraction: float, hung_cores: float, hung_after_ms: float, idle_after_ms: float,
) -> DataFrame:
    """Silent, idle and hung flags after each reading (lease_id, ord, t_ms, cores, interval_cores, wrote_output, charged_cores, started_ms)."""

    def step(s, r):
        idle, hung, last, output = s
        t, x = int(r["t_ms"]), r["interval_cores"]
        known = _num(r["cores"]) and _num(x) and x >= 0
        whole = 0 < t - last <= max_gap_ms

        def streak(since: int, low: bool) -> int:
            return (since if since >= 0 and whole else t) if low else -1

        idle = streak(idle, known and _num(r["charged_cores"]) and x < below_fraction * r["charged_cores"])
        hung = streak(hung, known and x < hung_cores)
        output = t if r["wrote_output"] is True or r["wrote_output"] == 1 else output
        silent = max(0, t - (output if output >= 0 else int(r["started_ms"])))
        idle_ms, hung_ms = t - idle if idle >= 0 else 0, t - hung if hung >= 0 else 0
        return (idle, hung, t, output), (int(r["ord"]), silent, idle_ms, idle_ms >= idle_after_ms, silent >= hung_after_ms, silent >= hung_after_ms and hung_ms >= hung_after_ms)

    kind = readings.schema["lease_id"].dataType.simpleString()
    used = readings.select("lease_id", "ord", "t_ms", "cores", "interval_cores", "wrote_output", "charged_cores", "started_ms")
    return stateful(used, "lease_id", "ord", "idle long, hung long, last long, output long",
                    f"lease_id {kind}, ord long, silent_ms long, idle_ms long, idle boolean, silent boolean, hung boolean", (-1, -1, -1, -1), step)


def busy_core_counters(samples: DataFrame, reuse_window_ms: float) -> DataFrame:
    """Busy cores after each counter reading (host, ord, t_ms, totals array, idles array), by the rules of the batch form."""

    def step(s, r):
        held, cur = json.loads(s[0]), {"t": int(r["t_ms"]), "total": [float(x) for x in r["totals"]], "idle": [float(x) for x in r["idles"]]}
        prev, busy, valid, unchanged = held.get("prev"), None, False, False
        if prev and len(prev["total"]) == len(cur["total"]) and 0 <= cur["t"] - prev["t"] <= tel.MAX_SAMPLE_GAP_MS:
            moved = [(a - c, b - d) for a, b, c, d in zip(cur["total"], cur["idle"], prev["total"], prev["idle"], strict=True) if a - c > 0]
            valid = bool(moved)
            busy = sum((dt - di) / dt for dt, di in moved) if valid else None
            unchanged = not valid and cur["total"] == prev["total"] and cur["idle"] == prev["idle"]
        if not unchanged:
            held["last"] = {"busy": busy, "t": cur["t"]}
        last = held.get("last")
        reused = bool(unchanged and last and last["busy"] is not None and 0 <= cur["t"] - last["t"] < reuse_window_ms)
        held["prev"] = cur
        return (json.dumps(held),), (int(r["ord"]), last["busy"] if reused else busy, not valid and not reused, reused)

    kind = samples.schema["host"].dataType.simpleString()
    return stateful(samples, "host", "ord", "held string", f"host {kind}, ord long, busy_cores double, stale boolean, reused boolean", ("{}",), step)


def device_hysteresis(samples: DataFrame, open_samples: int, thresholds: str | None = None) -> DataFrame:
    """Device gate after each sample (host, ord, violation, informative): the reason closes it, informative samples without one open it."""

    def step(s, r):
        closed, good, before, why = s
        named = str(r[thresholds]) if thresholds else ""
        good = 0 if named != before else good
        if isinstance(r["violation"], str):
            closed, good, why = True, 0, r["violation"]
        elif bool(r["informative"]):
            good += 1
            if good >= open_samples:
                closed = False
        return (closed, good, named, why), (int(r["ord"]), closed, why if closed else None)

    kind = samples.schema["host"].dataType.simpleString()
    samples = _named(samples, thresholds)
    return stateful(samples, "host", "ord", "closed boolean, good long, thresholds string, why string", f"host {kind}, ord long, closed boolean, reason string", (False, 0, "", ""), step)


def urgency(forecasts: DataFrame) -> DataFrame:
    """Deadline urgency after each forecast cycle, by the rules of the batch form (group_id, cycle, deadline_ms, now_ms, eta_p90_s, low_confidence)."""

    def step(s, r):
        known, on, left, level = s
        on, left = switch((on, left), r["slack"], r["s0"])
        level = follow(level if known else r["start"], r["raw"] if on else 0.0)
        return (True, on, left, level), (int(r["cycle"]), level, on)

    kind = forecasts.schema["group_id"].dataType.simpleString()
    out = stateful(forecast_cycles(forecasts), "g", "cycle", "known boolean, on boolean, left int, level double", f"g {kind}, cycle long, urgency double, boosted boolean", (False, False, 0, 0.0), step)
    return out.withColumnRenamed("g", "group_id")
