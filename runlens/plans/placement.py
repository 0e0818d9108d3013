"""Speed ratios, per-runner run estimates, predicted-finish ranking, runner schedules and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import commands, runs
from runlens.functions.queue import version_below
from runlens.operators.primitives import best_tier, broadcast_if_small, newest, order_stats
from runlens.session import cut_lineage

# Fixed values.
MIN_PAIRS = 5
MIN_EXACT_RUNS = 2
TIER_MIN = {"exact": 2, "class": 2, "repo-lane": 3}
MAX_CLASS_VALUES = 8
NEWEST_RUNS = 20
OVERHEAD_MS = 60_000.0
WAIT_RESIDUAL = 0.5
QUEUED_GAIN = 0.75
DAY = 86_400_000
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def _pairing() -> Column:
    return F.when(F.coalesce("command", F.lit("")) != "", commands.pairing_command(F.col("command"))).otherwise(F.col("cmdFingerprint"))


def speed_pairs(history: DataFrame) -> DataFrame:
    """Commands that succeeded both locally and on a runner: run counts, local median, remote over local ratio."""
    side = F.when(runs.is_local(), F.lit("")).when(F.col("executor") == "remote", F.col("runner"))
    rows = history.filter(runs.classify()["kind"] == "completed").select(
        side.alias("side"), "repo", "lane", _pairing().alias("pair"), (runs.wall_seconds() * 1000).alias("ms")
    ).filter(F.col("side").isNotNull() & F.col("pair").isNotNull())
    med = order_stats(rows, ["side", "repo", "lane", "pair"], {"ms": F.col("ms")}, median=True)
    local = med.filter("side = ''").select("repo", "lane", "pair", F.col("ms_n").alias("local_runs"), F.col("ms_median").alias("local_median_ms"))
    remote = med.filter("side <> ''").select(F.col("side").alias("runner"), "repo", "lane", "pair", F.col("ms_n").alias("remote_runs"), F.col("ms_median").alias("remote_median_ms"))
    return remote.join(local, ["repo", "lane", "pair"]).select(
        "runner", "repo", "lane", "pair", "local_runs", "remote_runs", "local_median_ms", (F.col("remote_median_ms") / F.col("local_median_ms")).alias("ratio"))


def _tier(pairs: DataFrame, keys: list[str], tier: str) -> DataFrame:
    med = order_stats(pairs, keys, {"r": F.col("ratio")}, median=True).filter(F.col("r_n") >= MIN_PAIRS)
    return med.select(*keys, F.struct(F.col("r_median").alias("ratio"), F.lit(tier).alias("tier"), F.col("r_n").alias("pairs")).alias("ev"))


def size_band(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs within a factor two of a size: an equi-join on powers of two, then the exact bounds.

    `sizes` holds distinct (runner, estimate_ms), so jobs of one size share the work.
    """
    def octave(x: Column) -> Column:
        return F.floor(F.log2(x)).cast("long")

    near = sizes.withColumn("oct", F.explode(F.sequence(octave(F.col("estimate_ms")) - 2, octave(F.col("estimate_ms")) + 2)))
    band = pairs.select("runner", octave(F.col("local_median_ms")).alias("oct"), "local_median_ms", "ratio")
    hit = band.join(near, ["runner", "oct"]).filter(F.col("local_median_ms").between(F.col("estimate_ms") / 2, F.col("estimate_ms") * 2))
    return _tier(hit, ["runner", "estimate_ms"], "size-band")


def speed_ratios(jobs: DataFrame, runners: DataFrame, pairs: DataFrame) -> DataFrame:
    """Slowdown of each runner for each job (job, repo, lane, command, estimate_ms): most specific tier with evidence.

    `runners` (runner, speed_ratio) is the configured runner list, a small dimension.
    """
    # five reads of the pairs below: compute them once
    pairs = cut_lineage(pairs, "speed-pairs")
    base = jobs.withColumn("pair", commands.pairing_command(F.col("command"))).join(broadcast_if_small(runners))
    exact = pairs.filter((F.col("local_runs") >= MIN_EXACT_RUNS) & (F.col("remote_runs") >= MIN_EXACT_RUNS)).select(
        "runner", "repo", "lane", "pair", F.struct(F.col("ratio").alias("ratio"), F.lit("exact").alias("tier"), F.lit(1).cast("long").alias("pairs")).alias("ev"))
    sizes = base.select("runner", "estimate_ms").distinct()
    found = best_tier(base, [
        (exact, ["runner", "repo", "lane", "pair"]), (_tier(pairs, ["runner", "repo", "lane"], "repo-lane"), ["runner", "repo", "lane"]),
        (size_band(pairs, sizes), ["runner", "estimate_ms"]), (_tier(pairs, ["runner"], "global"), ["runner"])], "ev", "ev")
    configured = F.when(F.col("speed_ratio") >= 1, F.col("speed_ratio")).otherwise(1.0)
    return found.select("job", "runner", F.coalesce("ev.ratio", configured).alias("ratio"), F.coalesce("ev.tier", F.lit("configured")).alias("tier"),
                        F.coalesce("ev.pairs", F.lit(0)).alias("pairs"))


# ---- run estimates ------------------------------------------------------------------------------------------------

def class_names(history: DataFrame) -> DataFrame:
    """Assignment names per lane that take few distinct values."""
    pairs = history.select("repo", "lane", F.explode(commands.stable_assignments(F.col("command"))).alias("p")).select("repo", "lane", "p.name", "p.value")
    few = pairs.distinct().groupBy("repo", "lane", "name").agg(F.count("*").alias("vals")).filter(F.col("vals") <= MAX_CLASS_VALUES)
    return few.select("repo", "lane", "name", "vals")


def _tier_keys(rows: DataFrame, names: DataFrame) -> DataFrame:
    per_lane = names.groupBy("repo", "lane").agg(F.array_sort(F.collect_list("name")).alias("names"))
    keyed = rows.join(per_lane, ["repo", "lane"], "left")
    cls = commands.class_key(commands.stable_assignments(F.col("command")), F.coalesce("names", F.array().cast("array<string>")))
    named = F.coalesce(F.trim("command"), F.lit("")) != ""
    return keyed.withColumn("tier_keys", F.array(
        F.struct(F.lit("exact").alias("tier"), F.when(named, commands.pairing_command(F.col("command"))).alias("tkey")),
        F.struct(F.lit("class").alias("tier"), F.when(named, cls).alias("tkey")),
        F.struct(F.lit("repo-lane").alias("tier"), F.lit("").alias("tkey")))).drop("names")


def run_evidence(history: DataFrame, names: DataFrame) -> DataFrame:
    """Per (tier, repo, lane, key, runner): matching successful runs and the median of the newest."""
    ok = history.filter((F.col("executor") == "remote") & F.col("runner").isNotNull() & (F.col("exit") == 0) & (F.col("runMs") > 0))
    rows = _tier_keys(ok.select("repo", "lane", "command", "runner", "runMs", F.coalesce("startedAt", F.lit(0.0)).alias("t"), "ord"), names)
    rows = rows.select("repo", "lane", "runner", "runMs", "t", "ord", F.explode("tier_keys").alias("k")).select("*", "k.tier", "k.tkey").drop("k").filter("tkey IS NOT NULL")
    keys = ["tier", "repo", "lane", "tkey", "runner"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("matching"))
    med = newest(rows, keys, [F.col("t").desc(), F.col("ord").desc()], NEWEST_RUNS).groupBy(*keys).agg(F.median("runMs").alias("ms"), F.count("*").alias("n"))
    need = F.when(F.col("tier") == "repo-lane", TIER_MIN["repo-lane"]).otherwise(TIER_MIN["exact"])
    return counts.join(med, keys).filter(F.col("matching") >= need)


def run_estimates(jobs: DataFrame, runners: DataFrame, history: DataFrame, common_tier: bool = True) -> DataFrame:
    """Expected run per (job, runner): own evidence, else the busiest other runner's scaled by speed factors.

    With `common_tier` every candidate is read at the most specific tier all of them reach. `runners` is (runner,
    config_order, speed_factor), a small dimension, so evidence is kept as one short array per tier key.
    """
    names = class_names(history)
    speed = runners.select("runner", F.col("config_order").alias("o"), F.when(F.col("speed_factor") > 0, F.col("speed_factor")).otherwise(1.0).alias("speed"))
    ev = run_evidence(history, names).join(speed, "runner").groupBy("tier", "repo", "lane", "tkey").agg(
        F.collect_list(F.struct("matching", (-F.col("o")).alias("neg"), "runner", "ms", "n", "speed")).alias("ev"))
    base = _tier_keys(jobs.select("job", "repo", "lane", "command"), names).select("job", "repo", "lane", F.posexplode("tier_keys").alias("tier_no", "k"))
    base = base.select("job", "repo", "lane", "tier_no", "k.tier", "k.tkey").join(ev, ["tier", "repo", "lane", "tkey"], "left")
    cand = base.join(broadcast_if_small(speed.withColumnRenamed("runner", "cand").withColumnRenamed("speed", "cand_speed").drop("o")))
    own = F.get(F.filter("ev", lambda e: e["runner"] == F.col("cand")), F.lit(0))
    donor = F.array_max(F.filter("ev", lambda e: e["runner"] != F.col("cand")))
    cand = cand.withColumns({"own": own, "donor": donor})

    def hit(e: Column, ms: Column, donor_name: Column) -> Column:
        return F.when(ms > 0, F.struct(F.floor(ms + 0.5).cast("long").alias("ms"), F.col("tier").alias("tier"), e["n"].alias("n"), donor_name.alias("donor")))

    cand = cand.withColumns({
        "own_hit": hit(F.col("own"), F.col("own.ms"), F.lit(None).cast("string")),
        "donor_hit": hit(F.col("donor"), F.col("donor.ms") * F.col("donor.speed") / F.col("cand_speed"), F.col("donor.runner"))})
    cand = cand.select("job", "tier_no", F.col("cand").alias("runner"), "own_hit", "donor_hit", F.coalesce("own_hit", "donor_hit").alias("any_hit"))
    best = cand.groupBy("job", "runner").agg(
        F.min_by("own_hit", F.when(F.col("own_hit").isNotNull(), F.col("tier_no"))).alias("own"),
        F.min_by("donor_hit", F.when(F.col("donor_hit").isNotNull(), F.col("tier_no"))).alias("donor"),
        F.map_from_entries(F.collect_list(F.struct("tier_no", "any_hit"))).alias("by_tier"))
    each = F.coalesce("own", "donor")
    if not common_tier:
        return best.select("job", "runner", each.alias("e")).select("job", "runner", "e.ms", "e.tier", "e.n", "e.donor")
    common = cand.groupBy("job", "tier_no").agg(F.bool_and(F.col("any_hit").isNotNull()).alias("all_have")).filter("all_have").groupBy("job").agg(F.min("tier_no").alias("common"))
    out = best.join(common, "job", "left").select("job", "runner", F.when(F.col("common").isNull(), each).otherwise(F.element_at("by_tier", F.col("common"))).alias("e"))
    return out.select("job", "runner", "e.ms", "e.tier", "e.n", "e.donor")


# ---- finish ranking -----------------------------------------------------------------------------------------------

def finish_ranking(candidates: DataFrame, now: float) -> DataFrame:
    """Rank of each runner per job by predicted finish; candidates that would outlive their window are dropped.

    `candidates`: job, runner, config_order, queued, room, cpu_free, capacity_cpu, need_cpu, speed_factor, closes_at, ms
    (NULL without an estimate). One missing estimate leaves the whole job on the unscored ranking.
    """
    queued = F.when(F.col("queued") > 0, F.col("queued")).otherwise(0)
    idle = F.col("room") & (queued == 0)
    slots = F.when((F.col("capacity_cpu") > 0) & (F.col("need_cpu") > 0), F.greatest(F.lit(1.0), F.floor(F.col("capacity_cpu") / F.col("need_cpu")).cast("double"))).otherwise(1.0)
    wait = F.when(idle, 0.0).otherwise((queued + WAIT_RESIDUAL) * F.col("ms") / slots)
    job = Window.partitionBy("job")
    c = candidates.withColumns({"idle": idle, "wait_ms": wait, "queued": queued, "scored": F.bool_and(F.col("ms").isNotNull()).over(job)})
    work = F.when(F.col("need_cpu") > 0, F.col("need_cpu")).otherwise(1.0)
    rough = (F.col("queued") + 1) * work / F.when(F.col("speed_factor") > 0, F.col("speed_factor")).otherwise(1.0)
    finish = F.when(F.col("scored"), F.col("wait_ms") + F.col("ms") + OVERHEAD_MS)
    drop = F.coalesce(F.col("scored") & (F.lit(now) + F.col("wait_ms") + F.col("ms") > F.col("closes_at")), F.lit(False))
    c = c.withColumns({"finish_ms": finish, "dropped": drop, "rough": rough})
    free = F.coalesce("cpu_free", F.lit(float("-inf"))).desc()
    order = [
        F.col("dropped"), F.col("finish_ms").asc_nulls_last(),
        F.when(F.col("scored"), F.lit(0)).otherwise(F.when(F.col("idle"), 0).otherwise(F.col("queued") + 1)),
        F.when(F.col("scored"), F.lit(0.0)).otherwise(F.col("rough")), F.col("idle").desc(), free, F.col("config_order")]
    ranked = c.withColumn("rank", F.row_number().over(job.orderBy(*order)))
    return ranked.select("job", "runner", "scored", "dropped", "idle", F.when(F.col("scored"), F.col("wait_ms")).alias("wait_ms"), "finish_ms",
                         F.when(~F.col("dropped"), F.col("rank")).alias("rank"))


def local_or_remote(tickets: DataFrame) -> DataFrame:
    """Where a ticket would finish first. `tickets`: ticket, estimate_ms, ahead_ms, slots, waited_ms, admits_now,
    blocked, held_by_key, runner_ratio, remote_finish_ms, position, source_estimate_ms."""
    est = F.col("estimate_ms")
    wait = F.greatest((F.col("ahead_ms") + est) / F.greatest(F.lit(1.0), F.col("slots")), F.coalesce("waited_ms", F.lit(0.0)))
    remote = F.coalesce("remote_finish_ms", est * F.col("runner_ratio") + OVERHEAD_MS)
    local = F.when(F.col("admits_now"), 0.0).otherwise(wait) + est
    hidden = ~F.col("admits_now") & (F.col("blocked") | (F.col("held_by_key") & remote.isNotNull()))
    choice = F.when(hidden, F.when(remote.isNull(), "local").otherwise("remote")).when(remote.isNull() | (local <= remote), "local").otherwise("remote")
    move = F.coalesce(F.col("remote_finish_ms") < QUEUED_GAIN * F.col("position") * F.col("source_estimate_ms"), F.lit(True))
    r = lambda x: F.floor(x + 0.5).cast("long")
    return tickets.select("ticket", choice.alias("choice"), F.when(~hidden, r(local)).alias("local_finish_ms"), r(remote).alias("remote_finish_ms"), move.alias("move_allowed"))


def work_ahead(queue: DataFrame, keys: list[str], slice_col: str, order: list[str], estimate: str) -> DataFrame:
    """Estimated work queued ahead of each row, safe for a long queue."""
    from runlens.operators.sliced import running

    run = running(queue, keys, slice_col, order, sums={"upto_": F.col(estimate)})
    return run.withColumn("ahead_ms", F.col("upto_") - F.col(estimate)).drop("upto_")


# ---- schedules, readiness, fit ------------------------------------------------------------------------------------

def availability(instants: DataFrame, schedules: DataFrame) -> DataFrame:
    """Per (instant, runner): inside a weekly local-time window, and the latest end of the windows around it.

    `instants` has t_ms; `schedules` (runner, timezone, days, from_min, to_min) is a small dimension, one row per window.
    A window whose end is not after its start runs past midnight and belongs to the day it starts on.
    """
    def wall(ms: Column, tz: Column) -> Column:
        return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), tz))

    def instant(wall_ms: Column, tz: Column) -> Column:
        return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall_ms), tz))

    base = instants.select("t_ms").distinct().join(broadcast_if_small(schedules))
    today = F.floor(wall(F.col("t_ms"), F.col("timezone")) / DAY).cast("long")
    base = base.withColumn("day", F.explode(F.array(today - 1, today)))
    name = F.element_at(F.array(*[F.lit(d) for d in DAYS]), (F.pmod(F.col("day") + 3, F.lit(7)) + 1).cast("int"))
    start = instant(F.col("day") * DAY + F.col("from_min") * 60_000, F.col("timezone"))
    length = F.when(F.col("to_min") > F.col("from_min"), F.col("to_min")).otherwise(F.col("to_min") + 1440)
    end = instant(F.col("day") * DAY + length * 60_000, F.col("timezone"))
    inside = F.array_contains("days", name) & (start <= F.col("t_ms")) & (F.col("t_ms") < end)
    return base.groupBy("t_ms", "runner").agg(F.max(F.when(inside, end)).alias("closes_at")).withColumn("available", F.col("closes_at").isNotNull())


def closes_before_finish(predictions: DataFrame, windows: DataFrame) -> DataFrame:
    """Predictions (t_ms, runner, wait_ms, run_ms) that would run past the end of the runner's window."""
    return predictions.join(windows, ["t_ms", "runner"]).withColumn(
        "closes_first", F.coalesce(F.col("t_ms") + F.col("wait_ms") + F.col("run_ms") > F.col("closes_at"), F.lit(False)))


def readiness_gaps(needs: DataFrame, probes: DataFrame) -> DataFrame:
    """First unmet need per (need set, runner), in check order: tools, tags, version floor, zero-length files.

    `needs` (tools, tags, version_floor) are distinct need sets; `probes` (runner, tools, tags, version, zero_length) is a
    small dimension. An unreported list counts as all missing; an empty need is met.
    """
    j = needs.join(broadcast_if_small(probes.select("runner", F.col("tools").alias("has_tools"), F.col("tags").alias("has_tags"), "version", "zero_length")))

    def missing(need: str, has: str) -> Column:
        return F.array_sort(F.array_except(need, F.coalesce(has, F.array().cast("array<string>"))))

    checks = [
        ("tools", missing("tools", "has_tools")), ("tags", missing("tags", "has_tags")),
        ("version", F.when(F.col("version_floor").isNotNull() & version_below(F.col("version"), F.col("version_floor")), F.array(F.col("version_floor"))).otherwise(F.array().cast("array<string>"))),
        ("integrity", F.coalesce("zero_length", F.array().cast("array<string>")))]
    gap = F.lit(None).cast("struct<check:string,missing:array<string>>")
    for name, miss in reversed(checks):
        gap = F.when(F.size(miss) > 0, F.struct(F.lit(name).alias("check"), miss.alias("missing"))).otherwise(gap)
    return j.withColumn("gap", gap).select(*needs.columns, "runner", F.col("gap.check").alias("check"), F.col("gap.missing").alias("missing"))


def runner_fit(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """Never-fits, room-now, free cores and slots per (distinct claim, runner); an unmeasured figure never excludes.

    `claims`: weight, cpu, min_cpu, memory; `probes` (small): runner, cap_weight, cap_cpu, cap_memory, memory_reserve,
    memory_admissible, elastic, reserved_cpu, headroom_cpu, headroom_undiscounted, headroom_memory, unenforced.
    """
    j = claims.join(broadcast_if_small(probes))
    need = F.when(F.col("elastic") & F.col("min_cpu").isNotNull(), F.col("min_cpu")).otherwise(F.col("cpu"))
    no = F.lit(False)
    never = (
        F.coalesce(F.col("weight") > F.col("cap_weight"), no) | F.coalesce(need > F.col("cap_cpu"), no)
        | F.coalesce(F.col("memory") + F.col("memory_reserve") > F.col("cap_memory"), no) | F.coalesce(F.col("memory") > F.col("memory_admissible"), no))
    discounted = F.when(F.col("headroom_cpu").isNotNull() & F.col("unenforced") & F.col("headroom_undiscounted").isNotNull(), F.col("headroom_undiscounted")).otherwise(F.col("headroom_cpu"))
    free = F.coalesce(discounted, F.when((F.col("cap_cpu") - F.col("reserved_cpu")).isNotNull(), F.greatest(F.lit(0.0), F.col("cap_cpu") - F.col("reserved_cpu"))))
    why = (F.when(F.coalesce(need > free, no), "cpu").when(F.coalesce(F.col("memory") > F.col("headroom_memory"), no), "memory"))
    slots = F.when((F.col("cap_cpu") > 0) & (F.col("cpu") > 0), F.greatest(F.lit(1).cast("long"), F.floor(F.col("cap_cpu") / F.col("cpu")))).otherwise(F.lit(1).cast("long"))
    return j.select(*claims.columns, "runner", never.alias("never_fits"), why.isNull().alias("room"), why.alias("no_room_reason"), free.alias("cpu_free"), slots.alias("slots"))
