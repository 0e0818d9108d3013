"""Run-history reports: cost, losses, phases, placement accuracy, sizing suggestions, verdict reuse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import runs
from runlens.operators.primitives import first_by_id, in_window, newest, order_stats, round_to
from runlens.operators.sliced import running, slice_of

MIN = 60_000.0
HOUR = 3_600_000.0
DAY = 86_400_000.0
P5090 = {"p50": 0.5, "p90": 0.9}
# Fixed values.
PHASES = ["uploadMs", "queuedMs", "snapshotMs", "depsMs", "setupMs", "commandMs", "artifactsMs", "artifactReturnMs"]
OVERHEAD = ["snapshotMs", "depsMs", "setupMs"]
RUN = ["commandMs", "artifactsMs"]
LOST_REASONS = ["runner-lost", "runner-offline", "runner-shutdown", "runner-never-started", "never-dispatched"]
FALLBACK_REASONS = ["runner-shutdown", "runner-lost", "runner-offline"]
OVERRUN_FACTOR = 1.25
SHORT_RUN_MS = 120_000.0
MIN_RUNS = 5
JOURNAL_SLICE = 100_000.0


def report_repos(key: Column, repos: list[str]) -> Column:
    """The report repos a history key belongs to, as an array."""
    return F.filter(F.array(*[F.lit(r) for r in repos]), lambda r: runs.repo_matches(key, r))


def _any_repo(key: Column, repos: list[str]) -> Column:
    return F.size(report_repos(key, repos)) > 0


# ---- phases -------------------------------------------------------------------------------------------------------

def _phase_rows(history: DataFrame, repos: list[str], since: float, until: float) -> DataFrame:
    rows = history.filter(
        (F.col("executor") == "remote") & F.col("remotePhasesMs").isNotNull()
        & _any_repo(F.col("repo"), repos) & in_window(F.col("startedAt"), since, until)
    ).select("id", "ord", F.coalesce("runner", F.lit("unknown")).alias("runner"), "remotePhasesMs", "depsCache")
    return first_by_id(rows)


def phases_report(history: DataFrame, repos: list[str], since: float, until: float) -> DataFrame:
    """Count, p50, p90 and maximum of each phase per runner, one row per (runner, phase)."""
    rows = _phase_rows(history, repos, since, until)
    metrics = {p: F.col(f"remotePhasesMs.{p}") for p in PHASES} | {"rows": F.lit(0.0)}
    wide = order_stats(rows, ["runner"], metrics, P5090)
    cells = ", ".join(f"'{p}', {p}_n, {p}_p50, {p}_p90, {p}_max" for p in PHASES)
    return wide.selectExpr("runner", "rows_n AS runs", f"stack({len(PHASES)}, {cells}) AS (phase, n, p50, p90, max)")


def phase_overhead(history: DataFrame, repos: list[str], since: float, until: float) -> DataFrame:
    """Overhead share per runner (only rows with a command phase) and dependency-cache outcomes."""
    rows = _phase_rows(history, repos, since, until)

    def total(names: list[str]) -> Column:
        out = F.lit(0.0)
        for n in names:
            out = out + F.coalesce(F.col(f"remotePhasesMs.{n}"), F.lit(0.0))
        return out

    timed = F.col("remotePhasesMs.commandMs").isNotNull()
    shares = rows.groupBy("runner").agg(
        F.count("*").alias("runs"),
        F.sum(F.when(timed, total(OVERHEAD))).alias("over"), F.sum(F.when(timed, total(OVERHEAD + RUN))).alias("all"))
    deps = (
        rows.filter(F.coalesce("depsCache", F.lit("")) != "").groupBy("runner", "depsCache").agg(F.count("*").alias("n"))
        .groupBy("runner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("depsCache", "n")))).alias("depsCache"))
    )
    share = F.when(F.col("all") > 0, F.col("over") / F.col("all"))
    return shares.join(deps, "runner", "left").select("runner", "runs", share.alias("overhead_share"), "depsCache")


# ---- losses -------------------------------------------------------------------------------------------------------

def losses_report(rows: DataFrame, repos: list[str], since: float, until: float) -> DataFrame:
    """Losses, re-dispatches and local fallbacks per runner and reason, with hours; `runner` NULL is the total.

    Diagnostics take part and nothing is deduplicated. Hours are rounded only after summing.
    """
    base = rows.filter(in_window(F.col("startedAt"), since, until))
    if repos:
        base = base.filter(_any_repo(F.col("repo"), repos))
    lost = F.coalesce((F.col("executor") == "remote") & F.col("reason").isin(LOST_REASONS), F.lit(False))
    spent = F.when(F.col("endedAt") >= F.col("startedAt"), F.col("endedAt") - F.col("startedAt")).otherwise(F.lit(0.0))
    name = F.coalesce("runner", F.lit("unknown"))
    fell = F.coalesce(
        (F.col("executor") == "local") & F.col("localReason").isin([f"fallback:{r}" for r in FALLBACK_REASONS]), F.lit(False))

    def leg(kind: str, runner: Column, reason: Column, ms: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), runner.alias("runner"), reason.alias("reason"), ms.alias("ms"))

    none = F.array().cast("array<struct<kind:string,runner:string,reason:string,ms:double>>")
    moved = F.coalesce(F.col("redispatchReason") != "", F.lit(False)) & F.col("redispatchedFrom").isNotNull()
    legs = F.concat(
        F.when(lost, F.array(leg("lost", name, F.col("reason"), spent))).otherwise(none),
        F.when(moved, F.transform("redispatchedFrom", lambda r: leg(
            "redispatched", F.coalesce(r, F.lit("unknown")), F.col("redispatchReason"), F.lit(0.0)))).otherwise(none),
        F.when(fell, F.array(leg("fallback", name, F.expr("substring(localReason, 10)"), F.lit(0.0)))).otherwise(none))
    events = base.select(F.explode(legs).alias("e")).select("e.*")
    counted = events.groupBy("runner", "kind", "reason").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    per = counted.select("runner", "kind", "reason", "n", round_to(F.col("ms") / HOUR, 1).alias("lane_hours"))
    total = counted.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("ms").alias("ms")).select(
        F.lit(None).cast("string").alias("runner"), "kind", F.lit(None).cast("string").alias("reason"), "n",
        round_to(F.col("ms") / HOUR, 1).alias("lane_hours"))
    return per.unionByName(total)


# ---- placement accuracy -------------------------------------------------------------------------------------------

def placement_report(history: DataFrame, since: float, until: float) -> DataFrame:
    """Predicted against actual wait and run per runner and overall (`runner` NULL)."""
    rows = first_by_id(history.filter(
        (F.col("executor") == "remote") & F.col("placement").isNotNull()
        & F.col("placement.runner").eqNullSafe(F.col("runner")) & in_window(F.col("startedAt"), since, until)
    ).select("id", "ord", "runner", "exit", "runMs", F.col("placement.predictedWaitMs").alias("pw"),
             F.col("placement.predictedRunMs").alias("pr"), F.col("remotePhasesMs.queuedMs").alias("aw")))
    green = F.coalesce(F.col("exit") == 0, F.lit(False))
    wait_ok = (F.col("pw") >= 0) & (F.col("aw") >= 0)
    run_ok = green & (F.col("pr") >= 0) & (F.col("runMs") >= 0)
    wr = F.when(wait_ok, runs.prediction_ratio(F.col("pw"), F.col("aw")))
    rr = F.when(run_ok, runs.prediction_ratio(F.col("pr"), F.col("runMs")))
    scored = rows.select(
        F.explode(F.array(F.coalesce("runner", F.lit("unknown")), F.lit(None).cast("string"))).alias("runner"), green.alias("green"),
        F.when(wait_ok, F.col("pw")).alias("wait_pred"), F.when(wait_ok, F.col("aw")).alias("wait_act"), wr.alias("wait_ratio"),
        F.when(run_ok, F.col("pr")).alias("run_pred"), F.when(run_ok, F.col("runMs")).alias("run_act"), rr.alias("run_ratio"))
    names = ["wait_pred", "wait_act", "wait_ratio", "run_pred", "run_act", "run_ratio"]
    stats = order_stats(scored, ["runner"], {m: F.col(m) for m in names}, {"p50": 0.5})
    counts = scored.groupBy("runner").agg(
        F.count("*").alias("placements"), F.count_if(~F.col("green")).alias("non_green"),
        *[F.count_if(F.col(f"{s}_ratio") > 2).alias(f"{s}_over2x") for s in ("wait", "run")],
        *[F.count_if(F.col(f"{s}_ratio") < 0.5).alias(f"{s}_under2x") for s in ("wait", "run")])
    stats = stats.withColumnRenamed("runner", "s_runner")
    joined = counts.join(stats, counts["runner"].eqNullSafe(stats["s_runner"]), "left")
    return joined.select(
        "runner", "placements", "non_green", F.coalesce("wait_ratio_n", F.lit(0)).alias("wait_n"), F.coalesce("run_ratio_n", F.lit(0)).alias("run_n"),
        *[F.col(f"{m}_p50") for m in names], "wait_over2x", "wait_under2x", "run_over2x", "run_under2x")


# ---- cost ---------------------------------------------------------------------------------------------------------

@dataclass
class JournalFacts:
    """What the train journal says per repo: lanes it started, first enqueues, landings."""

    lanes: DataFrame
    first_enqueue: DataFrame
    landed: DataFrame


def journal_facts(journal: DataFrame, until: float, ord_slice: float = JOURNAL_SLICE) -> JournalFacts:
    events = journal.filter(F.col("t_ms") < until).withColumn("s_", slice_of(F.col("ord"), ord_slice))
    master = F.startswith(F.coalesce("run_id", F.lit("")), F.lit("master-"))
    lanes = (
        events.filter("event = 'lane-start'").groupBy("repo", F.col("lane_id").alias("lane_key"))
        .agg(F.max(master).alias("is_master"), F.max(~master).alias("is_train"))
    )
    # a landing closes the latest earlier batch of its run (as-of)
    built = F.when(F.col("event") == "batch-built", F.coalesce("prs", F.array().cast(events.schema["prs"].dataType)))
    asof = running(
        events.filter(F.col("event").isin("batch-built", "landed")).select("repo", "run_id", "s_", "ord", "t_ms", "event", built.alias("built")),
        ["repo", "run_id"], "s_", ["ord"], lasts={"batch": F.col("built")})
    landed = (
        asof.filter("event = 'landed'").select("repo", "ord", "t_ms", F.explode("batch").alias("pr"))
        .groupBy("repo", "pr").agg(F.min_by("t_ms", "ord").alias("landed_ms"), F.min("ord").alias("landed_ord"))
    )
    # a removal before the landing restarts the wait
    removals = (
        events.filter(F.col("event").isin("remove", "drop")).select("repo", "pr", "ord")
        .join(landed, ["repo", "pr"], "left").filter(F.col("landed_ord").isNull() | (F.col("ord") < F.col("landed_ord")))
        .groupBy("repo", "pr").agg(F.max("ord").alias("removed_ord"))
    )
    first = (
        events.filter("event = 'enqueue'").select("repo", "pr", "ord", "t_ms").join(removals, ["repo", "pr"], "left")
        .filter(F.col("removed_ord").isNull() | (F.col("ord") > F.col("removed_ord")))
        .groupBy("repo", "pr").agg(F.min_by("t_ms", "ord").alias("enqueued_ms"))
    )
    return JournalFacts(lanes, first, landed)


def reconcile_prs(prs: DataFrame, landed: DataFrame, since: float, until: float) -> DataFrame:
    """One row per landed PR in the window: journal, merged and train-landed times and the one that counts."""
    inside = in_window(F.col("merged_ms"), since, until)
    train = ~inside & F.col("merged_ms").isNull() & F.array_contains("labels", "train-landed") & in_window(F.col("closed_ms"), since, until)
    gh = prs.groupBy("repo", F.col("number").alias("pr")).agg(
        F.max(F.when(inside, F.col("merged_ms"))).alias("merged_ms"), F.max(F.when(train, F.col("closed_ms"))).alias("train_ms"))
    gh = gh.filter(F.col("merged_ms").isNotNull() | F.col("train_ms").isNotNull())
    journal = landed.filter(in_window(F.col("landed_ms"), since, until)).select("repo", "pr", F.col("landed_ms").alias("journal_ms"))
    return journal.join(gh, ["repo", "pr"], "full").withColumn("at_ms", F.coalesce("journal_ms", "merged_ms", "train_ms"))


def pr_counts(union: DataFrame) -> DataFrame:
    gh = F.col("merged_ms").isNotNull() | F.col("train_ms").isNotNull()
    j = F.col("journal_ms").isNotNull()
    weekend = runs.is_weekend(F.col("at_ms"))
    return union.groupBy("repo").agg(
        F.count_if(F.col("merged_ms").isNotNull()).alias("github_merged"), F.count_if(F.col("train_ms").isNotNull()).alias("github_train_landed"),
        F.count_if(j).alias("journal_landed"), F.count("*").alias("union"), F.count_if(j & ~gh).alias("only_journal"),
        F.count_if(gh & ~j).alias("only_github"), F.count_if(~weekend).alias("landed_weekday"), F.count_if(weekend).alias("landed_weekend"))


def spend_rows(history: DataFrame, lanes: DataFrame, repos: list[str], since: float, until: float) -> DataFrame:
    """Deduplicated window rows with their spend class (master lanes win over train lanes)."""
    rows = history.filter(F.col("endedAt").isNotNull() & in_window(F.col("startedAt"), since, until)).select(
        "id", "ord", F.explode(report_repos(F.col("repo"), repos)).alias("repo"), "lane", "executor", "runner", "exit", "waitedMs", "cpuSeconds",
        runs.run_ms(F.col("runMs"), F.col("startedAt"), F.col("endedAt")).alias("run_ms"),
        runs.reserved_cores(F.col("grantedCpuCores"), F.col("resources.cpuCores"), F.col("weight")).alias("cores"),
        F.coalesce("id", F.concat(F.lit("\x00"), F.col("ord").cast("string"))).alias("lane_key"))
    rows = first_by_id(rows.withColumn("rid", F.when(F.coalesce("id", F.lit("")) != "", F.concat("repo", F.lit("\x00"), "id"))), "rid")
    lane = F.coalesce("lane", F.lit(""))
    cls = (
        F.when(F.coalesce("is_master", F.lit(False)), "master-verify")
        .when(F.coalesce("is_train", F.lit(False)) | (lane == "train"), "train-batch")
        .when(lane == "prepush", "gate").otherwise("ad-hoc"))
    return rows.join(lanes, ["repo", "lane_key"], "left").withColumn("cls", cls)


SPEND = ["runs", "failed", "wall_min", "wait_min", "reserved_core_min", "cpu_seconds", "cpu_runs"]


def cost_spend(rows: DataFrame, repos: list[str]) -> DataFrame:
    """Spend per repo and class with a TOTAL row; every class is present."""
    grouped = rows.groupBy("repo", "cls").agg(
        F.count("*").alias("runs"), F.count_if(F.coalesce(F.col("exit") != 0, F.lit(False))).alias("failed"),
        (F.sum("run_ms") / MIN).alias("wall_min"), (F.sum(F.coalesce("waitedMs", F.lit(0.0))) / MIN).alias("wait_min"),
        (F.sum(F.col("run_ms") * F.col("cores")) / MIN).alias("reserved_core_min"),
        F.sum(F.coalesce("cpuSeconds", F.lit(0.0))).alias("cpu_seconds"), F.count("cpuSeconds").alias("cpu_runs"))
    spark = rows.sparkSession
    cells = [F.struct(F.lit(r).alias("repo"), F.lit(c).alias("cls")) for r in repos for c in runs.SPEND_CLASSES]
    frame = spark.range(1).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    full = frame.join(grouped, ["repo", "cls"], "left").na.fill(0, SPEND)
    total = full.groupBy("repo").agg(*[F.sum(c).alias(c) for c in SPEND]).withColumn("cls", F.lit("TOTAL"))
    return full.unionByName(total)


def cost_per_pr(spend: DataFrame, counts: DataFrame) -> DataFrame:
    joined = spend.join(counts.select("repo", F.nullif(F.col("union"), F.lit(0)).alias("prs")), "repo", "left")
    return joined.select("repo", "cls", *[(F.col(c) / F.col("prs")).alias(c) for c in ["runs", "wall_min", "wait_min", "reserved_core_min", "cpu_seconds"]])


def executor_mix(rows: DataFrame) -> DataFrame:
    name = F.when(F.coalesce(F.col("executor") == "remote", F.lit(False)), F.concat(F.lit("remote:"), F.coalesce("runner", F.lit("?")))).otherwise("local")
    return rows.groupBy("repo", name.alias("executor")).agg(
        F.count("*").alias("runs"), (F.sum(F.col("run_ms") * F.col("cores")) / MIN).alias("reserved_core_min"))


def pr_latency(facts: JournalFacts, union: DataFrame) -> DataFrame:
    """First enqueue to landing, in minutes, of PRs that landed in the window."""
    waits = (
        facts.landed.join(union.select("repo", "pr"), ["repo", "pr"]).join(facts.first_enqueue, ["repo", "pr"])
        .select("repo", ((F.col("landed_ms") - F.col("enqueued_ms")) / MIN).alias("wait"))
    )
    stats = order_stats(waits, ["repo"], {"latency": F.col("wait")}, P5090)
    n = union.groupBy("repo").agg(F.count("*").alias("prs"))
    return n.join(stats, "repo", "left").select(
        "repo", F.coalesce("latency_n", F.lit(0)).alias("n"), F.col("latency_p50").alias("p50"), F.col("latency_p90").alias("p90"),
        F.col("latency_max").alias("max"), (F.col("prs") - F.coalesce("latency_n", F.lit(0))).alias("prs_without_enqueue"))


def unfinished_prs(facts: JournalFacts, since: float, until: float) -> DataFrame:
    """Enqueued and never landed; those from before the window are only flagged."""
    left = facts.first_enqueue.join(facts.landed, ["repo", "pr"], "left_anti")
    return left.select("repo", "pr", "enqueued_ms", ((F.lit(until) - F.col("enqueued_ms")) / MIN).alias("age_min"),
                       (F.col("enqueued_ms") < since).alias("before_window"))


@dataclass
class CostReport:
    spend: DataFrame
    per_pr: DataFrame
    executors: DataFrame
    counts: DataFrame
    latency: DataFrame
    unfinished: DataFrame


def cost_report(history: DataFrame, journal: DataFrame, prs: DataFrame, repos: list[str], since: float, until: float) -> CostReport:
    wanted = F.col("repo").isin(repos)
    facts = journal_facts(journal.filter(wanted), until)
    union = reconcile_prs(prs.filter(wanted), facts.landed, since, until)
    rows = spend_rows(history, facts.lanes, repos, since, until)
    spend, counts = cost_spend(rows, repos), pr_counts(union)
    return CostReport(spend, cost_per_pr(spend, counts), executor_mix(rows), counts, pr_latency(facts, union), unfinished_prs(facts, since, until))


# ---- sizing suggestions -------------------------------------------------------------------------------------------

def _observed_rows(history: DataFrame, now: float, days: float) -> DataFrame:
    since = now - days * DAY
    return history.filter(
        (F.coalesce("lane", F.lit("")) != "") & (F.col("endedAt").isNull() | (F.col("endedAt") >= since)) & F.col("startedAt").isNotNull())


def skipped_without_observation(history: DataFrame, now: float, days: float = 7) -> DataFrame:
    return _observed_rows(history, now, days).groupBy("repo").agg(
        F.count_if(F.col("observedCpu.peak").isNull() | F.col("observedCpu.mean").isNull()).alias("skipped"))


def _suggestion_groups(history: DataFrame, now: float, days: float) -> DataFrame:
    rows = _observed_rows(history, now, days).filter(F.col("observedCpu.peak").isNotNull() & F.col("observedCpu.mean").isNotNull())
    rows = rows.select(
        "ord", "repo", "lane", F.coalesce("configLane", "lane").alias("name"), F.coalesce("configLane", F.lit("")).alias("cl"),
        F.coalesce("resources.cpuCores", "weight").alias("declared"), F.col("grantedCpuCores").alias("granted"),
        F.col("observedCpu.mean").alias("mean"), F.col("observedCpu.peak").alias("peak"), "startedAt", "endedAt",
        F.coalesce("runMs", F.col("endedAt") - F.col("startedAt")).alias("span"),
        F.concat_ws("|", *[F.coalesce(F.col(f"resources.{c}").cast("string"), F.lit("-")) for c in ("cpuCores", "memoryBytes", "minCpuCores")]).alias("signature"))
    sizes = rows.groupBy("repo", "name").agg(((F.count("*") < MIN_RUNS) & (F.max("cl") == "")).alias("pooled"))
    rows = rows.join(sizes, ["repo", "name"])
    return rows.select(
        "*", F.when(F.col("pooled"), "(by resources)").otherwise(F.col("name")).alias("group_lane"),
        F.when(F.col("pooled"), "resources").otherwise("lane").alias("grouping"),
        F.when(F.col("pooled"), F.col("signature")).otherwise("").alias("sig"))


SUGGESTION_KEYS = ["repo", "group_lane", "grouping", "sig"]


def sizing_suggestions(history: DataFrame, now: float, days: float = 7) -> DataFrame:
    """Declared cores against the sustained need per lane (or per resources signature for small leftovers)."""
    rows = _suggestion_groups(history, now, days)
    elastic = F.coalesce(F.col("granted") > 0, F.lit(False))
    finished = F.col("endedAt").isNotNull()
    usable = F.coalesce(F.col("declared") > 0, F.lit(False))
    scalable = finished & (~elastic | usable)
    sustained = scalable & (F.col("span") >= SHORT_RUN_MS)
    need = F.when(elastic, F.col("mean") / F.col("granted") * F.col("declared")).otherwise(F.col("mean"))
    at = F.struct(F.coalesce("endedAt", "startedAt").alias("t"), F.col("ord"))
    rows = rows.select(*SUGGESTION_KEYS, "lane", "declared", "granted", elastic.alias("elastic"), finished.alias("finished"), usable.alias("usable"),
                       scalable.alias("scalable"), sustained.alias("sustained"), F.when(sustained, need).alias("need"),
                       F.when(sustained, F.col("peak")).alias("peak"), at.alias("at"))
    g = rows.groupBy(*SUGGESTION_KEYS).agg(
        F.count("*").alias("all_runs"), F.count_if("sustained").alias("runs"), F.count_if(F.col("scalable") & ~F.col("sustained")).alias("short_runs"),
        F.count_if(~F.col("finished")).alias("unfinished_runs"), F.count_if(F.col("finished") & ~F.col("scalable")).alias("malformed_runs"),
        F.count_if(F.col("sustained") & F.col("elastic")).alias("elastic_runs"),
        F.count_if(F.col("sustained") & F.col("elastic") & (F.col("granted") < F.col("declared"))).alias("below"),
        F.countDistinct(F.when(F.col("lane") != F.col("group_lane"), F.col("lane"))).alias("folded_lanes"),
        F.max_by(F.when(F.col("usable"), F.col("declared")), F.when(F.col("usable"), F.col("at"))).alias("declared_cores"))
    stats = order_stats(rows, SUGGESTION_KEYS, {"mean": F.col("need"), "peak": F.col("peak")}, P5090)
    g = g.filter(F.col("all_runs") >= MIN_RUNS).join(stats, SUGGESTION_KEYS, "left")
    enough = F.col("declared_cores").isNotNull() & (F.col("runs") >= MIN_RUNS)
    needed = F.ceil(F.col("mean_p90"))
    verdict = (
        F.when(~enough, "insufficient").when(F.col("mean_p90") > OVERRUN_FACTOR * F.col("declared_cores"), "under-booked")
        .when(needed <= 0.5 * F.col("declared_cores"), "over-booked").otherwise("ok"))
    pct = F.when(F.col("runs") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("below") * 100 / F.col("runs") + 0.5))
    return g.select(
        "repo", F.col("group_lane").alias("lane"), "grouping", F.col("sig").alias("signature"), "runs", "short_runs", "unfinished_runs", "malformed_runs",
        "folded_lanes", "elastic_runs", pct.alias("granted_below_declared_pct"), "declared_cores",
        *[F.when(enough, F.col(c)).alias(o) for c, o in [("mean_p50", "mean_p50"), ("mean_p90", "mean_p90"), ("peak_p50", "peak_p50"), ("peak_p90", "peak_p90")]],
        F.when(enough, F.greatest(F.lit(1).cast("long"), needed)).alias("suggested_cores"), verdict.alias("verdict"))


def too_few_runs(history: DataFrame, now: float, days: float = 7) -> DataFrame:
    return _suggestion_groups(history, now, days).groupBy(*SUGGESTION_KEYS).agg(F.count("*").alias("runs")).filter(
        F.col("runs") < MIN_RUNS).select("repo", F.col("group_lane").alias("lane"), F.col("sig").alias("signature"), "runs")


def order_suggestions(suggestions: DataFrame) -> DataFrame:
    """Report order: verdict, then names."""
    rank = F.when(F.col("verdict") == "under-booked", 0).when(F.col("verdict") == "over-booked", 1).when(F.col("verdict") == "ok", 2).otherwise(3)
    return suggestions.orderBy(rank, "repo", "lane")


# ---- verdict reuse ------------------------------------------------------------------------------------------------

def reuse_decisions(requests: DataFrame, history: DataFrame, now: float, pass_ttl: float, red_ttl: float) -> DataFrame:
    """Serve, refuse or run for each requested content key, by the newest real outcome of that key."""
    real = history.filter(
        (F.coalesce("cachedFrom", F.lit("")) == "") & (F.coalesce("refusedFrom", F.lit("")) == "") & F.col("contentKey").isNotNull()
        & F.col("startedAt").isNotNull() & (F.col("endedAt") <= now)
    ).select("contentKey", "ord", "id", "endedAt", runs.servable_pass().alias("is_pass"), runs.qualifying_red().alias("is_red"))
    last = newest(real, ["contentKey"], [F.col("endedAt").desc(), F.col("ord").desc()], 1)
    age = F.lit(now) - F.col("endedAt")
    action = (
        F.when(F.col("is_pass") & F.lit(pass_ttl > 0) & (age <= pass_ttl), "serve")
        .when(F.col("is_red") & F.lit(red_ttl > 0) & (age <= red_ttl), "refuse").otherwise("run"))
    return requests.join(last, "contentKey", "left").select(
        *requests.columns, action.alias("action"), F.when(action != "run", F.col("ord")).alias("decided_by"))
