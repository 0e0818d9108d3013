"""Duration, CPU and speed estimates from history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import commands, runs
from runlens.operators.folds import FactorStep, LogStep, sliced_fold
from runlens.operators.primitives import best_tier, newest, order_stats, round_to
from runlens.session import cut_lineage

# Fixed values.
Z90 = 1.28
WIDEN = 1.5
CLASS_DEFAULT_S = {"test": 300.0, "sim": 900.0}
LEVELS = [
    ("exact", ["template", "class_id", "through_act", "arm_set", "code_family"]),
    ("no-code-family", ["template", "class_id", "through_act", "arm_set"]),
    ("no-arm-set", ["template", "class_id", "through_act"]),
    ("no-through-act", ["template", "class_id"]),
    ("runner-wide", ["template"]),
]
PARTS = LEVELS[0][1]
WINDOW_RUNS = 50
WINDOW_MS = 14 * 86_400_000.0
ANCHOR_STALE_MS = 30 * 86_400_000.0
EXPRESS_MIN_SAMPLES = 3
BYPASS_RUNS = 20
BYPASS_MAX_STRIKES = 3


def p90_of(state: Column, variance: Column, widen: float = 1.0) -> Column:
    return F.exp(state + F.lit(Z90) * F.sqrt(variance) * F.lit(widen))


# ---- duration estimator -------------------------------------------------------------------------------------------

def at_levels(obs: DataFrame) -> DataFrame:
    """Observations (PARTS..., ref_s, censored, t, ord) once for each level, with the level's key."""
    level_keys = F.array(*[
        F.struct(F.lit(i).alias("level"), *[(F.coalesce(p, F.lit("")) if p in parts else F.lit("")).alias(p) for p in PARTS])
        for i, (_, parts) in enumerate(LEVELS)])
    return obs.filter(F.col("ref_s") > 0).select(F.explode(level_keys).alias("key"), "ref_s", "censored", "t", "ord").select("key.*", "ref_s", "censored", "t", "ord")


def fold_durations(obs: DataFrame, **slicing) -> DataFrame:
    """Estimator state per level and key from observations (PARTS..., ref_s, censored, t, ord); `slicing` goes to sliced_fold."""
    # written once: the fold's passes would each hold the whole expression of the observations, once for every part and level
    obs = cut_lineage(obs.select(*PARTS, "ref_s", "censored", "t", "ord"), "observations")
    return sliced_fold(at_levels(obs), ["level", *PARTS], F.ln("ref_s"), F.col("censored"), F.col("t"), "ord", LogStep, **slicing)


def class_p75(obs: DataFrame) -> DataFrame:
    """75th percentile of completed reference seconds per class."""
    stats = order_stats(obs.filter(~F.col("censored") & (F.col("ref_s") > 0)), ["class_id"], {"ref": F.col("ref_s")}, {"p75": 0.75})
    return stats.select("class_id", F.col("ref_p75").alias("class_p75"))


def answer_estimates(jobs: DataFrame, states: DataFrame, class_default: DataFrame) -> DataFrame:
    """p50, p90 and source per requested job key: narrowest level with data, else the class default raised by a hint.

    `jobs` has PARTS and optional columns hint_p50, hint_p90.
    """
    base = jobs.withColumns({p: F.coalesce(p, F.lit("")) for p in PARTS})
    states = cut_lineage(states, "estimator-states")  # every level reads them: the fold behind them would run once for each
    tiers = []
    for i, (source, parts) in enumerate(LEVELS):
        level = states.filter(F.col("level") == i).withColumn("est", F.struct(
            F.exp("state").alias("p50"), p90_of(F.col("state"), F.col("variance"), WIDEN**i).alias("p90"), F.lit(source).alias("source")))
        tiers.append((level, parts))
    found = best_tier(base, tiers, "est", "est").join(class_default, "class_id", "left")
    placeholder = F.when(F.col("class_id") == "sim", CLASS_DEFAULT_S["sim"]).otherwise(CLASS_DEFAULT_S["test"])
    d50 = F.when(F.col("class_p75") > 0, F.col("class_p75")).otherwise(placeholder)
    p50 = F.greatest(d50, F.coalesce("hint_p50", F.lit(0.0)))
    p90 = F.greatest(2 * d50, F.coalesce("hint_p90", F.lit(0.0)), 2 * p50)
    return found.select(
        *jobs.columns, F.coalesce("est.p50", p50).alias("est_p50_s"), F.coalesce("est.p90", p90).alias("est_p90_s"),
        F.coalesce("est.source", F.lit("class-default")).alias("est_source"))


def backfill_estimates(history: DataFrame, keys: list[str] | None = None, host_factor: float = 1.0) -> DataFrame:
    """Fold per (repo, lane, class[, extra keys]): n, censored, p50, p90 (seconds, one decimal), RSS p90."""
    keys = keys or ["repo", "lane", "work_class"]
    rows = history.withColumn("c", runs.classify()).filter("c.kind <> 'ignored'").withColumn("work_class", runs.work_class())
    obs = rows.select(*keys, (F.col("c.wallS") / host_factor).alias("ref_s"), (F.col("c.kind") == "censored").alias("censored"),
                      F.coalesce("endedAt", F.lit(0.0)).alias("t"), "ord", "observedRssPeakBytes")
    states = sliced_fold(obs, keys, F.ln("ref_s"), F.col("censored"), F.col("t"), "ord", LogStep)
    return states.select(*keys, "n", F.col("censored_n").alias("censored"), round_to(F.exp("state"), 1).alias("p50"),
                         round_to(p90_of(F.col("state"), F.col("variance")), 1).alias("p90"))


def backfill_report(history: DataFrame) -> DataFrame:
    keys = ["repo", "lane", "work_class"]
    rows = history.withColumn("c", runs.classify()).filter("c.kind <> 'ignored'").withColumn("work_class", runs.work_class())
    rss = order_stats(rows, keys, {"rss": F.col("observedRssPeakBytes")}, {"p90": 0.9}).select(*keys, F.col("rss_p90").alias("rss_p90_bytes"))
    return backfill_estimates(history).join(rss, keys, "left").withColumn("est_source", F.lit("exact"))


def skipped_by_reason(history: DataFrame) -> DataFrame:
    c = runs.classify()
    return history.select(c["kind"].alias("kind"), c["why"].alias("why")).filter("kind = 'ignored'").groupBy("why").agg(F.count("*").alias("n"))


def expected_run_ms(history: DataFrame, local_only: bool) -> DataFrame:
    """Expected run per (repo, lane): p50 of local runs, or p90 of all. A lane with mixed classes takes its first-seen class."""
    rows = history.filter(runs.is_local()) if local_only else history
    est = backfill_estimates(rows)
    seen = (
        rows.filter(runs.classify()["kind"] != "ignored").withColumn("work_class", runs.work_class())
        .groupBy("repo", "lane").agg(F.min_by("work_class", F.struct(F.coalesce("endedAt", F.lit(0.0)).alias("t"), "ord")).alias("work_class")))
    which = "p50" if local_only else "p90"
    return est.join(seen, ["repo", "lane", "work_class"]).select("repo", "lane", F.floor(F.col(which) * 1000 + 0.5).cast("long").alias("expected_ms"), "n")


# ---- host speed factors -------------------------------------------------------------------------------------------

def host_factors(finished: DataFrame, anchor: str) -> DataFrame:
    """Speed factor per (host, class, bucket) from finished jobs (host, class, est_ref_s, wall_s, censored, t, ord)."""
    obs = finished.filter((F.col("host") != anchor) & (F.col("est_ref_s") > 0) & (F.col("wall_s") > 0)).withColumn("bucket", runs.ref_bucket(F.col("est_ref_s")))
    folded = sliced_fold(obs, ["host", "class", "bucket"], F.col("wall_s") / F.col("est_ref_s"), F.col("censored"), F.col("t"), "ord", FactorStep)
    return folded.select("host", "class", "bucket", F.col("state").alias("factor"), "n")


def rebase_anchor(factors: DataFrame, calibrated: DataFrame, anchor: str, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New factor cells, the reference scales to apply and the cells left unanchored, once the anchor is stale.

    With a fresh anchor the cells come back unchanged and the other two frames are empty.
    """
    fresh = calibrated.filter(F.lit(now) - F.col("calibrated_at") <= ANCHOR_STALE_MS).select("host")
    anchor_fresh = fresh.filter(F.col("host") == anchor).agg(F.count("*").alias("anchor_fresh"))
    ranks = factors.filter(F.col("host") != anchor).join(fresh, "host", "left_semi").groupBy("host").agg(F.exp(F.avg(F.ln("factor"))).alias("rank"))
    # one row per host: the ranking runs over the host list, a small dimension
    w = Window.orderBy("rank", "host")
    chosen = (
        ranks.withColumns({"rn": F.row_number().over(w), "cnt": F.count("*").over(Window.partitionBy())})
        .filter(F.col("rn") == F.floor((F.col("cnt") - 1) / 2) + 1)
        .crossJoin(F.broadcast(anchor_fresh)).filter("anchor_fresh = 0").select(F.col("host").alias("new_anchor")))
    scales = factors.join(F.broadcast(chosen), factors["host"] == chosen["new_anchor"]).select("class", "bucket", F.col("factor").alias("scale"), "new_anchor")
    hosts = factors.select("host").union(factors.sparkSession.range(1).select(F.lit(anchor).alias("host"))).distinct()
    moved_hosts = hosts.join(F.broadcast(chosen), hosts["host"] != chosen["new_anchor"]).select("host")
    own_cells = moved_hosts.join(F.broadcast(scales.select("class", "bucket", "scale"))).join(factors, ["host", "class", "bucket"], "left").select(
        "host", "class", "bucket", (F.coalesce("factor", F.lit(1.0)) / F.col("scale")).alias("factor"), F.coalesce("n", F.lit(0)).alias("n"))
    rest = factors.join(F.broadcast(chosen), factors["host"] != chosen["new_anchor"], "left_semi").join(scales, ["class", "bucket"], "left_anti")
    unmoved = factors.join(F.broadcast(chosen), F.lit(True), "left_anti")
    cells = own_cells.unionByName(rest.select("host", "class", "bucket", "factor", "n")).unionByName(unmoved.select("host", "class", "bucket", "factor", "n"))
    return cells, scales, rest.select("class", "bucket").distinct()


def rescale_states(states: DataFrame, scales: DataFrame) -> DataFrame:
    """Estimator states re-expressed after the anchor moved, by the scale of the bucket their p50 falls in."""
    s = scales.select(F.col("class").alias("class_id"), "bucket", "scale")
    return (
        states.withColumn("bucket", runs.ref_bucket(F.exp("state"))).join(s, ["class_id", "bucket"], "left")
        .withColumn("state", F.col("state") + F.ln(F.coalesce("scale", F.lit(1.0)))).drop("bucket", "scale"))


# ---- CPU demand ---------------------------------------------------------------------------------------------------

def cpu_demand(history: DataFrame, now: float, min_runs: int = 5, window_ms: float = WINDOW_MS) -> DataFrame:
    """p90 of per-run peak cores over the newest runs per (level, repo:lane, fingerprint, cores)."""
    declared = F.col("resources.cpuCores")
    usable = (
        (runs.classify()["kind"] == "completed") & runs.is_local() & declared.isNotNull() & (F.coalesce("grantedCpuCores", declared) == declared)
        & (F.col("observedCpu.peak") >= 0) & F.col("cmdFingerprint").isNotNull() & (F.lit(now) - F.col("endedAt") <= window_ms))
    key = F.coalesce("key", F.concat("repo", F.lit(":"), "lane"))
    repo = F.regexp_extract(key, "^(.*):[^:]*$", 1)
    config = F.regexp_replace(F.coalesce("configLane", "lane"), r"[^A-Za-z0-9._-]", "_")
    levels = F.array(F.struct(F.lit("exact").alias("level"), key.alias("workload")),
                     F.struct(F.lit("configLane").alias("level"), F.concat(repo, F.lit(":"), config).alias("workload")))
    rows = history.filter(usable).select(F.explode(levels).alias("l"), F.col("cmdFingerprint").alias("fingerprint"), declared.alias("cores"),
                                         "endedAt", "ord", F.col("observedCpu.peak").alias("peak")).select("l.*", "fingerprint", "cores", "endedAt", "ord", "peak")
    keys = ["level", "workload", "fingerprint", "cores"]
    last = newest(rows, keys, [F.col("endedAt").desc(), F.col("ord").desc()], WINDOW_RUNS)
    return last.groupBy(*keys).agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY peak)").alias("p90"), F.count("*").alias("n")).filter(F.col("n") >= min_runs)


def charge_requests(requests: DataFrame, demand: DataFrame) -> DataFrame:
    """CPU charge per request (key, config_lane, fingerprint, declared, budget): exact, then declared lane, else the declaration."""
    est = demand.withColumn("est", F.struct("p90", "level"))
    repo = F.regexp_extract("key", "^(.*):[^:]*$", 1)
    own = F.regexp_extract("key", "^.*:([^:]*)$", 1)
    config = F.regexp_replace(F.coalesce("config_lane", own), r"[^A-Za-z0-9._-]", "_")
    base = requests.withColumns({"workload_c": F.concat(repo, F.lit(":"), config), "cores": F.col("declared")})
    exact = est.filter("level = 'exact'").withColumnRenamed("workload", "key")
    declared = est.filter("level = 'configLane'").withColumnRenamed("workload", "workload_c")
    found = best_tier(base, [(exact, ["key", "fingerprint", "cores"]), (declared, ["workload_c", "fingerprint", "cores"])], "est", "est")
    p90 = F.col("est.p90")
    raised = F.col("budget").isNotNull() & (p90 > F.col("declared"))
    charge = F.when(p90.isNull(), F.col("declared")).when(raised, runs.raised_charge(p90, F.col("budget"))).otherwise(runs.charge_estimate(p90, F.col("declared")))
    source = F.when(p90.isNull(), "declared").when(raised, "history:raised").otherwise(F.concat(F.lit("history:"), F.col("est.level")))
    return found.select(*requests.columns, charge.alias("charge"), source.alias("source"))


def right_sized(history: DataFrame, now: float, floor: float = 1.0, window_ms: float = WINDOW_MS) -> DataFrame:
    """Right-sized cores per (repo, declared lane): the newest rows first, then the usable ones among them."""
    rows = history.filter(F.lit(now) - F.col("endedAt") <= window_ms).withColumn("name", F.coalesce("configLane", "lane"))
    last = newest(rows, ["repo", "name"], [F.col("endedAt").desc(), F.col("ord").desc()], WINDOW_RUNS)
    mean, granted, asked = F.col("observedCpu.mean"), F.col("grantedCpuCores"), F.col("resources.cpuCores")
    ok = (runs.classify()["kind"] != "ignored") & (F.col("observedCpu.samples") >= 3) & (mean >= 0)
    need = F.when(ok, F.when((granted > 0) & asked.isNotNull(), mean / granted * asked).otherwise(mean))
    g = last.withColumn("need", need).groupBy("repo", "name").agg(
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY need)").alias("p90"), F.count("need").alias("runs"),
        F.max_by(asked, F.struct("endedAt", "ord")).alias("declared"))
    target = F.ceil(F.col("p90") * 1.2 - 1e-9).cast("double")
    return g.filter("runs >= 5").select("repo", F.col("name").alias("lane"), "runs", "declared", F.least(F.col("declared"), F.greatest(F.lit(floor), target)).alias("cpu_cores"))


# ---- express and bypass -------------------------------------------------------------------------------------------

def express_table(history: DataFrame) -> DataFrame:
    """Local p50 run ms per (repo, lane) and per (repo, lane, fingerprint); `fingerprint` NULL is the lane."""
    local = history.filter(runs.is_local() & (F.coalesce("repo", F.lit("")) != "") & (F.coalesce("lane", F.lit("")) != ""))
    named = F.col("cmdFingerprint") != ""
    keyed = local.withColumn("fp", F.explode(F.when(named, F.array(F.lit(None).cast("string"), "cmdFingerprint")).otherwise(F.array(F.lit(None).cast("string")))))
    keys = ["repo", "lane", "fp", "work_class"]
    est = backfill_estimates(keyed, keys)
    seen = (
        keyed.filter(runs.classify()["kind"] != "ignored").withColumn("work_class", runs.work_class()).groupBy("repo", "lane", "fp")
        .agg(F.min_by("work_class", F.struct(F.coalesce("endedAt", F.lit(0.0)).alias("t"), "ord")).alias("first_class")))
    s = seen.select(F.col("repo").alias("r"), F.col("lane").alias("l"), F.col("fp").alias("f"), "first_class")
    cond = (F.col("repo") == F.col("r")) & (F.col("lane") == F.col("l")) & F.col("fp").eqNullSafe(F.col("f")) & (F.col("work_class") == F.col("first_class"))
    return est.join(s, cond).filter(F.col("n") >= EXPRESS_MIN_SAMPLES).select(
        "repo", "lane", F.col("fp").alias("fingerprint"), F.floor(F.col("p50") * 1000 + 0.5).cast("long").alias("p50_ms"), "n")


BYPASS_KEYS = ["repo", "lane", "kind", "name"]


def bypass_runs(history: DataFrame) -> DataFrame:
    """Local runs once for their exact command and once for its family: BYPASS_KEYS, ord, t, run_ms, success."""
    run = F.when(F.col("runMs") > 0, F.col("runMs")).otherwise(F.col("endedAt") - F.col("startedAt"))
    started = history.filter((F.coalesce("repo", F.lit("")) != "") & (F.coalesce("lane", F.lit("")) != "") & runs.is_local() & F.col("startedAt").isNotNull() & (run > 0))
    family = commands.command_family(F.col("command"))
    rows = started.select("repo", "lane", "ord", F.coalesce("endedAt", F.lit(0.0)).alias("t"), run.alias("run_ms"),
                          (runs.classify()["kind"] == "completed").alias("success"),
                          F.array(F.struct(F.lit("command").alias("kind"), F.col("cmdFingerprint").alias("name")),
                                  F.struct(F.lit("family").alias("kind"), family.alias("name"))).alias("ids"))
    return rows.withColumn("id", F.explode("ids")).select("repo", "lane", "id.kind", "id.name", "ord", "t", "run_ms", "success").filter(F.coalesce("name", F.lit("")) != "")


def bypass_table(history: DataFrame, max_ms: float) -> DataFrame:
    """Median of the last successes and strikes over `max_ms` among the last started, per exact command and family."""
    rows, keys = bypass_runs(history), BYPASS_KEYS
    order = [F.col("t").desc(), F.col("ord").desc()]
    good = newest(rows.filter("success"), keys, order, BYPASS_RUNS).groupBy(*keys).agg(
        F.count("*").alias("n"), F.floor(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY run_ms)") + 0.5).cast("long").alias("median_ms"))
    strikes = newest(rows, keys, order, BYPASS_RUNS).groupBy(*keys).agg(F.count_if(F.col("run_ms") > max_ms).alias("strikes"))
    return good.filter(F.col("n") >= EXPRESS_MIN_SAMPLES).join(strikes, keys)


BYPASS_SUMMARY = "repo string, lane string, kind string, name string, good array<struct<t: double, ord: bigint, run_ms: double>>, recent array<struct<t: double, ord: bigint, run_ms: double>>"


def bypass_summary(history: DataFrame) -> DataFrame:
    """The runs a bypass table rests on, per key: its newest successes and its newest runs, BYPASS_RUNS of each. Summaries merge."""
    rows = bypass_runs(history).withColumn("run", F.struct("t", F.col("ord").cast("long").alias("ord"), F.col("run_ms").cast("double").alias("run_ms")))
    order = [F.col("t").desc(), F.col("ord").desc()]
    lists = [newest(r, BYPASS_KEYS, order, BYPASS_RUNS).groupBy(*BYPASS_KEYS).agg(F.collect_list("run").alias(n)) for r, n in ((rows.filter("success"), "good"), (rows, "recent"))]
    none = F.array().cast("array<struct<t: double, ord: bigint, run_ms: double>>")
    return lists[1].join(lists[0], BYPASS_KEYS, "left").select(*BYPASS_KEYS, F.coalesce("good", none).alias("good"), "recent")


def merge_bypass_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per key; a run that several hold counts once."""
    newest_of = lambda c: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))), asc=False), 1, BYPASS_RUNS).alias(c)
    return summaries.groupBy(*BYPASS_KEYS).agg(newest_of("good"), newest_of("recent"))


def bypass_of(summary: DataFrame, max_ms: float) -> DataFrame:
    """The bypass table of a summary."""
    n = F.size("good")
    times = F.array_sort(F.transform("good", lambda x: x["run_ms"]))
    median = F.floor(F.element_at(times, F.greatest(F.lit(1), F.ceil(n / 2).cast("int"))) + 0.5).cast("long")
    return summary.filter(n >= EXPRESS_MIN_SAMPLES).select(
        *BYPASS_KEYS, n.cast("long").alias("n"), median.alias("median_ms"), F.size(F.filter("recent", lambda x: x["run_ms"] > max_ms)).cast("long").alias("strikes"))


def express_verdicts(tickets: DataFrame, express: DataFrame, max_ms: float) -> DataFrame:
    """Expected ms and source per ticket (repo, lane, fingerprint): exact command, else lane; express when under the limit."""
    e = express.withColumn("est", F.struct(F.col("p50_ms").alias("ms"), F.when(F.col("fingerprint").isNotNull(), "command").otherwise("lane").alias("source")))
    found = best_tier(tickets, [(e.filter("fingerprint IS NOT NULL"), ["repo", "lane", "fingerprint"]), (e.filter("fingerprint IS NULL"), ["repo", "lane"])], "est", "est")
    return found.select(*tickets.columns, F.col("est.ms").alias("expected_ms"), F.col("est.source").alias("source"), F.coalesce(F.col("est.ms") < max_ms, F.lit(False)).alias("express"))


def bypass_verdicts(tickets: DataFrame, bypass: DataFrame, max_ms: float) -> DataFrame:
    """Bypass or the refusal reason per ticket (repo, lane, fingerprint, command)."""
    b = bypass.withColumn("est", F.struct("median_ms", "strikes", F.col("kind").alias("source")))
    exact = b.filter("kind = 'command'").withColumnRenamed("name", "fingerprint")
    fam = b.filter("kind = 'family'").withColumnRenamed("name", "family")
    base = tickets.withColumn("family", commands.command_family(F.col("command")))
    found = best_tier(base, [(exact, ["repo", "lane", "fingerprint"]), (fam, ["repo", "lane", "family"])], "est", "est")
    refused = (
        F.when(F.col("est").isNull(), "no-history").when(~(F.col("est.median_ms") < max_ms), "median-over-max")
        .when(F.col("est.strikes") > BYPASS_MAX_STRIKES, "too-many-strikes"))
    return found.select(*tickets.columns, refused.alias("refused"), F.when(refused.isNull(), F.col("est.median_ms")).alias("expected_ms"),
                        F.when(refused.isNull(), F.col("est.source")).alias("source"))
