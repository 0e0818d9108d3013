"""Column expressions over run-history rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run classes, exits that are not a verdict of the command, patterns and clamps.
SPEND_CLASSES = ["gate", "train-batch", "master-verify", "ad-hoc"]
NON_VERDICT_EXITS = [64, 69, 75, 76, 77, 79, 124, 126, 127, 130]
SIM_LANE = r"(?i)(^|[-_:.])sims?($|[-_:.0-9])"
TIMEOUT_WRAPPER = r"^\s*(?:env\s+(?:-\S+\s+|\w+=\S*\s+)*)?g?timeout\b"
RATIO_PAD_MS = 30_000.0
MIN_ESTIMATE_CORES = 0.5


def repo_matches(key: Column, repo: Column | str) -> Column:
    """The key is the repo's checkout or the train's clone of it."""
    name = F.lit(repo) if isinstance(repo, str) else repo
    checkout = F.endswith(key, F.concat(F.lit("_proj_"), name, F.lit("_.git")))
    clone = F.endswith(key, F.concat(F.lit("_merge-train_"), name, F.lit("_clone_.git")))
    return F.coalesce(checkout | clone, F.lit(False))


def run_ms(run: Column, started: Column, ended: Column) -> Column:
    return F.coalesce(run, ended - started)


def reserved_cores(granted: Column, declared: Column, weight: Column) -> Column:
    """First of grant, declaration and weight that is neither missing nor zero, else 1."""
    return F.coalesce(F.nullif(granted, F.lit(0.0)), F.nullif(declared, F.lit(0.0)), F.nullif(weight, F.lit(0.0)), F.lit(1.0))


def wall_seconds() -> Column:
    run = F.col("runMs")
    return F.when(run > 0, run / 1000).otherwise((F.col("endedAt") - F.col("startedAt")) / 1000)


def classify() -> Column:
    """struct(kind, why, wallS): ignored with a reason, censored (a lower bound) or completed."""
    wall = wall_seconds()
    killed = F.coalesce(F.col("signal") != "", F.lit(False)) | (
        F.coalesce(F.col("exit") == 124, F.lit(False)) & F.coalesce(F.col("command").rlike(TIMEOUT_WRAPPER), F.lit(False)))
    why = (
        F.when((F.coalesce(F.col("repo"), F.lit("")) == "") | (F.coalesce(F.col("lane"), F.lit("")) == ""), "malformed")
        .when(F.col("startedAt").isNull(), "never-started")
        .when(F.coalesce(F.col("cancelled"), F.lit(False)), "cancelled")
        .when(~F.coalesce(wall > 0, F.lit(False)), "no-duration")
        .when(killed, F.lit(None).cast("string"))
        .when(F.coalesce(F.col("exit") == 0, F.lit(False)), F.lit(None).cast("string"))
        .otherwise("failed")
    )
    kind = F.when(why.isNotNull(), "ignored").when(killed, "censored").otherwise("completed")
    return F.struct(kind.alias("kind"), why.alias("why"), F.when(why.isNull(), wall).alias("wallS"))


def work_class() -> Column:
    named = F.col("class").isNull() & F.coalesce(F.col("lane"), F.lit("")).rlike(SIM_LANE)
    return F.when(F.coalesce(F.col("class") == "sim", F.lit(False)) | named, "sim").otherwise("test")


def is_local() -> Column:
    return F.coalesce(F.col("executor"), F.lit("local")) == "local"


def ref_bucket(ref_s: Column, middle: str = "medium") -> Column:
    return F.when(ref_s < 120, "short").when(ref_s <= 600, middle).otherwise("long")


def prediction_ratio(predicted: Column, actual: Column) -> Column:
    pad = F.lit(RATIO_PAD_MS)
    return (predicted + pad) / (actual + pad)


def running_residual(elapsed_s: Column, factor: Column, p50: Column, p90: Column, max_ms: Column) -> Column:
    """struct(overrun, residualRef, residualWallS) of a running job."""
    ref = elapsed_s / factor
    cap = F.when(max_ms.isNotNull(), F.greatest((max_ms / 1000 - elapsed_s) / factor, F.lit(0.0)))
    late = ref > p90
    left = F.when(late, F.least(ref * 0.5, F.coalesce(cap, F.lit(float("inf"))))).otherwise(F.greatest(p50 - ref, F.lit(0.0)))
    return F.struct(late.alias("overrun"), left.alias("residualRef"), (left * factor).alias("residualWallS"))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def servable_pass() -> Column:
    clean = _blank(F.col("signal")) & ~F.coalesce(F.col("cancelled"), F.lit(False)) & _blank(F.col("error")) & _blank(F.col("reason"))
    return F.coalesce(F.col("exit") == 0, F.lit(False)) & clean


def qualifying_red() -> Column:
    """A genuine failure on content the key still described when it ended."""
    exit_ok = (F.col("exit") != 0) & (F.col("exit") < 128) & ~F.col("exit").isin(NON_VERDICT_EXITS)
    clean = _blank(F.col("signal")) & ~F.coalesce(F.col("cancelled"), F.lit(False)) & _blank(F.col("error")) & _blank(F.col("reason"))
    remote_ok = (
        F.coalesce(F.col("remoteKind") == "completed", F.lit(False))
        & F.coalesce(F.col("remotePhase") == "command", F.lit(False)) & _blank(F.col("remoteSignal")))
    remote = F.coalesce(F.col("executor") == "remote", F.lit(False))
    return F.coalesce(F.col("contentKeyVerified"), F.lit(False)) & F.coalesce(exit_ok, F.lit(False)) & clean & (~remote | remote_ok)


def charge_estimate(p90: Column, declared: Column) -> Column:
    return F.least(declared, F.greatest(F.lit(MIN_ESTIMATE_CORES), p90))


def raised_charge(p90: Column, budget: Column) -> Column:
    return F.least(budget, F.greatest(F.lit(MIN_ESTIMATE_CORES), p90))


def weekend_ms_before(t: Column) -> Column:
    """Milliseconds of UTC Saturdays and Sundays between the epoch (a Thursday) and `t`."""
    day = F.floor(t / 86_400_000.0)
    rest = t - day * 86_400_000
    dow = F.pmod(day, F.lit(7))
    whole = F.floor(day / 7.0) * 2 + F.greatest(F.lit(0), F.least(F.lit(2), dow - 2))
    return whole * 86_400_000 + F.when(dow.isin(2, 3), rest).otherwise(F.lit(0.0))


def is_weekend(t: Column) -> Column:
    return F.pmod(F.floor(t / 86_400_000.0), F.lit(7)).isin(2, 3)


def relayed_phase(x: Column) -> Column:
    """A finite non-negative phase value, else NULL."""
    return F.when((x >= 0) & ~F.isnan(x) & (x != float("inf")), x)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def observed_or_null(o: Column) -> Column:
    ok = finite(o["peak"]).isNotNull() & finite(o["mean"]).isNotNull() & o["samples"].isNotNull()
    return F.when(ok, F.struct(o["peak"].alias("peak"), o["mean"].alias("mean"), o["samples"].alias("samples")))
