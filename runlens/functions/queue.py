"""Column expressions over queue snapshots: scores, usage, claim sizes, requeue verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking.
TIER_POINTS = {"low": 0.0, "medium": 1.0, "high": 2.0}
AGE_MAX_S = 1200.0
AGE_HORIZON_S = 3600.0
HALF_LIFE_S = 1800.0
MAX_REQUEUES = 5


def waited_ms(origin: Column, now: Column) -> Column:
    """Wait since the priority origin; a missing, negative or future origin counts as now."""
    usable = F.coalesce((origin >= 0) & (origin <= now), F.lit(False))
    return F.when(usable, now - origin).otherwise(F.lit(0).cast("long"))


def priority_score(
    tier: Column, waited: Column, exclusive: Column, aging: Column, *,
    w_tier: float = 2.0, w_age: float = 2.0, age_max_ms: float = 1_200_000.0,
) -> Column:
    name = F.when(tier.isin(list(TIER_POINTS)), tier).otherwise("medium")
    points = F.when(name == "high", 2.0).when(name == "medium", 1.0).otherwise(0.0)
    credited = F.when(~F.coalesce(aging, F.lit(True)) | F.coalesce(exclusive, F.lit(False)), F.lit(0).cast("long")).otherwise(waited)
    top = (name == "high") | (credited >= 3 * age_max_ms)
    ceiling = F.when(top, F.lit(w_tier)).otherwise(F.lit(w_tier * (1 - 0.01)))
    return F.least(ceiling, F.lit(w_tier) * (points / 2) + F.lit(w_age) * F.least(F.lit(1.0), credited / F.lit(age_max_ms)))


def effective_rank(score: Column, w_tier: float = 2.0) -> Column:
    return F.when(score >= w_tier, 2).when(score >= w_tier / 2, 1).otherwise(0)


def eff_score(priority: Column, ages: Column, age_s: Column) -> Column:
    tier = F.when(priority >= 7, 2.0).when(priority >= 4, 1.0).otherwise(0.0)
    credit = F.when(ages, F.greatest(age_s, F.lit(0.0))).otherwise(F.lit(0.0))
    ceiling = F.when((tier == 2) | (credit >= AGE_HORIZON_S), 2.0).otherwise(1.98)
    extra = F.when(priority >= 9, 0.01).otherwise(0.0)
    return F.least(ceiling, 2.0 * tier / 2 + 2.0 * F.least(F.lit(1.0), credit / AGE_MAX_S)) + extra


def usage_now(decayed: Column, dt_s: Column, running_cores: Column) -> Column:
    """Recent core-seconds: the decayed history plus what the held cores accrued since."""
    keep = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.coalesce(dt_s, F.lit(0.0))) / HALF_LIFE_S)
    return decayed * keep + running_cores * (HALF_LIFE_S / F.ln(F.lit(2.0))) * (1 - keep)


def usage_cores(decayed: Column, dt_s: Column, running_cores: Column) -> Column:
    return running_cores + usage_now(decayed, dt_s, running_cores) / HALF_LIFE_S


def ticket_weight(header_json: Column, limit: Column) -> Column:
    """Header weight when it is a JSON number (a quoted number is not), never negative, at most the limit."""
    typed = F.from_json(header_json, "struct<weight:string>")["weight"]
    quoted = header_json.rlike(r'"weight"\s*:\s*"')
    number = F.when(~quoted, F.expr("try_cast(0 as double)") + typed.try_cast("double"))
    return F.least(F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.coalesce(limit, F.lit(float("inf"))))


def claim_need(cores: Column, min_cores: Column, waited_s: Column, floor_after_s: Column) -> Column:
    elastic = min_cores.isNotNull() & (waited_s >= floor_after_s)
    return F.when(elastic, F.least(F.ceil(min_cores).cast("double"), cores)).otherwise(cores)


def return_to_queue(cancel_requested: Column, requeues: Column, now_ms: Column) -> Column:
    """struct(state, notBeforeMs) of a claimed ticket that goes back."""
    state = F.when(cancel_requested, "cancelled").when(requeues >= MAX_REQUEUES, "lost").otherwise("queued")
    wait = F.least(F.lit(5000.0) * F.pow(F.lit(2.0), requeues.cast("double")), F.lit(60000.0)).cast("long")
    return F.struct(state.alias("state"), F.when(state == "queued", now_ms + wait).alias("notBeforeMs"))


def cpu_budget(cores: Column, percent: Column, reserve: Column) -> Column:
    return F.least(percent / 100 * cores, F.greatest(F.lit(0.0), cores - reserve))


def memory_level(available: Column, total: Column) -> Column:
    pct = available / F.nullif(F.greatest(total, F.lit(0.0)), F.lit(0.0)) * 100
    return F.when(pct <= 8, "exhausted").when(pct <= 15, "tight").when(pct.isNotNull(), "healthy")


def version_below(version: Column, floor: Column) -> Column:
    """X.Y.Z comparison; a version that cannot be read is below any floor."""
    shape = r"^(\d+)\.(\d+)\.(\d+)"

    def parts(v: Column) -> Column:
        return F.when(v.rlike(shape), F.struct(*[F.regexp_extract(v, shape, i).cast("long").alias(f"p{i}") for i in (1, 2, 3)]))

    return F.coalesce(parts(version) < parts(floor), F.lit(True))
