"""Primitives shared by the jobs: exact order statistics, dedupe, last-N, latest row, fallback tiers, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """`df` marked for broadcast when it has at most `limit` rows (only that many are counted); else left to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def round_to(x: Column, places: int) -> Column:
    """Half-up rounding towards plus infinity, as `floor(x*10^k+0.5)/10^k`."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def nearest_rank(p: float, n: Column) -> Column:
    """1-based nearest rank of the `p` percentile among n values."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * n.cast("double")).cast("long"))


def _bucket(v: Column) -> Column:
    """A non-decreasing bucket of a double, a thousandth wide from a millionth up on either side of zero: some 50,000 for all usual numbers."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * F.lit(1e6)) * F.lit(1024.0))).cast("long")


def order_stats(
    df: DataFrame, keys: list[str], metrics: dict[str, Column],
    percentiles: dict[str, float] | None = None, median: bool = False,
) -> DataFrame:
    """Exact count, maximum, nearest-rank percentiles and interpolating median per key, safe for hot keys.

    Output columns are `<metric>_n`, `<metric>_max`, `<metric>_<name>` and `<metric>_median`. NULL values are left out;
    a key without any value has no row. The values of one key are never gathered: they are counted by (key, value),
    the bucket holding each wanted rank comes from per-bucket totals, and only that bucket is put in order.
    """
    percentiles = percentiles or {}
    names = list(metrics)
    cells = F.array(*[F.struct(F.lit(m).alias("m"), metrics[m].cast("double").alias("v")) for m in names])
    there = F.filter(cells, lambda x: x["v"].isNotNull())
    long = df.select(*keys, F.explode(there).alias("x_")).select(*keys, F.col("x_.m").alias("m"), F.col("x_.v").alias("v"))
    freq = long.groupBy(*keys, "m", "v").agg(F.count("*").alias("c")).withColumn("b", _bucket(F.col("v")))
    buckets = freq.groupBy(*keys, "m", "b").agg(F.sum("c").alias("bc"), F.max("v").alias("bmax"))
    whole = Window.partitionBy(*keys, "m")
    before = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumns({
        "n": F.sum("bc").over(whole),
        "top": F.max("bmax").over(whole),
        "cum": F.coalesce(F.sum("bc").over(before), F.lit(0)),
    })
    ranks = [f"struct('{s}' AS s, greatest(1L, CAST(ceil({float(p)}D * n) AS BIGINT)) AS r)" for s, p in percentiles.items()]
    if median:
        ranks += ["struct('med_lo' AS s, (n + 1) div 2 AS r)", "struct('med_hi' AS s, n div 2 + 1 AS r)"]
    if not ranks:
        ranks = ["struct('first' AS s, 1L AS r)"]
    targets = (
        buckets.withColumn("w_", F.expr(f"explode(array({', '.join(ranks)}))"))
        .filter("w_.r > cum AND w_.r <= cum + bc")
        .select(*[F.col(k).alias(f"t_{k}") for k in keys], F.col("m").alias("t_m"), F.col("b").alias("t_b"),
                F.col("w_.s").alias("s"), (F.col("w_.r") - F.col("cum")).alias("r"), "n", "top")
    )
    cond = (freq["m"] == targets["t_m"]) & (freq["b"] == targets["t_b"])
    for k in keys:
        cond = cond & freq[k].eqNullSafe(targets[f"t_{k}"])
    inside = Window.partitionBy(*keys, "m", "b", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        freq.join(targets, cond)
        .withColumn("run", F.sum("c").over(inside))
        .filter(F.col("run") >= F.col("r"))
    )
    outs = []
    for m in names:

        def stat(s: str) -> str:
            return f"min(CASE WHEN m = '{m}' AND s = '{s}' THEN v END)"

        outs.append(f"coalesce(max(CASE WHEN m = '{m}' THEN n END), 0L) AS {m}_n")
        outs.append(f"max(CASE WHEN m = '{m}' THEN top END) AS {m}_max")
        outs += [f"{stat(s)} AS {m}_{s}" for s in percentiles]
        if median:
            outs.append(f"({stat('med_lo')} + {stat('med_hi')}) / 2 AS {m}_median")
    return picked.groupBy(*keys).agg(*[F.expr(o) for o in outs])


def in_window(t: Column, since_ms: float, until_ms: float) -> Column:
    """Half-open [since, until); a missing time is outside."""
    return t.isNotNull() & (t >= F.lit(float(since_ms))) & (t < F.lit(float(until_ms)))


def first_by_id(df: DataFrame, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """Keeps the first row of each id in file order; rows without an id are all kept.

    The rank filter is pushed below the shuffle by Spark (window group limit), so a hot id sends one row per task;
    rows without an id get a key of their own and stay spread.
    """
    blank = F.col(id_col).isNull() | (F.col(id_col) == "")
    key = F.when(blank, F.concat(F.lit("\x00"), F.col(ord_col).cast("string"))).otherwise(F.col(id_col))
    w = Window.partitionBy("dedupe_key_").orderBy(ord_col)
    return (
        df.withColumn("dedupe_key_", key).withColumn("dedupe_rn_", F.row_number().over(w))
        .filter("dedupe_rn_ = 1").drop("dedupe_key_", "dedupe_rn_")
    )


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows per key in `order`; a window group limit, so at most n rows per key and task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("newest_rn_", F.row_number().over(w)).filter(F.col("newest_rn_") <= n).drop("newest_rn_")


def best_tier(base: DataFrame, tiers: list[tuple[DataFrame, list[str]]], value: str, out: str) -> DataFrame:
    """Fallback lookup: one left join per tier (frame, join keys); the first tier with a value wins."""
    joined, cols = base, []
    for i, (frame, on) in enumerate(tiers):
        tag = f"tier{i}_"
        right = frame.select(*[F.col(k).alias(f"{tag}{k}") for k in on], F.col(value).alias(f"{tag}value"))
        cond = F.lit(True)
        for k in on:
            cond = cond & (F.col(k) == F.col(f"{tag}{k}"))
        joined = joined.join(right, cond, "left").drop(*[f"{tag}{k}" for k in on])
        cols.append(f"{tag}value")
    return joined.withColumn(out, F.coalesce(*cols)).drop(*cols)


def until_budget(
    df: DataFrame, keys: list[str], order: list[str], slice_col: str, size: str, need: str,
) -> DataFrame:
    """Rows to drop, oldest first, until the running size reaches `need`: a row goes while the total before it is short."""
    from runlens.operators.sliced import running

    run = running(df, keys, slice_col, order, sums={"size_upto_": F.col(size)})
    return run.withColumn("evict", (F.col("size_upto_") - F.col(size)) < F.col(need)).drop("size_upto_")
