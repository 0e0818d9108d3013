"""Running windows over hot keys.

A plain `Window.partitionBy(key)` sends every row of a key to one task. Here the key's rows are cut into slices of
the ordering column (a day of event time, a block of sequence numbers), each slice is a window of its own, and the
value carried in from earlier slices comes from one pre-aggregated row per (key, slice). Results equal the plain
window; the only per-key group left is that of the slice totals, whose size is the number of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def slice_of(col: Column, width: float) -> Column:
    """Slice number of a numeric ordering column."""
    return F.floor(col / F.lit(float(width))).cast("long")


def running(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    *,
    lags: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    maxes_before: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds running columns per `keys` in `order`.

    `lags`: value of the previous row; `sums`: sum up to and with this row; `maxes_before`: maximum over the earlier
    rows; `lasts`: latest non-null value up to and with this row. `slice_col` must not decrease along `order`.
    """
    lags, sums, maxes_before, lasts = lags or {}, sums or {}, maxes_before or {}, lasts or {}
    at = F.struct(*order)
    edge_aggs = [F.max_by(F.struct(v.alias("v")), at).alias(f"e_{o}") for o, v in lags.items()]
    edge_aggs += [F.sum(v).alias(f"e_{o}") for o, v in sums.items()]
    edge_aggs += [F.max(v).alias(f"e_{o}") for o, v in maxes_before.items()]
    edge_aggs += [
        F.max_by(F.when(v.isNotNull(), F.struct(v.alias("v"))), F.when(v.isNotNull(), at)).alias(f"e_{o}")
        for o, v in lasts.items()
    ]
    ekeys = [f"k_{k}" for k in keys]
    edges = df.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(slice_col).alias("k_slice")).agg(*edge_aggs)
    step = Window.partitionBy(*ekeys).orderBy("k_slice")
    before = step.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.lag(f"e_{o}").over(step).alias(f"c_{o}") for o in lags]
    carried += [F.coalesce(F.sum(f"e_{o}").over(before), F.lit(0)).alias(f"c_{o}") for o in sums]
    carried += [F.max(f"e_{o}").over(before).alias(f"c_{o}") for o in maxes_before]
    carried += [F.last(f"e_{o}", ignorenulls=True).over(before).alias(f"c_{o}") for o in lasts]
    edges = edges.select(*ekeys, "k_slice", *carried)

    inner = Window.partitionBy(*keys, slice_col).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"i_{o}": F.lag(F.struct(v.alias("v"))).over(inner) for o, v in lags.items()}
    local |= {f"i_{o}": F.sum(v).over(upto) for o, v in sums.items()}
    local |= {f"i_{o}": F.max(v).over(earlier) for o, v in maxes_before.items()}
    local |= {
        f"i_{o}": F.last(F.when(v.isNotNull(), F.struct(v.alias("v"))), ignorenulls=True).over(upto)
        for o, v in lasts.items()
    }
    base = df.columns
    rows = df.withColumns(local)
    cond = rows[slice_col] == edges["k_slice"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(edges[f"k_{k}"])
    joined = rows.join(edges, cond, "left")
    out = [rows[c] for c in base if c not in {*lags, *sums, *maxes_before, *lasts}]
    out += [F.coalesce(f"i_{o}", f"c_{o}").getField("v").alias(o) for o in [*lags, *lasts]]
    out += [(F.coalesce(f"i_{o}", F.lit(0)) + F.coalesce(f"c_{o}", F.lit(0))).alias(o) for o in sums]
    out += [F.greatest(f"i_{o}", f"c_{o}").alias(o) for o in maxes_before]
    return joined.select(*out)


def islands(df: DataFrame, keys: list[str], slice_col: str, order: list[str], time: Column, qualifies: Column, max_gap_ms: float) -> DataFrame:
    """Unbroken streaks of qualifying rows: adds `island` (NULL outside one) and `island_since` (its first time).

    A streak goes on only when the previous row of the key also qualifies and the gap is in (0, max_gap_ms].
    """
    q = F.coalesce(qualifies, F.lit(False))
    marked = df.withColumn("q_", q)
    lagged = running(marked, keys, slice_col, order, lags={"p_": F.struct(F.col("q_").alias("q"), time.cast("double").alias("t"))})
    gap = time - F.col("p_.t")
    goes_on = F.coalesce(F.col("p_.q") & (gap > 0) & (gap <= F.lit(float(max_gap_ms))), F.lit(False))
    starts = F.col("q_") & ~goes_on
    out = running(lagged.withColumn("st_", starts), keys, slice_col, order,
                  sums={"n_": F.col("st_").cast("long")}, lasts={"since_": F.when(F.col("st_"), time)})
    return out.withColumns({"island": F.when(F.col("q_"), F.col("n_")), "island_since": F.when(F.col("q_"), F.col("since_"))}).drop(
        "q_", "p_", "st_", "n_", "since_")


def trailing(df: DataFrame, keys: list[str], t_col: str, width_ms: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the trailing [t - width, t] of each row, safe for hot keys.

    Each row is also copied into the next time slice (slices are at least the width), so a slice holds all its windows need.
    """
    size = max(width_ms, DAY_MS)
    home = slice_of(F.col(t_col), size)
    spread = df.withColumn("home_", home).withColumn("slice_", F.explode(F.array(F.col("home_"), F.col("home_") + 1)))
    w = Window.partitionBy(*keys, "slice_").orderBy(t_col).rangeBetween(-width_ms, 0)
    out = spread.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    return out.filter(F.col("slice_") == F.col("home_")).drop("home_", "slice_")
