"""Primitives against brute force, with hot keys and shuffled input."""

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import folds
from runlens.operators.primitives import first_by_id, newest, order_stats, round_to
from runlens.operators.sliced import islands, running, trailing


def _rank(xs, p):
    return sorted(xs)[max(0, math.ceil(p * len(xs)) - 1)]


def test_order_stats_match_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.choice([rng.randint(0, 5), rng.gauss(0, 1e4), -rng.random()]))) for _ in range(900)]
    rows += [("cold", 3.5), ("pair", 1.0), ("pair", 4.0), (None, -2.0)]
    rows += [("gaps", None), ("gaps", 9.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in order_stats(df, ["k"], {"v": F.col("v")}, {"p50": 0.5, "p90": 0.9}, median=True).collect()}
    for k in {r[0] for r in rows}:
        xs = sorted(v for kk, v in rows if kk == k and v is not None)
        mid = len(xs) // 2
        assert got[k]["v_n"] == len(xs) and got[k]["v_max"] == xs[-1]
        assert got[k]["v_p50"] == _rank(xs, 0.5) and got[k]["v_p90"] == _rank(xs, 0.9)
        assert got[k]["v_median"] == (xs[mid] if len(xs) % 2 else (xs[mid - 1] + xs[mid]) / 2)


def test_running_equals_plain_window(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.choice([None, rng.randint(0, 50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, ord long, v int").withColumn("s", F.floor(F.col("ord") / 37).cast("long")).repartition(6)
    got = running(df, ["k"], "s", ["ord"], lags={"lag": F.col("v")}, sums={"sum": F.coalesce("v", F.lit(0))}, maxes_before={"mx": F.col("v")}, lasts={"last": F.col("v")})
    w = Window.partitionBy("k").orderBy("ord")
    want = df.withColumns({"lag": F.lag("v").over(w), "sum": F.sum(F.coalesce("v", F.lit(0))).over(w), "mx": F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                           "last": F.last("v", ignorenulls=True).over(w)})
    cols = ["k", "ord", "lag", "sum", "mx", "last"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_island_breaks_on_gap_and_clock_step_back(spark):
    rows = [(1, 0, True), (2, 5, True), (3, 5, True), (4, 9, False), (5, 10, True), (6, 30, True), (7, 25, True)]
    df = spark.createDataFrame([("a", o, t, q) for o, t, q in rows], "k string, ord long, t long, q boolean").withColumn("s", F.floor(F.col("ord") / 3).cast("long"))
    got = {r["ord"]: (r["island"], r["island_since"]) for r in islands(df, ["k"], "s", ["ord"], F.col("t"), F.col("q"), 10).collect()}
    # an equal time, a gap over the limit and a step back each start a new streak
    assert [got[i] for i in range(1, 8)] == [(1, 0), (1, 0), (2, 5), (None, None), (3, 10), (4, 30), (5, 25)]


def test_trailing_window_spans_slices(spark):
    day = 86_400_000
    rows = [("h", t) for t in (day - 30_000, day - 10, day + 5, day + 59_000, 3 * day)]
    df = spark.createDataFrame(rows, "host string, t long")
    got = {r["t"]: r["n"] for r in trailing(df, ["host"], "t", 60_000, {"n": F.count("*")}).collect()}
    assert [got[t] for _, t in rows] == [1, 2, 3, 3, 1]


def test_first_by_id_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4), ("", 5)], "id string, ord long").repartition(3)
    assert sorted(r["ord"] for r in first_by_id(df).collect()) == [1, 3, 4, 5]


def test_rank_limits_are_pushed_below_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "id AS ord")
    plan = newest(df, ["k"], [F.col("ord").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_round_half_up(spark):
    got = spark.range(1).select(round_to(F.lit(0.35), 1).alias("a"), round_to(F.lit(-1.25), 1).alias("b")).first()
    assert (got["a"], got["b"]) == (math.floor(0.35 * 10 + 0.5) / 10, -1.2)


def _sequential(rows, kind):
    state, var, n, cn = None, folds.INITIAL_VARIANCE, 0, 0
    for _, _, v, c in sorted(rows):
        n, cn = n + 1, cn + c
        if state is None:
            state = kind.first(v, c)
        elif c:
            state = max(state, v)
        else:
            nxt = kind.scalar(state, v)
            d = (nxt - state) / folds.ALPHA
            var, state = 0.9 * (var + 0.1 * d * d), nxt
    return n, cn, state, var


@pytest.mark.parametrize("kind", [folds.LogStep, folds.FactorStep])
def test_sliced_fold_of_a_hot_key_equals_the_sequential_fold(spark, kind):
    rng = random.Random(11)
    day = 86_400_000
    rows = []
    for i in range(1500):
        k = "hot" if i % 3 else f"c{i % 5}"
        v = rng.choice([rng.gauss(5, 0.2), rng.gauss(0, 3), 40.0 if i % 50 == 0 else 5.0])
        v = abs(v) + 0.01 if kind is folds.FactorStep else v
        rows.append((k, rng.randint(0, 20) * day + rng.randint(0, 3), i, v, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "k string, t long, ord long, v double, c boolean").repartition(5)
    out = folds.sliced_fold(df, ["k"], F.col("v"), F.col("c"), F.col("t"), "ord", kind, hot_rows=300)
    for r in out.collect():
        n, cn, state, var = _sequential([(t, o, v, c) for k, t, o, v, c in rows if k == r["k"]], kind)
        assert (r["n"], r["censored_n"]) == (n, cn)
        assert r["state"] == pytest.approx(state, rel=1e-9) and r["variance"] == pytest.approx(var, rel=1e-7)


def test_rows_of_hot_keys_are_never_broadcast(spark, tmp_path):
    # a file that is tiny in Parquet, so its size says nothing about the rows made from it
    spark.range(2000).selectExpr("'hot' AS k", "id % 40 * 86400000L AS t", "id AS ord", "1.5D AS v", "false AS c").write.parquet(f"{tmp_path}/obs")
    df = spark.read.parquet(f"{tmp_path}/obs")
    out = folds.sliced_fold(df, ["k"], F.col("v"), F.col("c"), F.col("t"), "ord", folds.LogStep, hot_rows=300)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"rightHint=\(strategy=merge\)|leftHint=\(strategy=merge\)", plan)
    assert not re.search(r"BroadcastHashJoin \[k#\d+, slice", out._jdf.queryExecution().executedPlan().toString())
    assert [(r.n, r.state) for r in out.collect()] == [(2000, 1.5)]


def test_buckets_of_a_hot_key_stay_small(spark):
    from runlens.operators.primitives import _bucket

    n = 400_000
    v = F.pmod(F.col("id") * 7919, F.lit(n)) / float(n)
    for x in (v, -v, v * 1e9, v * 1e-4):
        df = spark.range(n).select(F.lit("hot").alias("k"), x.alias("v"))
        # a bucket is a thousandth of its value wide, so in no octave does it hold more than about a seven-hundredth of the values
        assert df.groupBy(_bucket(F.col("v")).alias("b")).count().agg(F.max("count")).first()[0] <= n // 700
        assert df.select(_bucket(F.col("v")).alias("b"), "v").selectExpr("max_by(b, v) = max(b) AND min_by(b, v) = min(b)").first()[0]
    out = order_stats(spark.range(n).select(F.lit("hot").alias("k"), v.alias("v")), ["k"], {"m": F.col("v")}, {"p50": 0.5, "p90": 0.9}, median=True).first()
    assert (out.m_n, out.m_p50, out.m_p90, out.m_median, out.m_max) == (n, (n // 2 - 1) / n, (n * 9 // 10 - 1) / n, (n - 1) / 2 / n, (n - 1) / n)
