"""Slice summaries against the plain fold, and the estimator over rows that come in any order."""

import math
import random

import pytest

from runlens.operators.folds import ALPHA, INITIAL_VARIANCE, FactorStep, LogStep
from runlens.plans import estimates
from runlens.streaming import estimators as e
from runlens.streaming import timers

S = "template string, class_id string, through_act string, arm_set string, code_family string, ref_s double, censored boolean, t double, ord long"


def plain(kind, rows, state=None, variance=INITIAL_VARIANCE):
    for v, c in rows:
        if state is None:
            state = kind.first(v, c)
        elif c:
            state = max(state, v)
        else:
            new = kind.scalar(state, v)
            d = (new - state) / ALPHA
            state, variance = new, (1 - ALPHA) * (variance + ALPHA * d * d)
    return state, variance


@pytest.mark.parametrize("kind,domain,draw", [(LogStep, e.DOMAIN, lambda r: r.gauss(4, 2)), (FactorStep, (0.0, 1000.0), lambda r: math.exp(r.gauss(0, 1)))])
def test_a_summary_gives_what_the_rows_give(kind, domain, draw):
    r = random.Random(3)
    for n in (1, 2, 7, 60, 400):
        rows = [(draw(r), r.random() < 0.2) for _ in range(n)]
        summary = e.SliceSummary(kind, domain)
        for v, c in rows:
            summary.add(v, c)
        for entry in [None, *[draw(r) for _ in range(20)], domain[0], domain[1], rows[0][0]]:
            assert summary.leave(entry, 0.5) == pytest.approx(plain(kind, rows, entry, 0.5), rel=1e-11)
        again = e.SliceSummary.unpacked(kind, summary.packed())
        assert again.leave(1.0, 0.1) == summary.leave(1.0, 0.1) and (again.n, again.censored_n) == (n, sum(c for _, c in rows))


def run(spark, tmp_path, files, **options):
    path = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, S).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(S).option("maxFilesPerTrigger", 1).parquet(path)
    out, _ = timers.run_stateful(e.fold_durations(s, **options), "estimator")
    newest = {}
    for row in sorted(out.collect(), key=lambda x: x.n):
        newest[tuple(row[:6])] = tuple(row[6:])
    return newest


def observations(n, r):
    day = 86_400_000.0
    return [(f"t{r.randrange(2)}", "test", r.choice(["a", "b"]), None, None, math.exp(r.gauss(3, 1.5)), r.random() < 0.15, day * r.randrange(200), i) for i in range(n)]


def test_any_order_gives_the_batch_state(spark, tmp_path):
    r = random.Random(9)
    rows = [*observations(300, r), ("t0", "test", "a", None, None, 0.0, False, 1.0, 900), ("t0", "test", "a", None, None, None, False, 1.0, 901)]
    mixed = rows[:]
    r.shuffle(mixed)
    got = run(spark, tmp_path, [mixed[i::6] for i in range(6)], slice_ms=9 * 86_400_000.0)
    want = {tuple(x[:6]): tuple(x[6:]) for x in estimates.fold_durations(spark.createDataFrame(rows, S)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_rows_behind_the_horizon_do_not_count(spark, tmp_path):
    day = 86_400_000.0
    row = lambda d, x, o: ("t", "c", "", "", "", x, False, d * day, o)
    files = [[row(0, 10.0, 0), row(1, 20.0, 1)], [row(10, 30.0, 2)], [row(0, 99.0, 3), row(9, 25.0, 4)]]
    got = run(spark, tmp_path, files, slice_ms=day, open_slices=3)[4, "t", "", "", "", ""]
    state, variance = plain(LogStep, [(math.log(x), False) for x in (10.0, 20.0, 25.0, 30.0)])
    assert got == pytest.approx((4, 0, state, variance), rel=1e-12)


@pytest.mark.parametrize("kind,domain,draw", [(LogStep, e.DOMAIN, lambda r: r.gauss(4, 2)), (FactorStep, (0.0, 1000.0), lambda r: math.exp(r.gauss(0, 1)))])
def test_a_long_slice_is_folded_plainly_once_its_states_agree(kind, domain, draw, monkeypatch):
    r = random.Random(8)
    rows = [(draw(r), r.random() < 0.1) for _ in range(6000)]
    calls, add = [], e.SliceSummary.add
    monkeypatch.setattr(e.SliceSummary, "add", lambda self, v, c: calls.append(1) or add(self, v, c))
    summary = e.SliceSummary(kind, domain)
    summary.add_all(rows)
    assert len(calls) < 3000 and (summary.n, summary.censored_n) == (6000, sum(c for _, c in rows))
    for entry in [None, *[draw(r) for _ in range(20)], domain[0], domain[1]]:
        assert summary.leave(entry, 0.5) == pytest.approx(plain(kind, rows, entry, 0.5), rel=1e-11)
    assert len({summary.leave(x, 0.5)[0] for x in domain}) == 1
