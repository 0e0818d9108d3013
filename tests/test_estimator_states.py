"""The answers read the estimator's states for every level; the fold behind them runs once."""

from pyspark.sql import functions as F

from runlens.plans import estimates


def test_states_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    keys = [(i, "t", "c" if i < 4 else "", "x" if i < 3 else "", "a" if i < 2 else "", "f" if i < 1 else "", 3, 0, 2.0 + i, 0.36) for i in range(5)]
    schema = "level int, template string, class_id string, through_act string, arm_set string, code_family string, n long, censored_n long, state double, variance double"
    states = spark.createDataFrame(keys, schema).mapInArrow(count, schema)
    jobs = spark.createDataFrame([(1, "t", "c", "x", "a", "f"), (2, "t", "c", "x", "b", "f"), (3, "t", "d", "x", "a", "f"), (4, "u", "c", "x", "a", "f")], "job int, template string, class_id string, through_act string, arm_set string, code_family string")
    jobs = jobs.withColumns({"hint_p50": F.lit(None).cast("double"), "hint_p90": F.lit(None).cast("double")})
    defaults = spark.createDataFrame([("c", 40.0)], "class_id string, class_p75 double")
    got = estimates.answer_estimates(jobs, states, defaults).orderBy("job").collect()
    assert [r.est_source for r in got] == ["exact", "no-arm-set", "runner-wide", "class-default"]
    assert seen.value == 5
