"""Streaks in one pass: cut and plain plans against a scan of each history."""

import random

import pytest
from pyspark.sql import functions as F

from spanwell.operators import history


def scan(rows, keyed=True):
    """``number, streak, ends, ended`` of each run, by a plain loop."""
    histories, out = {}, {}
    for key, i, success, limit in sorted(rows, key=lambda r: r[1]):
        seen = histories.setdefault(key if keyed else 0, {"n": 0, "streak": 0, "over": False})
        seen["streak"] = 0 if success else seen["streak"] + 1
        ends = not success and limit is not None and seen["streak"] >= limit
        out[i] = (seen["n"], seen["streak"], ends, seen["over"])
        seen["n"] += 1
        seen["over"] = seen["over"] or ends
    return out


def some_runs(seed, n, failing, limits):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot", "hot", "hot", "a", "b", None]), i,
         rng.choice([None, False]) if rng.random() < failing else True, rng.choice(limits))
        for i in range(n)
    ]


@pytest.mark.parametrize(("cut", "keys", "failing", "limits"), [
    (9, ["k"], 0.4, [3]),
    (9, ["k"], 0.97, [2, 60, None, 0]),
    (40, ["k"], 0.97, [30]),
    (40, [], 0.97, [2, 60, None, 0]),
    (9, [], 1.0, [30]),
    (10_000, ["k"], 0.97, [30]),
    (10_000, ["k"], 0.4, [2, 60, None, 0]),
])
def test_streaks_and_ends_equal_a_scan(spark, cut, keys, failing, limits):
    rows = some_runs(cut + len(keys), 300, failing, limits)
    runs = spark.createDataFrame(rows, "k string, i bigint, success boolean, limit int").repartition(4)
    want = scan(rows, bool(keys))
    got = history.with_streaks(runs, keys, ["i"], segment_rows=cut)
    assert got.columns == [*runs.columns, "run_number", "streak"]
    assert {r.i: (r.run_number, r.streak) for r in got.collect()} == {i: w[:2] for i, w in want.items()}
    done = history.executed_runs(runs, keys, ["i"], F.col("limit"), segment_rows=cut)
    assert {r.i: (r.run_number, r.streak, r.ends) for r in done.collect()} == {
        i: w[:3] for i, w in want.items() if not w[3]}


def test_cut_histories_take_one_pass(spark):
    """The ranges are joined with one small table, however many values a run needs."""
    runs = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") % 7 == 0).alias("success"))
    done = history.executed_runs(runs, ["k"], ["i"], F.lit(50), segment_rows=20)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and done.count() == 500


def test_no_runs(spark):
    runs = spark.createDataFrame([], "k string, i bigint, success boolean")
    assert history.with_streaks(runs, ["k"], ["i"]).count() == 0
    assert history.executed_runs(runs, [], ["i"], F.lit(1)).count() == 0
