"""Running values: the segmented plan must equal the plain one and a Python scan."""

import random

import pytest
from pyspark.sql import functions as F

from spanwell.operators.ordered import OrderedRows, Running, ordered


def sample_rows(seed, n):
    rng = random.Random(seed)
    keys = ["hot"] * 3 + ["a", "b", None]
    return [
        (rng.choice(keys), rng.randrange(n // 5), i,
         rng.choice([None, 1, 2, 3, 5]))
        for i in range(n)
    ]


def expected(rows, inclusive):
    out = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    for group in groups.values():
        total, last, top, low, count = 0, None, None, None, 0
        for key, t, i, v in sorted(group, key=lambda r: (r[1], r[2])):
            before = (total, last, top, low)
            if v is not None:
                total += v
                last = v
                top = v if top is None else max(top, v)
                low = v if low is None else min(low, v)
            out[i] = (total, last, top, low) if inclusive else before
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("limit", [7, 60, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_matches_scan(spark, inclusive, limit, keys):
    rows = sample_rows(limit, 400)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint").repartition(5)
    prepared = ordered(df, keys, ["t", "i"], segment_rows=limit)
    assert prepared.segmented == (limit < 400 or not keys)
    got = prepared.running(
        total=Running("sum", F.col("v"), inclusive),
        final=Running("last", F.col("v"), inclusive),
        top=Running("max", F.col("v"), inclusive),
        low=Running("min", F.col("v"), inclusive),
    ).done()
    assert got.columns == ["k", "t", "i", "v", "total", "final", "top", "low"]
    seen = {r.i: (r.total, r.final, r.top, r.low) for r in got.collect()}
    flat = rows if keys else [("all", *r[1:]) for r in rows]
    assert seen == expected(flat, inclusive)


def test_one_order_value_holding_most_rows_is_still_cut(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), F.lit(1).alias("t"), F.col("id").alias("i"))
    prepared = ordered(df, ["k"], ["t", "i"], segment_rows=100)
    sizes = [r["count"] for r in prepared.rows.groupBy("__seg").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 900
    numbered = prepared.running(n=Running("sum", F.lit(1))).done()
    assert numbered.where(F.col("n") != F.col("i") + 1).count() == 0


def test_keyless_passes_have_no_window_in_one_task(spark):
    """Only sums by range, a row for each, may meet in one partition."""
    df = spark.range(5000).select(F.col("id").alias("i"))
    numbered = ordered(df, [], ["i"]).running(n=Running("sum", F.lit(1))).done()
    assert numbered.where(F.col("n") != F.col("i") + 1).count() == 0
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Generate" not in plan


def test_many_segments(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"))
    prepared = ordered(df, [], ["i"], segment_rows=100)
    assert prepared.rows.select("__seg").distinct().count() > 100
    numbered = prepared.running(n=Running("sum", F.lit(1))).done()
    assert numbered.where(F.col("n") != F.col("i") + 1).count() == 0


def test_chained_running_values(spark):
    rows = sample_rows(3, 500)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")

    def twice(limit):
        first = ordered(df, ["k"], ["t", "i"], segment_rows=limit).running(
            n=Running("sum", F.lit(1)), last_v=Running("last", F.col("v")))
        return first.running(m=Running("max", F.col("n") * F.col("last_v"), False)).done()

    assert sorted(map(str, twice(9).collect())) == sorted(map(str, twice(10**6).collect()))


def test_unknown_running_value(spark):
    df = spark.range(2)
    with pytest.raises(ValueError):
        OrderedRows(df, (), ("id",), False).running(x=Running("median", F.col("id")))


def test_light_keys_get_as_many_partitions_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr("spanwell.operators.ordered.TASK_ROWS", 100)
    df = spark.range(4000).select((F.col("id") % 50).alias("k"), F.col("id").alias("i"))
    prepared = ordered(df, ["k"], ["i"])
    assert not prepared.segmented and prepared.rows.rdd.getNumPartitions() == 40
    done = prepared.running(n=Running("sum", F.lit(1))).done()
    assert done.rdd.getNumPartitions() == 40 and {(r.k, r.n) for r in done.collect()} == {(k, n + 1) for k in range(50) for n in range(80)}
