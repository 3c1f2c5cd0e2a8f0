"""Lookups with and without heavy keys, small and large."""

import pytest
from pyspark.sql import functions as F

from spanwell.operators import metrics, sizing


@pytest.mark.parametrize("heavy_rows", [10**6, 50])
def test_salted_lookup(spark, heavy_rows):
    rows = [("hot" if i % 3 else (None if i % 2 else f"k{i % 5}"), i) for i in range(600)]
    big = spark.createDataFrame(rows, "k string, i bigint").repartition(4)
    lookup = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = sizing.salted_lookup(big, lookup, ["k"], ["i"], heavy_rows=heavy_rows).collect()
    n = {}
    for k, _ in rows:
        n[k] = n.get(k, 0) + 1
    assert len(got) == 600
    assert {(r.k, r.i, r.n) for r in got} == {(k, i, n[k]) for k, i in rows}


def test_keep_matching(spark):
    big = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    lookup = spark.createDataFrame([(1,), (7,), (99,)], "k bigint")
    kept = sizing.keep_matching(big, lookup, ["k"])
    assert sorted((r.k, r.id) for r in kept.collect()) == sorted(
        (i % 10, i) for i in range(100) if i % 10 in (1, 7))


def test_relative_to_first(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 0.0), ("b", 2, 1.0), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "label string, seq int, elapsed double")
    got = {(r.label, r.seq): r.ratio for r in metrics.relative_to_first(df, ["label"], ["seq"]).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.5, ("b", 1): None, ("b", 2): None, (None, 1): 1.0}


def test_whole_number_totals_do_not_overflow(spark):
    from spanwell.operators import spans

    df = spark.range(4).select(
        F.lit(None).cast("string").alias("start_phase"), F.lit(None).cast("string").alias("end_phase"),
        F.lit("x").alias("event_type"), F.lit(2**62).alias("elapsed"))
    assert int(spans.span_stats(df).first().total_elapsed_time) == 2**64
