"""Components, blocks of hot groups, and whole groups of sorted batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwell.llm import common


def reached(links):
    """Brute force: the smallest node that each node reaches."""
    label = {x: x for pair in links for x in pair}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], moved = low, True
    return {x: low for x, low in label.items() if x != low}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(5, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)],
    [(i, i + 7) for i in range(0, 50, 3)] + [(-4, 12), (9, 9)],
])
def test_components(spark, links):
    df = spark.createDataFrame(links + [(None, 2)], "a bigint, b bigint")
    got = {r.node: r.component for r in common.components(df).collect()}
    assert got == reached([x for x in links if x[0] != x[1]])


def test_random_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == reached([x for x in links if x[0] != x[1]])


def test_stars_reach_the_smallest():
    a, b = common.stars(np.array([9, 4, 7, 20]), np.array([4, 7, 2, 21]))
    assert dict(zip(a.tolist(), b.tolist())) == {4: 2, 7: 2, 9: 2, 21: 20}
    assert [len(x) for x in common.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("limit", [3, 1000])
def test_every_pair_of_a_group_meets_in_one_block(spark, limit):
    df = spark.range(40).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("j"), "id")
    rows = common.blocks(df, ["k", "j"], "id", limit).collect()
    met = {}
    for r in rows:
        met.setdefault((r.k, r.j, r.near, r.far), []).append((r.chunk, r.id))
    pairs = []
    for (k, j, near, far), found in met.items():
        pairs += [(x, y) for c, x in found for d, y in found if x < y and (near == far or c != d)]
    source = df.collect()
    expected = [(a.id, b.id) for a in source for b in source if a.id < b.id and (a.k, a.j) == (b.k, b.j)]
    assert sorted(pairs) == sorted(expected)


def test_whole_groups():
    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b])], ["k"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 9), (9, 11))]
    tables = [t.column("k").to_pylist() for t in common.whole_groups(iter(batches), ["k"])]
    assert sum(tables, []) == keys
    assert len({k for t in tables for k in set(t)}) == sum(len(set(t)) for t in tables)
    assert list(common.whole_groups(iter([]), ["k"])) == []


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("Row"), F.lit(2).alias("row_"))
    assert common.fresh(df, "row") == "row__"
