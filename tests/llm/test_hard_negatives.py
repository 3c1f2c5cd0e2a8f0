"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwell.llm import hard_negatives as hard
from spanwell.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=50, positives=5, negatives=3):
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of rows (id, vector, label)."""
    kept = [(i, v, label) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    whole = [[min(2**63 - 1, math.floor(256 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    labels = [(label + 1) % 10 if i % 7 == 0 else label for i, _, label in kept]
    out = []
    for a, (name, _, _) in enumerate(kept):
        if name % every:
            continue
        scored = sorted(
            ((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a], v)))), kept[b][0], b)
             for b, v in enumerate(whole) if b != a))
        for minus, other, _ in [s for s in scored if labels[s[2]] == labels[a]][:positives]:
            fits = [s for s in scored if labels[s[2]] != labels[a] and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(name, other, rank + 1, s[1], -minus, -s[0]) for rank, s in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("bucket", F.lit(1)).repartition(3)
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return sorted(tuple(r) for r in hard.mine(df, vec_id, F.col("embedding"), moved, vec_id % 50 == 0, **options).collect())


def clustered(seed, n, width=16, spread=0.3):
    """Rows of unequal length around a few centres, with ties and equal vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    vectors = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))
    vectors *= rng.choice([0.05, 0.3, 1.0], (n, 1)) / 4
    vectors[1::9] = vectors[0]
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(vectors)]


def test_equals_brute_force_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(hard, "ROWS", 64)
    monkeypatch.setattr(hard, "ANCHORS", 5)
    rows = clustered(1, 900)
    expected = plain(rows)
    assert len(expected) > 50 and mined(spark, rows) == expected


def test_equals_brute_force_in_one_bucket(spark):
    rows = clustered(2, 300, width=5)
    assert mined(spark, rows) == plain(rows)


def test_nulls_widths_and_repeats(spark):
    rows = clustered(3, 120, width=4)
    rows += [(100, None, 1), (50, [None, 1.0], 2), (150, [math.nan], 1), (200, [math.inf, 0.0], 1), (250, [0.5] * 4, None),
             (None, [0.5] * 4, 1), (300, [], 1), (350, [0.25, 0.5], 2), (350, [0.25, 0.5], 2), (400, [0.0] * 4, 3), (0, [0.1] * 4, 0)]
    rows += rows[:8]
    expected = plain(rows)
    assert {r[0] for r in expected} >= {0, 350} and mined(spark, rows) == expected


def test_scores_beyond_doubles(spark):
    rows = [(i, [3.0e6 + 1e5 * (i % 5), -1.0e6 * (i % 3)], i % 2) for i in range(101)]
    expected = plain(rows)
    assert all(2**53 < s < 2**63 for r in expected for s in r[4:]) and expected and mined(spark, rows) == expected
    vast = [(i, [1e30 if i % 3 else 1e6, 1.0], i % 2) for i in range(51)]  # all beyond a long but those among thirds
    assert mined(spark, vast) == plain(vast)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, None, 1)]) == []
    assert mined(spark, [(50, [0.5], 1), (51, [0.5], 2)]) == []


def test_pruned_candidates_lose_nothing():
    """Rows outside of the ranges can't reach the bound, and on clustered rows most are outside."""
    import pyarrow as pa

    rows = clustered(4, 1000, width=32, spread=0.05)
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    table = pa.table({"vec_id": [r[0] for r in rows], "row": [r[0] for r in rows], "label": [r[2] for r in rows],
                      "v": pa.array(whole, pa.list_(pa.int16()))})
    bucket = hard.Bucket(table, hard.Shape(32, True))
    anchors = bucket.vectors[::10]
    scores = anchors @ bucket.vectors.T
    bound = np.sort(scores, axis=1)[:, -6].astype(float)
    found = bucket.candidates(anchors, bound)
    assert found[scores >= bound[:, None]].all() and found.mean() < 0.5
    exact = bucket.scores(anchors, bound)
    assert (exact[scores >= bound[:, None]] == scores[scores >= bound[:, None]]).all()


@pytest.mark.parametrize("score,low,high", [(100, 50, 95), (101, 51, 95), (-10, -5, -10), (0, 0, 0), (-1, 0, -1)])
def test_window(score, low, high):
    assert hard.window(score, 50, 95) == (low, high)


def test_query_equals_sql(spark):
    name = "op13_hard_negatives"
    assert compare(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None
