"""Words, tree reduction, sampled text and matrices on small inputs."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwell.operators import matrix, words
from spanwell.plans import inputs


def counts(df):
    return {r["word"]: r["count"] for r in df.collect()}


def test_words(spark):
    df = spark.createDataFrame([("King's  LEAR 3x",), ("",), ("KK éa\nb",), (None,)], "text string")
    assert [r[0] for r in df.select(words.words(F.col("text"))).collect()] == [
        ["king", "s", "lear", "x"], [], ["k", "a", "b"], None]
    assert counts(words.word_count(df)) == {
        "king": 1, "s": 1, "lear": 1, "x": 1, "k": 1, "a": 1, "b": 1}


def test_merge_and_top(spark):
    x = spark.createDataFrame([("a", 1)], "word string, count bigint")
    y = spark.createDataFrame([("a", 2), ("b", 3)], "word string, count bigint")
    merged = words.merge_counts(x, y)
    assert counts(merged) == {"a": 3, "b": 3}
    assert [tuple(r) for r in words.top_words(merged).collect()] == [("a", 3)]
    assert words.top_words(merged.limit(0)).collect() == []


def test_vocabulary_keeps_case_apostrophes_and_blank_lines(spark):
    df = spark.createDataFrame([("King's LEAR,\n\n  the -- the\n",)], "text string")
    assert counts(words.vocabulary(df)) == {"King's": 1, "LEAR": 1, "": 2, "the": 2}


@pytest.mark.parametrize("limit", [10**6, 30])
def test_generated_text_draws_by_source_frequency(spark, limit):
    text = "a a a a a a b b b c\nd's"
    df = spark.createDataFrame([(text,)], "text string")
    sampled = words.generate_text(
        words.split_ids(spark, 40), words.vocabulary(df), 50, seed=3, segment_rows=limit)
    rows = sampled.collect()
    assert len(rows) == 2000 and len({(r.split_id, r.pos) for r in rows}) == 2000
    share = Counter(r.word for r in rows)
    assert set(share) == {"a", "b", "c", "d's"}
    assert abs(share["a"] / 2000 - 6 / 11) < 0.05 and abs(share["b"] / 2000 - 3 / 11) < 0.05
    texts = {r.split_id: r.text for r in words.split_texts(sampled).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r.split_id, r.pos)):
        want.setdefault(r.split_id, []).append(r.word)
    assert texts == {k: " ".join(v) for k, v in want.items()}


def test_whole_word_count_workload(spark):
    df = spark.createDataFrame([("one two\ntwo three's",)], "text string")
    made = words.split_texts(words.generate_text(words.split_ids(spark, 3), words.vocabulary(df), 20))
    got = counts(words.word_count(made))
    want = Counter(w.lower() for r in made.collect() for w in re.sub("[^a-zA-Z]", " ", r.text).split())
    assert got == dict(want) and sum(got.values()) >= 60


def add_counts(x, y):
    return pd.concat([x, y]).groupby("word", as_index=False)["count"].sum()


def test_tree_reduce_by_key_equals_group_by(spark):
    rows = [(f"w{i % 7 if i % 3 else 0}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "word string, count bigint").repartition(6)
    reduced = words.tree_reduce(df, add_counts, keys=["word"])
    assert reduced.count() == 7
    want = Counter()
    for w, c in rows:
        want[w] += c
    assert counts(reduced) == dict(want)


def test_tree_reduce_to_one_value_and_of_nothing(spark):
    df = spark.range(1000).select(F.lit("x").alias("word"), F.col("id").alias("count"))
    assert counts(words.tree_reduce(df, add_counts, fan_in=2)) == {"x": 499500}
    assert words.tree_reduce(df.limit(0), add_counts).collect() == []


def dense(cells, n, m):
    out = np.zeros((n, m))
    for r in cells.collect():
        out[r.row, r.col] = r.v
    return out


def coordinates(spark, array):
    cells = [(i, j, float(v)) for (i, j), v in np.ndenumerate(array)]
    return spark.createDataFrame(cells, "row bigint, col bigint, v double")


@pytest.mark.parametrize("tile", [1, 2, 8])
def test_squared_block_matrix(spark, tile):
    a = matrix.generate_blocks(matrix.block_places(spark, 3), 4, seed=2)
    again = matrix.generate_blocks(matrix.block_places(spark, 3).repartition(5), 4, seed=2)
    x = dense(matrix.from_blocks(a, 4), 12, 12)
    assert np.array_equal(x, dense(matrix.from_blocks(again, 4), 12, 12))
    assert 0 <= x.min() and x.max() < 1 and len(np.unique(x)) == 144
    made = matrix.multiply_blocks(a, a, 4, tile=tile)
    assert made.count() == 9
    assert np.allclose(dense(matrix.from_blocks(made, 4), 12, 12), x @ x)


def test_cell_product_with_ragged_sizes(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 7)), rng.random((7, 3))
    made = matrix.multiply_cells(coordinates(spark, a), coordinates(spark, b), dim=3)
    assert np.allclose(dense(made, 5, 3), a @ b)


def test_product_of_unequal_inner_sizes_is_an_error(spark):
    a = matrix.generate_blocks(matrix.block_places(spark, 2), 2)
    b = matrix.generate_blocks(matrix.block_places(spark, 3), 2)
    with pytest.raises(ValueError, match="inner sizes differ"):
        matrix.multiply_blocks(a, b, 2)


def test_vectors_and_block_transpose(spark):
    x = np.arange(35.0).reshape(5, 7)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")
    blocks = matrix.vectors_to_blocks(df, "id", "v", 4)
    assert np.array_equal(dense(matrix.from_blocks(blocks, 4, 5, 7), 5, 7), x)
    turned = matrix.transpose_blocks(blocks, 4)
    assert np.array_equal(dense(matrix.from_blocks(turned, 4, 7, 5), 7, 5), x.T)


def test_transpose_cuts_to_the_shortest_row(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0)]
    df = spark.createDataFrame(rows, "row bigint, col bigint, v double")
    assert sorted(map(tuple, matrix.transpose_cells(df).collect())) == [
        (0, 0, 1.0), (0, 1, 4.0), (1, 0, 2.0), (1, 1, 5.0)]


def test_sum_of_many_blocks_of_one_place(spark):
    parts = spark.range(300).select(
        F.lit(0).cast("bigint").alias("i"), (F.col("id") % 2).alias("j"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(7)
    got = {r.j: r.v for r in matrix.sum_blocks(parts).collect()}
    assert got == {0: [float(sum(range(0, 300, 2))), 150.0], 1: [float(sum(range(1, 300, 2))), 150.0]}


@pytest.mark.parametrize("limit", [10**6, 4])
def test_chunks_match_list_slices(spark, limit):
    for length, n in [(10, 4), (9, 6), (1, 3), (29, 7), (12, 12)]:
        size = (length - 1) // n + 1
        want = [list(range(i, min(i + size, length))) for i in range(0, length, size)]
        got = {}
        for r in matrix.chunk_rows(spark.range(length), ["id"], n, segment_rows=limit).collect():
            got.setdefault(r.chunk, []).append(r.id)
        assert [sorted(got[k]) for k in sorted(got)] == want
        texts = spark.range(1).select(F.array(*[F.lit(str(i)) for i in range(length)]).alias("a"))
        assert texts.select(matrix.chunk_array(F.col("a"), n)).first()[0] == [[str(i) for i in c] for c in want]


def test_chunks_of_nothing(spark):
    assert matrix.chunk_rows(spark.range(0), ["id"], 3).count() == 0
    empty = spark.range(1).select(F.array().cast("array<string>").alias("a"))
    assert empty.select(matrix.chunk_array(F.col("a"), 3)).first()[0] == []


def test_heavy_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("spanwell.plans.inputs.SPREAD_ROWS", 100)
    for name, key, n in (("orders", "o_orderkey", 1500), ("part", "p_partkey", 200)):
        rows = inputs.spread_table(spark, "/root/testdata/sf0.001", name, key)
        assert rows.count() == n and rows.rdd.getNumPartitions() == max(4, n // 100)
