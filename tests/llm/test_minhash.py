"""Near-duplicates by Jaccard similarity against brute force over whole sets of shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanwell.llm import minhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain_labels(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[top(i)] = top(j)
    low = {}
    for i, (name, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), name), name)
    return {name: low[top(i)] for i, (name, _) in enumerate(rows)}


def edited():
    """Texts and copies of them with a few words changed: many pairs of 0.75 to 0.95, and chains."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            words = words[:]
            for _ in range(max(1, len(words) * rng.choice([1, 2, 3, 4]) // 100)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [3, 2048])
def test_components_equal_brute_force(spark, block):
    rows = edited()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), block=block).collect()}
    expected = plain_labels(rows)
    assert 60 < len(set(expected.values())) < 250
    assert got == expected


def test_pipeline_stage_equals_brute_force(spark):
    """Near copies of 0.8 and more go, of which fingerprints within four bits are but a few."""
    rows = edited()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], f"{DOCS}, lang string, source string, n_chars bigint")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert got == set(plain_labels(rows).values())


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) >= 50").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_labels([tuple(r) for r in docs.collect()])


def test_defined_cases(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(3, None), (2, ""), (None, long), (7, long.upper()), (7, long.upper()), (9, long + " end"), (5, "a b"), (6, "a b c"), (4, "A  b")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 7), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (9, 7)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_plans():
    bands, least = minhash.make_plan(0.8, 0.999)
    assert 1 - (1 - 0.8**minhash.ROWS) ** bands >= 0.9995 and 0 < least < bands * minhash.ROWS


def test_bitmaps_rule_out_no_key(spark):
    rows = [(i, i * 31, "x") for i in range(300)] + [(None, 5, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text_key bigint, part string").withColumn("bits", F.lit(1))
    keys = docs.where("doc_id % 3 = 0 or doc_id is null").select("doc_id", "text_key")
    for asked, n in ((keys, 101), (keys.limit(0), 0)):
        marks = minhash._marks(asked)
        near, far = (minhash._marked(docs, marks, F.col("doc_id"), F.col("text_key"), how) for how in ("left_semi", "left_anti"))
        assert near.columns == docs.columns and near.count() + far.count() == 301
        assert near.join(asked, ["text_key"], "left_semi").count() == n


def test_near_fingerprints_are_compared(spark):
    """Every two sets whose fingerprints differ in four bits at most are joined by pairs to compare."""
    rows = edited()
    docs = minhash._keyed(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    distinct = minhash._sketches(docs, 5, 2).dropDuplicates(["node"]).cache()
    prints = {r.node: r.fp % (1 << 64) for r in distinct.collect()}
    root = {node: node for node in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in minhash._fingerprint_pairs(distinct).collect():
        root[top(r.a)] = top(r.b)
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert near and all(top(a) == top(b) for a, b in near)
