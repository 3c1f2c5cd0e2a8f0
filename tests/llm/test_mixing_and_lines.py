"""Mixing and line dedup against their SQL, and their defined cases."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from spanwell.llm import line_dedup, mixing
from spanwell.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string"


def sql_rows(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("name", ["op4_source_mix", "op5_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


LEVELS = {"lang": "lang", "source": "source"}
WEIGHTS = [{("en",): 3}, {("s1",): 2, ("en", "s2"): 5}]


def mix_rows():
    rows = []
    for i, (lang, source) in enumerate(itertools.product(["en", "de", None], ["s1", "s2", None])):
        for k in range(3 + 9 * (i == 1)):
            rows.append((100 * i + k, "w " * (1 + (7 * k + i) % 13), lang, source))
    return [*rows, (1000, None, "en", "s1"), (1001, "", "fr", "s9")]


@pytest.mark.parametrize("share, epochs", [((0, 1), 1), ((1, 3), 1), ((2, 3), 2), ((1, 1), 1), ((5, 2), 3), ((9, 1), 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    rows = mix_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df, {c: F.col(c) for c in LEVELS}, WEIGHTS, share, epochs, 5).select(
        "doc_id", "lang", "source", mixing.n_words(F.col("text")).alias("tokens"), "copies")
    assert sorted(map(tuple, got.collect()), key=str) == sql_rows(mixing.sql(LEVELS, WEIGHTS, share, epochs, 5), rows)


def test_shortages_go_to_siblings_before_other_branches(spark):
    held = [("en", "a", 10), ("en", "b", 1000), ("de", "a", 1000), ("de", "b", 1000)]
    leaves = spark.createDataFrame(held, "level_0 string, level_1 string, held bigint")
    found = {(r.level_0, r.level_1): r.budget for r in mixing.leaf_budgets(leaves, ["level_0", "level_1"], [{}, {}], (800, 3010), 1).collect()}
    assert found == {("en", "a"): 10, ("en", "b"): 390, ("de", "a"): 200, ("de", "b"): 200}
    # a branch that is used up passes its rest on to the other branch
    short = spark.createDataFrame([("en", "a", 10), ("en", "b", 30), ("de", "a", 1000)], "level_0 string, level_1 string, held bigint")
    found = {(r.level_0, r.level_1): r.budget for r in mixing.leaf_budgets(short, ["level_0", "level_1"], [{}, {}], (500, 1040), 1).collect()}
    assert found == {("en", "a"): 10, ("en", "b"): 30, ("de", "a"): 460}


def test_mixing_defined_cases(spark):
    df = spark.createDataFrame(mix_rows(), DOCS).withColumn("copies", F.lit("old")).withColumn("last_key", F.lit(1)).withColumn("tokens", F.lit(2))
    levels = {c: F.col(c) for c in LEVELS}
    whole = mixing.mixed(df, levels, [{}, {}], (1, 1))
    assert whole.columns == ["doc_id", "text", "lang", "source", "last_key", "tokens", "copies"]
    assert whole.count() == df.count() and whole.where("copies <> 1").count() == 0
    assert mixing.mixed(df.limit(0), levels, [{}, {}], (1, 2)).collect() == []
    twice = spark.createDataFrame([(1, "a b", "en", "s")] * 4 + [(None, "c d", "en", "s")], DOCS)
    taken = mixing.mixed(twice, levels, [{}, {}], (1, 10)).groupBy("doc_id").count().collect()
    assert [(r.doc_id, r["count"]) for r in taken] in ([(1, 4)], [(None, 1)])


def line_rows():
    rows = []
    for site in range(14):
        own = f"own words of number {site} that nobody else has at all\n"
        rows.append((site, own + "on all\n" + ("on ten\n" if site < 10 else "") + ("on nine\n" if site < 9 else "") + " \n", "en", f"s{site}"))
    rows += [(100 + i, f"text {i} is only here and long enough\non one site", "en", "s1") for i in range(30)]
    rows += [(200 + i, "on all\non ten", "en", f"s{i}") for i in range(3)]  # copies: nothing of their own
    return [*rows, (300, None, "en", "s1"), (301, "", "en", None), (302, "some own words are here\non all", None, None)]


@pytest.mark.parametrize("lg_k, margin", [(10, 0.2), (4, 0.9)])
def test_lines_equal_sql(spark, lg_k, margin):
    rows = line_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = line_dedup.remove_shared_lines(df, lg_k=lg_k, margin=margin).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect()), key=str) == sql_rows(line_dedup.SQL.format(min_sites=10), rows)


def test_only_shared_lines_go(spark):
    df = spark.createDataFrame(line_rows(), DOCS)
    texts = {r.doc_id: r.text for r in line_dedup.remove_shared_lines(df).collect()}
    assert texts[0].count("on all") == 1  # the first document keeps it
    assert "on all" not in texts[5] and "on ten" not in texts[5] and "on nine" in texts[5] and "own words of number 5" in texts[5]
    assert texts[200] == "" and texts[100].endswith("on one site")
    spared = {r.doc_id: r.text for r in line_dedup.remove_shared_lines(df, spare_copies=True).collect()}
    assert spared[200] == "on all\non ten" and spared[5] == texts[5]
    everywhere = {r.doc_id: r.text for r in line_dedup.remove_shared_lines(df, keep_first=False).collect()}
    assert "on all" not in everywhere[0]


def test_line_defined_cases(spark):
    df = spark.createDataFrame([*line_rows(), *line_rows()[:2]], DOCS).withColumn("line", F.lit(1)).withColumn(
        "n_lines", F.lit("old")).withColumn("words", F.lit(2)).withColumn("row_a", F.lit(3))
    out = line_dedup.remove_shared_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "line", "words", "row_a", "n_lines", "n_removed"]
    assert out.count() == df.count()
    assert line_dedup.remove_shared_lines(df.limit(0)).collect() == []
    nobody = spark.createDataFrame([(None, f"only here {i} with words\nshared", "en", f"s{i}") for i in range(12)], DOCS)
    assert {r.n_removed for r in line_dedup.remove_shared_lines(nobody).collect()} == {1}
