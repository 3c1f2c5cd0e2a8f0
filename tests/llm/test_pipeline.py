"""The pipeline against a brute-force version of every stage."""

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spanwell.llm import line_dedup, mixing
from spanwell.llm.prefix_bpe import read_ranks
from spanwell.llm.queries import MIN_SITES, MIX_SEED, MIX_WEIGHTS, domain_sql
from spanwell.llm.text_stats import COUNTS, text_counts
from tests.llm.test_minhash import plain_labels
from tests.llm.test_quality import plain_trust

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_votes(c):
    n, cased = c["n_words"], c["n_upper"] + c["n_lower"]
    return (
        -(10 * c["n_symbols"] > n), -(10 * c["n_upper"] > 3 * cased and cased >= 20), -(10 * c["n_exclaims"] > n),
        -(2 * c["n_repeat_words"] > n), -(10 * c["n_distinct_words"] < n and n >= 50), -(2 * c["n_dup_lines"] > c["n_lines"] and c["n_lines"] >= 4),
        -(c["word_chars"] < 2 * n or c["word_chars"] > 20 * n),
        +(n > 0 and 20 * c["n_symbols"] < n and 20 * c["n_exclaims"] < n and (4 * c["n_upper"] < cased or cased < 20)),
    )


def plain_quality(docs):
    counts = [dict(zip(COUNTS, text_counts(None if d[1] is None else d[1].encode()))) for d in docs]
    votes = [tuple(int(v) for v in plain_votes(c)) for c in counts]
    cases = sorted({v: votes.count(v) for v in votes}.items())
    good, rate = plain_trust(cases, list(range(8)))
    evidence = np.log(rate[:, 1] / rate[:, 0])
    evidence[:, 0], evidence[:, 2] = np.minimum(evidence[:, 0], 0), np.maximum(evidence[:, 2], 0)
    kept = []
    for d, c, v in zip(docs, counts, votes):
        odds = np.log(good / (1 - good)) + sum(evidence[j][v[j] + 1] for j in range(8))
        if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] and odds >= 0:
            kept.append(d)
    return kept


def queried(docs, sql):
    con = duckdb.connect()
    table = {c: [d[i] for d in docs] for i, c in enumerate(COLUMNS)}
    con.register("documents", pa.table(table))
    return con.execute(sql).fetchall()


def plain_lines(docs):
    found = {r[0]: r for r in queried(docs, line_dedup.SQL.format(min_sites=MIN_SITES))}
    return [(d[0], found[d[0]][1], *d[2:4], len(found[d[0]][1]) if found[d[0]][3] else d[4]) for d in docs]


def plain_near(docs):
    """One of each component of brute-force similarities of 0.8."""
    low = plain_labels([(d[0], d[1]) for d in docs])
    return [d for d in docs if d[0] == low[d[0]]]


def plain_mix(docs):
    levels = {"domain": domain_sql(), "lang": "lang", "source": "source"}
    taken = {r[0] for r in queried(docs, mixing.sql(levels, MIX_WEIGHTS, corpus_pipeline.MIX_SHARE, 1, MIX_SEED))}
    return [d for d in docs if d[0] in taken]


def plain_tokens(docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(file.read()), special_tokens={})
    return [(d[0], d[2], d[3], library.encode_ordinary(d[1] or "")) for d in docs]


def test_pipeline_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    expected = docs
    for stage in (plain_quality, plain_lines, plain_near, plain_mix):
        before, expected = expected, stage(expected)
        assert expected and expected != before or stage is plain_lines
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in got) == sorted(plain_tokens(expected))
    assert all(r.n_tokens == len(r.ids) for r in got)


def spoilt(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    text = " ".join(f"word{i} and" for i in range(60)) + "."
    rows = [(1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (2, None, "en", "src1", 0), (3, "", None, None, None), (None, text + " x", "de", "src2", 3),
            (4, text + " more of the same words here\n" * 900, None, None, None), (5, "z " * 80, "fr", "src3", 1), (6, text.replace("word", "other"), "es", None, 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("number", range(5))
def test_stages_take_any_rows(spark, number):
    stage = corpus_pipeline.STAGES[number][1]
    for df in (spoilt(spark), spoilt(spark).limit(0)):
        out = stage(spark, df, SF)
        rows = out.collect()
        if number < 4:
            assert out.columns == COLUMNS
        assert bool(rows) == bool(df.limit(1).count())


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, spoilt(spark), SF).collect()]
    assert got.count(1) == 1 and got.count(None) == 1 and 6 in got and 2 in got and 3 not in got


def test_near_copy_goes_though_its_id_names_another_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text), (7, text + " end"), (7, "quite another text of its own"), (8, text), (8, text), (9, "twice"), (9, "twice")]
    df = spark.createDataFrame([(i, t, "en", "s", j) for j, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({name: F.lit(1) for name in ("kept_id", "kept_n", "node", "root", "n", "text_key", "row")})
    for _ in range(2):
        got = sorted((r.doc_id, r.text[:5], r.n_chars) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
        assert [g[:2] for g in got] == [(3, "word0"), (7, "quite"), (9, "twice")]


def test_lines_stage_sets_the_number_of_characters(spark):
    df = spark.createDataFrame([(i, f"own line of {i} with its words\nshared line", "en", f"src{i}", 7) for i in range(12)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r for r in corpus_pipeline.lines(spark, df.withColumn("n_lines", F.lit(1)), SF).collect()}
    assert out[0].n_chars == 7 and all(out[i].n_chars == len(out[i].text) < 40 for i in range(1, 12)) and out[3].n_lines == 1
