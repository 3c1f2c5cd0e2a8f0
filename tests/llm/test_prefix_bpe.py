"""Encoding equals the library's; tables grow and are edited exactly."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spanwell.llm import prefix_bpe as bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "the", " in", "é", "'s", "'r", "e", " ", "\n", "\t", "ß", "あ", "😀", "12", "!", "́", "\xa0", "\x1c", "thing"]


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as file:
        return bpe.Encoder(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def texts(seed, n, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_equals_the_library(encoder, library):
    cases = ["", " ", "  \n ", "a" * 5000, "ab" * 3000, "<|endoftext|>", *texts(1, 1500)]
    assert encoder.many(cases) == [library.encode_ordinary(t) for t in cases]
    assert all(encoder.decode(encoder.ids(t)) == t.encode() for t in cases)


def test_documents_equal_the_library(spark, encoder, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for (text,) in rows:
        assert encoder.ids(text or "") == library.encode_ordinary(text or "")


def test_appends_are_exact(encoder, library):
    for a, b in zip(texts(2, 800), texts(3, 800, 8)):
        assert encoder.appended(encoder.ids(a), b) == library.encode_ordinary(a + b)


def test_tables_grow_and_change_exactly(encoder):
    rng = random.Random(4)
    for a, b in zip(texts(5, 400), texts(6, 400, 6)):
        a, b = a.encode(), b.encode()
        table = bpe.PrefixTable(encoder.vocabulary, a)
        table.append(b)
        assert table.last == bpe.PrefixTable(encoder.vocabulary, a + b).last
        start = rng.randint(0, len(a))
        stop = rng.randint(start, len(a))
        table.replace(start, stop, b)
        assert table.last == bpe.PrefixTable(encoder.vocabulary, a[:start] + b + a[stop:] + b).last


def test_an_edit_redoes_only_what_it_touches(encoder):
    table = bpe.PrefixTable(encoder.vocabulary, b"abcde" * 4000)
    assert table.replace(100, 101, b"x") < 600


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "héllo wörld", None), (3, "héllo wörld", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r.doc_id, len(r.ids), bytes(r.decoded).decode()) for r in out.collect())
    assert [(g[0], g[2]) for g in got] == [(1, ""), (2, ""), (3, "héllo wörld"), (3, "héllo wörld")] and got[0][1] == got[1][1] == 0
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_appending_to_a_table_of_ids(spark, library):
    df = spark.createDataFrame([(1, "don'", "t go"), (2, None, "new"), (3, "kept", None)], "i int, text string, more string")
    out = bpe.append(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    got = {r.i: r.ids for r in out.collect()}
    assert got == {1: library.encode_ordinary("don't go"), 2: library.encode_ordinary("new"), 3: library.encode_ordinary("kept")}


def test_query(spark, library):
    import hashlib

    from spanwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        r = got.pop(doc_id)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert not got
