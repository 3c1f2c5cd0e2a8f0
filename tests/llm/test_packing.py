"""Packing: every id in exactly one piece, in sequences that are full but for the last."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwell.llm import packing
from spanwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def packed(df, **options):
    return packing.sequences(df, VOCABULARY, 1, F.col("doc_id"), F.col("text"), **options)


def checked(rows, texts, ids_of, length):
    """Pieces of ``(doc_id, ids)`` documents hold every id once, and leave no gap in a sequence."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(texts)
    for name, found in by_doc.items():
        ids, at = np.array(ids_of(texts[name]), dtype="<u4"), 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for number, found in by_sequence.items():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or number == max(by_sequence) and at < length
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query_equals_the_library(spark, ids_of):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    checked(QUERIES["op12_packing"](spark, SF).collect(), docs, ids_of, packing.LENGTH)


@pytest.mark.parametrize("length,parts", [(8, 7), (64, 3), (2048, 1)])
def test_sequences_hold_the_ids(spark, ids_of, length, parts):
    texts = ["", None, "a", "many words " * 500, "x <|endoftext|> y<|startoftext|>", "<|ENDOFTEXT|>", "été 漢字 don't", "same", "same", "z" * 3000]
    df = spark.createDataFrame([(i, t, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, ids string, n int").repartition(parts)
    found = packed(df, length=length, pad_id=7).collect()
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    whole = b"".join(r.ids for r in sorted(found, key=lambda r: r.sequence_id))
    n = sum(len(ids_of(t)) for t in texts)
    rest = n % length
    assert len(whole) == 4 * (n if rest & (rest - 1) == 0 else n + length - rest)
    assert np.frombuffer(whole, "<u4")[n:].tolist() == [7] * (len(whole) // 4 - n)
    pieces = packing.pieces(packed(df, length=length)).withColumn("ids_crc32", F.crc32("ids")).collect()
    checked(pieces, dict(enumerate(texts)), ids_of, length)


def test_last_sequence_of_a_power_of_two_is_not_filled(spark, ids_of):
    df = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    assert len(ids_of("one two three")) == 4
    (only,) = packed(df).collect()
    assert len(only.ids) == 16 and only.pieces[0].asDict() == {"doc_id": 1, "start": 0, "length": 4, "doc_tokens": 4, "offset": 0}


def test_repeated_and_unnamed_documents(spark, ids_of):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id bigint, text string")
    (only,) = packed(df).collect()
    assert sorted((p.doc_id or 0, p.length) for p in only.pieces) == [(0, 1), (0, 3), (3, 3), (3, 3)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packed(df).collect() == [] and packing.pieces(packed(df)).columns[:2] == ["doc_id", "start"]


def test_boundary_records():
    def ids(*values):
        return np.array(values, "<u4").tobytes()

    rows = [(1, ids(1, 2, 3), 2), (2, ids(4, 5, 6), 5), (9, ids(7), 20)]
    found = [(number, whole, at, np.frombuffer(data, "<u4").tolist()) for number, whole, at, data, _ in packing.cut(iter(rows), 4)]
    assert found == [(0, False, 2, [1, 2]), (1, True, 0, [3, 4, 5, 6]), (5, False, 0, [7])]
