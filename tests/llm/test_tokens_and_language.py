"""Token files and language identification."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwell.llm import language_id as language
from spanwell.llm import token_files as files
from spanwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kinds", [1, 2, 3, 40, 5000])
def test_grammar_round_trips_and_random_access(kinds):
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 3, 50, 3000):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        lengths = np.diff(np.sort(np.concatenate([[0, n], rng.integers(0, n + 1, 5)]))).astype(np.uint32)
        payload = files.Payload(files.pack(ids, lengths, kinds))
        assert (payload.ids() == ids).all()
        assert (files.expand(payload.symbols, payload.rules, kinds) == ids).all()
        ends = np.cumsum(lengths)
        for i, (size, end) in enumerate(zip(lengths.astype(int), ends.astype(int))):
            assert (payload.document(i) == ids[end - size: end]).all()
        for _ in range(20):
            a = int(rng.integers(0, n + 1))
            b = int(rng.integers(a, n + 1))
            assert (payload.ids(a, b) == ids[a:b]).all()


def test_frequent_pairs_are_replaced():
    ids = np.tile(np.arange(8, dtype=np.uint32), 2000)
    rules, lengths, symbols = files.compress(ids, 8)
    assert len(symbols) < 300 and lengths.max() >= 8
    with pytest.raises(ValueError):
        files.Payload(b"else" + bytes(16))


def test_words_equal_the_library(library):
    with open(VOCABULARY, "rb") as file:
        words = files.WordTokens(file.read())
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", "é", "İ", "ß", " ", "\n", "\x1c", " ", "'s", "'T", "1", "２", "!!", "ﬁ", "Å", "한", "ᄀ", "ᅡ", "ς", "Σ", ".", ",",
             "<|endoftext|>", "😀", "\xa0", "日本", "word", "ing"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    for _ in range(2):
        got = words.encode([None if t is None else t.encode() for t in texts])
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [library(t) for t in texts]


def test_letters_are_remembered_once_for_all_marks(library):
    with open(VOCABULARY, "rb") as file:
        words = files.WordTokens(file.read())
    texts = ["Word word, word. word!? (word) wörd; wörd ... ...word İ, İ", "word% ,, 1. x1, x"]
    got = words.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [library(t) for t in texts]
    assert {b"word", "wörd".encode()} <= set(words.known)
    assert not {b"word,", b"word.", b"word!?", b"word%", "wörd;".encode()} & set(words.known)


def test_a_task_encodes_without_threads(spark, monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    monkeypatch.setattr(files, "_tokens", {})
    files.word_tokens(files.shared_vocabulary(spark, VOCABULARY))
    assert files.os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("block", [20, 1 << 19])
def test_files_round_trip(spark, tmp_path, library, monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK", block)
    rows = [(i * 3 % 50, f"Text number {i} of {i * i}, with words.") for i in range(50)] + [(7, "again"), (7, "again"), (None, "first"), (60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("payload", F.lit("x")).withColumn("tie", F.lit(1)).repartition(3)
    path = str(tmp_path / "ids")
    files.write(df, path, VOCABULARY, end_id=1)
    got = files.read(spark, path).orderBy("start").collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(got) == len(rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    expected = sorted((-1 if i is None else i, library(t) + [1]) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == expected
    files.write(df.limit(0), path + "-empty", VOCABULARY, end_id=1)
    assert files.read(spark, path + "-empty").collect() == []


def test_token_query(spark, library):
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, SF).collect()}
    start = 0
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*library(text), 1], dtype="<u4")
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_gradients_are_right():
    network = language.ByteNetwork(["x", "y", "z"], seed=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        embedded = network.p["embed"][x]
        pooled = []
        for w in language.WIDTHS:
            under = np.concatenate([embedded[:, k: k + x.shape[1] - w + 1] for k in range(w)], axis=2)
            pooled.append(np.maximum((under @ network.p[f"filter{w}"] + network.p[f"bias{w}"]).max(axis=1), 0))
        p = network._softmax(np.concatenate(pooled, axis=1) @ network.p["out"] + network.p["out_bias"])
        return -np.log(p[np.arange(6), y]).mean()

    found = network.gradient(x, y)
    for name, g in found.items():
        flat = network.p[name].reshape(-1)
        for at in np.argsort(-np.abs(g).reshape(-1))[:4]:
            old = flat[at]
            flat[at] = old + 1e-6
            high = loss()
            flat[at] = old - 1e-6
            low = loss()
            flat[at] = old
            assert (high - low) / 2e-6 == pytest.approx(g.reshape(-1)[at], rel=1e-3, abs=1e-7)


def test_tables_give_the_network_itself():
    network = language.ByteNetwork(["x", "y"], seed=5)
    x = np.random.default_rng(2).integers(0, 256, (30, language.WINDOW)).astype(np.uint8)
    embedded = network.p["embed"][x]
    pooled = []
    for w in language.WIDTHS:
        under = np.concatenate([embedded[:, k: k + x.shape[1] - w + 1] for k in range(w)], axis=2)
        pooled.append(np.maximum((under @ network.p[f"filter{w}"] + network.p[f"bias{w}"]).max(axis=1), 0))
    plain = network._softmax(np.concatenate(pooled, axis=1) @ network.p["out"] + network.p["out_bias"])
    assert np.allclose(network.probabilities(x), plain, atol=1e-4)


def test_windows_cover_whole_texts():
    assert language.windows(b"").shape == (1, language.WINDOW)
    for n in (1, language.WINDOW, language.WINDOW + 1, 1000):
        cut = language.windows(b"x" * n)
        assert cut.shape[0] == -(-n // language.WINDOW) and (cut > 0).sum() == n


def test_language_defined_cases(spark):
    rows = [(i, "the house and the garden with a tree " * 3, "en") for i in range(20)] + [(50 + i, "das Haus und der Garten mit Bäumen " * 3, "de") for i in range(20)]
    df = spark.createDataFrame([*rows, (100, "nothing known", None)], "doc_id bigint, text string, lang string")
    network = language.fit(df, epochs=20)
    asked = spark.createDataFrame(
        [(1, None, "s"), (2, "", "s"), (3, "12 !? \n", "s"), (4, "der Garten und das Haus", "s"), (4, "der Garten und das Haus", "s"), (5, "the garden and the house " * 9000, "s")],
        "doc_id bigint, text string, score string")
    out = language.predict(asked, network)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r.doc_id, r.lang_pred) for r in out.collect()) == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")]
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in out.collect())
    assert language.predict(asked.limit(0), network).collect() == []
    nobody = language.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language.predict(asked, nobody).collect()} == {"und"}


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op10_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97


def test_a_language_of_many_copies_is_learnt(spark):
    """All copies of a text are one text, and no more than asked for come to the driver."""
    copies = spark.range(20_000).select(F.lit("the one english text that stands there again and again").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(3000).select(F.concat(F.lit("ein anderer deutscher Text mit der Nummer "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    found = [r.lang for r in language.sample(copies.unionByName(others), "text", "lang", 100, 128)]
    assert found.count("en") == 1 and found.count("de") == 100
