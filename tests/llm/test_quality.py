"""Counts, quality rules and the quality classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwell.llm import quality_classifier as classifier
from spanwell.llm import quality_rules as rules
from spanwell.llm.queries import QUERIES
from spanwell.llm.text_stats import COUNTS, text_counts, with_counts

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t\n", "one", "a b c a b c", "x\x1cy é\xa0É", "#*$%&|<> ## a|b", "l\nl\n\nl \nl\n x\n", "a a a a", "Aé ÉB cd\x0b!!",
         "a b c d a b c x a b", "日本 语 語", "\n\n\n", "the end.\r\nthe end.\r\n"]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts():
    for text in TEXTS:
        assert text_counts(None if text is None else text.encode())[:5] == plain_counts(text), text


def good_text(i):
    return " ".join(f"word{(i * 7 + k * k) % 997} and" for k in range(40)) + "."


def documents():
    rows = [(i, good_text(i)) for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in good_text(i).split())) for i in range(6)]
    rows += [(200 + i, " | ".join(good_text(i).split())) for i in range(6)]
    rows += [(300 + i, "again " * 90) for i in range(6)]
    return [*rows, (400, None), (401, ""), (402, "too short")]


def plain_trust(cases, names):
    """The same estimate, with arrays."""
    votes = np.array([c for c, _ in cases])
    n = np.array([k for _, k in cases], dtype=float)
    good, rate = 0.8, np.tile([[0.45, 0.5, 0.05], [0.05, 0.5, 0.45]], (len(names), 1, 1))
    for _ in range(500):
        evidence = np.log(rate[:, 1] / rate[:, 0])
        evidence[:, 0], evidence[:, 2] = np.minimum(evidence[:, 0], 0), np.maximum(evidence[:, 2], 0)
        p = 1 / (1 + np.exp(-(np.log(good / (1 - good)) + sum(evidence[j][votes[:, j] + 1] for j in range(len(names))))))
        new = np.array([[[0.1 + ((votes[:, j] == v) * n * q).sum() for v in (-1, 0, 1)] for q in (1 - p, p)] for j in range(len(names))])
        rate, good = new / new.sum(axis=2, keepdims=True), float(np.clip((n * p).sum() / n.sum(), 0.001, 0.999))
    return good, rate


def test_estimate_equals_a_plain_version():
    names = ["a", "b", "c"]
    cases = [((1, 0, 0), 700), ((1, -1, 0), 20), ((0, -1, -1), 90), ((0, 0, -1), 60), ((0, 0, 0), 30)]
    got = rules.estimate(cases, names)
    good, rate = plain_trust(cases, names)
    assert got.good == pytest.approx(good, abs=1e-6)
    assert np.allclose([got.rates[r] for r in names], rate, atol=1e-6)
    assert all(0 <= a <= 1 for a in got.accuracy.values())
    assert rules.estimate([], names).good == 0.8


def test_rules_tell_junk_from_text(spark):
    df = spark.createDataFrame(documents(), "doc_id bigint, text string")
    counted = with_counts(df)
    got = {r.doc_id: r for r in rules.judge(counted, rules.learn(counted)).collect()}
    assert all(got[i].kept == (i < 100) for i in got)
    assert all(got[i].base_failed for i in (300, 400, 401, 402)) and not got[100].base_failed
    assert sorted(r.doc_id for r in rules.filtered(df).collect()) == list(range(60))


def test_rules_defined_cases(spark):
    df = spark.createDataFrame(documents(), "doc_id bigint, text string").withColumn("counts", F.lit("x")).withColumn("kept", F.lit(1))
    out = rules.filtered(df.unionByName(df.limit(3)))
    assert out.columns == ["doc_id", "text", "counts", "kept"] and out.count() == 63
    assert rules.filtered(df.limit(0)).collect() == []


def test_rules_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op7_quality_rules"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n, chars, symbols, lines, repeats = plain_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.kept and r.base_failed)
        if r.doc_id in labels and not r.base_failed:
            assert r.kept == bool(labels[r.doc_id])


def test_transforms_are_finite():
    rows = np.array([text_counts(None if t is None else t.encode()) for t in TEXTS] + [[10**9] * len(COUNTS)])
    assert np.isfinite(classifier.transformed(rows)).all()


def test_discriminant_equals_densities(spark):
    df = spark.createDataFrame([(i, t, int(i < 60)) for i, t in documents()], "doc_id bigint, text string, label int")
    counted = with_counts(df, keep=["doc_id", "label"])
    model = classifier.fit(counted, pool=0.2, ridge=0.1)
    rows = sorted(counted.collect(), key=lambda r: r.doc_id)
    x = classifier.transformed(np.array([list(r.counts) for r in rows]))
    y = np.array([r.label for r in rows])
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    logs = []
    for k in (0, 1):
        cov = 0.8 * np.cov(x[y == k].T, bias=True) + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * (np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
        d = x - x[y == k].mean(axis=0)
        logs.append(np.log((y == k).mean()) - 0.5 * ((d @ np.linalg.inv(cov) * d).sum(axis=1) + np.linalg.slogdet(cov)[1]))
    got = {r.doc_id: r.score for r in classifier.score(counted, model).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-6)


@pytest.mark.parametrize("keep, score", [("false", 0.5), ("label = 1", 1.0), ("label = 0", 0.0)])
def test_classifier_without_a_class(spark, keep, score):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 0), (3, "", None)], "doc_id bigint, text string, label int").withColumn("score", F.lit("x"))
    counted = with_counts(df)
    out = classifier.score(counted, classifier.fit(counted.where(keep)))
    assert out.columns == ["doc_id", "text", "label", "counts", "score", "predicted"]
    assert {r.score for r in out.collect()} == {score}
    assert classifier.score(counted.limit(0), classifier.fit(counted.where(keep))).collect() == []


def test_classifier_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_quality_classifier"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.95
