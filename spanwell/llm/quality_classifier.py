"""A quality classifier by regularised quadratic discriminants.

Document statistics are transformed towards normal shapes. Each class has a mean and a
covariance, summed over all labelled documents inside the executors: counts, sums and products
per class are all that leaves them, whatever the number of documents. Covariances shrink
towards the pooled one and towards a multiple of the identity; their Cholesky factors are kept, and
a score is the posterior probability from the difference of the two log-densities.

Defined cases: a null or empty text is scored from its counts, all 0; labels besides 0 and 1, and
null labels, teach nothing; without labelled documents of a class the score is the share of
label 1, or 0.5 without any; repeated rows are scored alike; an empty table gives an
empty table; extra columns pass unchanged, and one that has the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.llm.text_stats import COUNTS


def transformed(counts: np.ndarray) -> np.ndarray:
    """Features from rows of counts: logs of sizes, and shares on a log scale, pulled in for short texts."""
    c = dict(zip(COUNTS, counts.astype(np.float64).T))
    words, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]

    def share(part: np.ndarray, whole: np.ndarray, typical: float, weight: float = 10.0) -> np.ndarray:
        return np.log((part + typical * weight) / (whole + weight))

    return np.column_stack([
        np.log1p(words),
        np.log((chars + 50) / (words + 10)),
        np.log((words + 10) / (lines + 1)),
        share(c["n_symbols"], words, 0.01),
        share(c["n_exclaims"], words, 0.01),
        share(c["n_upper"], c["n_upper"] + c["n_lower"], 0.03),
        share(c["n_repeat_words"], words, 0.05),
        share(words - c["n_distinct_words"], words, 0.2),
        share(c["n_dup_lines"], lines, 0.05, 2.0),
        share(c["n_stops"], words, 0.15),
        share(c["n_digits"], chars, 0.01),
        share(c["n_other_marks"], chars, 0.01),
        share(c["n_beyond_ascii"], chars, 0.02),
    ])


def _matrix(struct: pa.Array) -> np.ndarray:
    return np.column_stack([struct.field(name).to_numpy(zero_copy_only=False) for name in COUNTS])


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors, log-determinants and log-priors of classes 0 and 1."""

    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, whiten, log_det, log_prior in self.classes:
            z = (x - mean) @ whiten.T
            logs.append(log_prior - 0.5 * ((z * z).sum(axis=1) + log_det))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def moments(labelled: DataFrame, label: str = "label", counts: str = "counts") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Number, sums and sums of products of the features by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            x = transformed(_matrix(batch.column("counts")))
            x = np.column_stack([np.ones(len(x)), x])
            for k in (0, 1):
                part = x[labels == k]
                total[k] = total.get(k, 0) + part.T @ part
        for k, products in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(products.size, k)), pa.array(np.arange(products.size)), pa.array(products.ravel())],
                ["label", "place", "value"],
            )

    chosen = labelled.select(F.col(label).cast("bigint").alias("label"), F.col(counts).alias("counts")).where("label in (0, 1)")
    summed = chosen.mapInArrow(run, "label bigint, place bigint, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, float]] = {}
    for row in summed.collect():  # 2 classes x (features + 1) squared
        found.setdefault(row.label, {})[row.place] = row.value
    out = {}
    for k, values in found.items():
        size = int(round(len(values) ** 0.5))
        products = np.array([values[i] for i in range(size * size)]).reshape(size, size)
        out[k] = (products[0, 0], products[0, 1:], products[1:, 1:])
    return out


def fit(labelled: DataFrame, label: str = "label", counts: str = "counts", pool: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """The discriminant from all labelled rows.

    ``pool`` is the weight of the pooled covariance in each class, ``ridge`` that of the
    identity times the mean variance.
    """
    found = {k: m for k, m in moments(labelled, label, counts).items() if m[0] > 0}
    total = sum(n for n, _, _ in found.values())
    if len(found) < 2:
        return Discriminant([], (found[1][0] if 1 in found else 0.0) / total if total else 0.5)
    means = {k: s / n for k, (n, s, _) in found.items()}
    spread = {k: p - np.outer(means[k], means[k]) * n for k, (n, _, p) in found.items()}
    pooled = sum(spread.values()) / total
    classes = []
    for k in (0, 1):
        n = found[k][0]
        cov = (1 - pool) * spread[k] / n + pool * pooled
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiten = np.linalg.solve(factor, np.eye(len(cov)))
        classes.append((means[k], whiten, 2 * float(np.log(np.diag(factor)).sum()), float(np.log(n / total))))
    return Discriminant(classes)


def score(counted: DataFrame, model: Discriminant, counts: str = "counts", out: str = "score", predicted: str = "predicted",
          good_at: float = 0.3) -> DataFrame:
    """``counted`` with the probability of class 1 and the class predicted from it."""
    kept = [c for c in counted.columns if c.lower() not in (out.lower(), predicted.lower())]
    schema = T.StructType([*(counted.schema[c] for c in kept), T.StructField(out, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(transformed(_matrix(batch.column(counts)))) if len(batch) else np.zeros(0)
            made = [pa.array(found), pa.array((found >= good_at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, out, predicted])

    return counted.mapInArrow(run, schema)
