"""Language identification by a convolutional network over bytes.

Filters of several widths slide over a window of bytes, each filter's largest value in the
window is kept, and a softmax over these values gives the languages. The network is trained in
numpy on a bounded, documented sample of labelled texts (``per_language`` windows of each
language, from as many texts chosen by a hash). Applied, every byte of every text is read: a
text is cut into windows of one length, windows of many texts go through the network together,
and a text's probabilities are the mean over its windows, weighted by their bytes.

A filter over embedded bytes is a sum of table lookups, one for each byte under it; for
application the lookups of two bytes in a row are one table.

Defined cases: null, empty and letterless texts are ``und`` with score 0; without any labelled
text every text is ``und`` with score 0; null languages teach nothing; repeated rows are
answered alike; an empty table gives an empty table; extra columns pass unchanged, and one
that has the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.llm.common import as_bytes, column
from spanwell.session import settled

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
UNKNOWN = "und"


def windows(text: bytes, length: int = WINDOW) -> np.ndarray:
    """The text's bytes as rows of ``length``, the last one filled up with zeros."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(n, length)


class ByteNetwork:
    """Embedding, filters of several widths with a bias each, and the output layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(languages), dtype=np.float32)
        self._tables = None

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of windows ``x`` with language numbers ``y``."""
        p, n = self.p, len(x)
        embedded = p["embed"][x]
        pooled, seen = [], []
        for w in WIDTHS:
            places = x.shape[1] - w + 1
            under = np.concatenate([embedded[:, k: k + places] for k in range(w)], axis=2)
            value = under @ p[f"filter{w}"] + p[f"bias{w}"]
            best = value.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(value, best[:, None, :], axis=1)[:, 0], 0))
            seen.append((best, under[np.arange(n)[:, None], best]))
        features = np.concatenate(pooled, axis=1)
        delta = self._softmax(features @ p["out"] + p["out_bias"])
        delta[np.arange(n), y] -= 1
        delta /= n
        g = {"out": features.T @ delta, "out_bias": delta.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (delta @ p["out"].T) * (features > 0)
        for i, w in enumerate(WIDTHS):
            best, under = seen[i]
            d = back[:, i * FILTERS: (i + 1) * FILTERS]
            g[f"filter{w}"] = np.einsum("nf,nfe->ef", d, under)
            g[f"bias{w}"] = d.sum(axis=0)
            to_bytes = (d[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDED)
            at = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
            np.add.at(g["embed"], at, to_bytes)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        """Adam over shuffled batches; the rate falls to zero along a line."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), batch):
                rows = order[start: start + batch]
                step += 1
                now = rate * (1 - (step - 1) / steps)
                for k, g in self.gradient(x[rows], y[rows]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self._tables = None

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width: how far from the window's place, over how many bytes, and the table."""
        if self._tables is None:
            self._tables = []
            for w in WIDTHS:
                single = [self.p["embed"] @ self.p[f"filter{w}"][k * EMBEDDED: (k + 1) * EMBEDDED] for k in range(w)]
                single[0] = single[0] + self.p[f"bias{w}"]
                steps = []
                for k in range(0, w, 2):
                    if k + 1 < w:
                        steps.append((k, 2, (single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS)))
                    else:
                        steps.append((k, 1, single[k]))
                self._tables.append(steps)
        return self._tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The languages' probabilities for rows of windows."""
        out = np.empty((len(x), len(self.languages)), dtype=np.float32)
        for start in range(0, len(x), 256):
            part = x[start: start + 256]
            pairs = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            pooled = []
            for w, steps in zip(WIDTHS, self.tables()):
                places = part.shape[1] - w + 1
                value = None
                for k, bytes_, table in steps:
                    code = (pairs if bytes_ == 2 else part)[:, k: k + places]
                    found = table.take(code, axis=0)
                    value = found if value is None else np.add(value, found, out=value)
                pooled.append(np.maximum(value.max(axis=1), 0))
            out[start: start + 256] = self._softmax(np.concatenate(pooled, axis=1) @ self.p["out"] + self.p["out_bias"])
        return out

    def __getstate__(self):
        return {"languages": self.languages, "p": self.p, "_tables": None}

    def __setstate__(self, state):
        self.__dict__.update(state)


def sample(labelled: DataFrame, text: str, lang: str, per_language: int, length: int) -> list:
    """At most ``per_language`` distinct texts of each language, of each a stretch that some hash of it picks.

    Those of the lowest hashes are in, however many copies a text has. An estimate of a language's
    distinct texts leaves out most of the others before copies are merged; four times as many as
    are wanted pass it, so the estimate's error decides nothing.
    """
    known = labelled.select(column(text).alias("text"), column(lang).cast("string").alias("lang")).where(
        "text is not null and lang is not null and text != ''"
    )
    mark = F.xxhash64("text")
    start = F.pmod(F.shiftright(mark, 32), F.greatest(F.lit(1), F.length("text") - length + 1)) + 1
    stretches = known.select("lang", mark.alias("mark"), F.substr(F.col("text"), start.cast("int"), F.lit(length)).alias("part"))
    counts = settled(known.groupBy(F.col("lang").alias("of_lang")).agg(F.approx_count_distinct(mark).alias("texts")), "language-counts")
    low = F.pmod("mark", F.lit(1 << 30))
    picked = stretches.join(counts, F.col("lang") == F.col("of_lang")).where(
        low < F.least(F.lit(1 << 30), F.lit(4 * per_language << 30) / F.col("texts"))
    ).groupBy("lang", "mark").agg(F.min("part").alias("part"))
    lowest = Window.partitionBy("lang").orderBy(low, "mark")
    return picked.withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= per_language).select("lang", "part").collect()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 1000, epochs: int = 6, seed: int = 7) -> ByteNetwork:
    """A network from ``per_language`` distinct labelled texts of each language (all, if fewer), one window of each.

    Every window is used twice: whole, and cut to a random length, so that short texts
    are known as well; every sixth of the latter is in capitals.
    """
    rows = sorted((r.lang, r.part) for r in sample(labelled, text, lang, per_language, WINDOW))
    languages = sorted({r[0] for r in rows})
    network = ByteNetwork(languages, seed)
    if not rows:
        return network
    rng = np.random.default_rng(seed)
    x, y = [], []
    for name, part in rows:
        data = part.encode()[:WINDOW]
        short = data[: rng.integers(12, WINDOW + 1)]
        for use in (data, short.upper() if len(x) % 12 == 0 else short):
            x.append(windows(use)[0])
            y.append(languages.index(name))
    network.train(np.array(x), np.array(y), epochs)
    return network


def _has_letter(text: bytes) -> bool:
    return text.isalpha() or any(map(str.isalpha, text.decode()))


def predict(docs: DataFrame, network: ByteNetwork, text: str = "text", out: str = "lang_pred", score: str = "score",
            keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, default all) with the predicted language and its probability."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (out.lower(), score.lower())]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some ten thousand numbers

    def answer(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        network = shared.value
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not network.languages:
            return names, scores
        totals = np.zeros((len(texts), len(network.languages)))
        waiting: list[tuple[int, np.ndarray, int]] = []
        held = 0

        def flush() -> None:
            nonlocal waiting, held
            if not waiting:
                return
            found = network.probabilities(np.concatenate([w for _, w, _ in waiting]))
            at = 0
            for row, cut, size in waiting:
                weights = np.full(len(cut), WINDOW)
                weights[-1] = size - WINDOW * (len(cut) - 1)
                totals[row] += weights @ found[at: at + len(cut)] / size
                at += len(cut)
            waiting, held = [], 0

        for row, data in enumerate(texts):
            if data and _has_letter(data):
                cut = windows(data)
                waiting.append((row, cut, len(data)))
                held += len(cut)
                if held >= 4096:
                    flush()
                names[row] = ""
        flush()
        for row in range(len(texts)):
            if names[row] == "":
                best = int(totals[row].argmax())
                names[row], scores[row] = network.languages[best], float(min(1.0, totals[row, best]))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                names, scores = answer(list(as_bytes(part, text)))
                made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, out, score])

    return docs.mapInArrow(run, schema)
