"""Hard negatives by exact inner products, found with LEMP's pruning by length and coordinates.

Rows stand in buckets of ``ROWS`` by falling length. A bucket holds its rows' directions in one
list for each coordinate, sorted by value. An anchor that looks for scores of at least a bound
needs a cosine of at least ``bound / (its length * the bucket's largest length)``; buckets where that
is above one are passed over. Otherwise the cosine bounds, for each of the anchor's ``FOCUS``
largest coordinates, the values that a row may have there: a range of the sorted list. The rows that
are in all of these ranges are candidates; their scores are computed exactly, in whole numbers. Where
the ranges hold most of the bucket, as with directions that are nearly random, all of it is verified.

The bounds come from the first bucket, whose scores can only be bettered: first the positives,
then, for each positive, the negatives inside its window of scores. The stated anchors meet the
buckets in cells of ``ANCHORS`` by ``ROWS`` rows, whatever the keys; from a cell only the
best few of each anchor leave.

Defined cases: rows without an id, label or vector, and those with a null or non-finite
component, take no part; of vectors of unequal width the shorter go on with zeros; a row is never its own
positive, but a repeated row is another row; anchors without positives, and positives without
negatives, are not in the result; an empty table gives none; a score beyond a long counts as the nearest
long; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwell.operators.ordered import Running, ordered
from spanwell.session import settled

#: Rows of a bucket, anchors of a cell, and anchors that are compared at a time.
ROWS, ANCHORS, STEP = 2048, 4096, 256
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
#: Share of a bucket from which on all of it is verified.
DENSE = 0.25
#: Below every score: of those that are exact in doubles, and of all.
LOWEST, LOWEST_OF_ALL = -(1 << 62), -(1 << 200)


@dataclass(frozen=True)
class Shape:
    """What all tasks know of the vectors: their width, and whether scores are exact in doubles."""

    width: int
    exact: bool


# -- a bucket --------------------------------------------------------------------------------

def matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of a table as rows of one width."""
    vectors = pa.concat_arrays(table.column("v").chunks)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy().astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Bucket:
    """Rows in ascending order of id with a sorted list of directions for each coordinate."""

    def __init__(self, table: pa.Table, shape: Shape):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.shape = shape
        self.ids, self.rows = ids[order], table.column("row").to_numpy()[order]
        self.labels = table.column("label").to_numpy()[order]
        self.vectors = matrix(table, shape.width)[order]
        lengths = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))
        self.longest = float(lengths.max())
        self.directions = self.vectors / np.where(lengths > 0, lengths, 1)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """The values of a coordinate in ascending order, and each row's place in that order."""
        if coordinate not in self._lists:
            values = self.directions[:, coordinate]
            order = np.argsort(values)
            places = np.empty(len(order), dtype=np.int32)
            places[order] = np.arange(len(order))
            self._lists[coordinate] = values[order], places
        return self._lists[coordinate]

    def candidates(self, anchors: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which rows may reach each anchor's bound: a matrix of anchors by rows."""
        length = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
        reach = length * self.longest
        found = np.ones((len(anchors), len(self.ids)), dtype=bool)
        found[(bound > 0) & (reach < bound * (1 - 1e-9))] = False
        cosine = np.where(reach > 0, bound / np.where(reach > 0, reach, 1), 0) - 1e-9
        asked = np.flatnonzero((cosine > 0) & (cosine <= 1))
        if not len(asked) or not self.shape.width:
            return found
        direction = anchors[asked] / length[asked, None]
        focus = np.argsort(-np.abs(direction), axis=1)[:, :FOCUS]
        spread = np.arccos(cosine[asked])[:, None]
        angle = np.arccos(np.clip(np.take_along_axis(direction, focus, axis=1), -1, 1))
        low = np.cos(np.minimum(angle + spread, np.pi)) - 1e-9
        high = np.cos(np.maximum(angle - spread, 0)) + 1e-9
        for coordinate in np.unique(focus):
            values, places = self.sorted_list(int(coordinate))
            which, slot = np.nonzero(focus == coordinate)
            first = np.searchsorted(values, low[which, slot], side="left")[:, None]
            last = np.searchsorted(values, high[which, slot], side="right")[:, None]
            found[asked[which]] &= (places >= first) & (places < last)
        return found

    def scores(self, anchors: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Exact scores of anchors by rows, ``LOWEST`` where one can't reach the anchor's bound."""
        if not self.shape.exact:
            return np.clip(anchors.astype(object) @ self.vectors.astype(object).T, -(1 << 63), (1 << 63) - 1)
        found = self.candidates(anchors, bound)
        if found.mean() > DENSE:
            return (anchors.astype(float) @ self.vectors.astype(float).T).astype(np.int64)
        out = np.full(found.shape, LOWEST, dtype=np.int64)
        which, row = np.nonzero(found)
        for start in range(0, len(which), 1 << 16):
            a, b = which[start: start + (1 << 16)], row[start: start + (1 << 16)]
            out[a, b] = (anchors[a] * self.vectors[b]).sum(axis=1)
        return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of each anchor's ``k`` highest allowed scores; of equal ones the first rows."""
    n = scores.shape[1]
    nothing = LOWEST_OF_ALL if scores.dtype == object else LOWEST
    key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), nothing)
    k = min(k, n)
    rows = np.argpartition(-key, k - 1, axis=1)[:, :k]
    which = np.repeat(np.arange(len(scores)), k)
    rows = rows.ravel()
    taken = allowed[which, rows]
    return which[taken], rows[taken]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64))


# -- cells -----------------------------------------------------------------------------------

_POSITIVES = "row bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
_NEGATIVES = "row bigint, anchor_id bigint, number int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _empty(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))})


def _bounds(table: pa.Table, name: str) -> np.ndarray:
    """A column of lower bounds, minus infinity where there is none."""
    return np.array([-math.inf if x is None else x for x in table.column(name).to_pylist()], dtype=float)


def _positives_cell(shape: Shape, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``k`` other rows of each anchor's label in a bucket."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [_empty(_POSITIVES)]
        if len(anchors) and len(rows):
            bucket = Bucket(rows, shape)
            for start in range(0, len(anchors), STEP):
                part = anchors.slice(start, STEP)
                names, row = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                bound = _bounds(part, "bound")
                scores = bucket.scores(matrix(part, shape.width), bound)
                allowed = (part.column("label").to_numpy()[:, None] == bucket.labels) & (row[:, None] != bucket.rows)
                allowed &= (scores >= bound[:, None]).astype(bool)
                if scores.dtype != object:
                    allowed &= scores > LOWEST
                at, found = best(scores, allowed, k)
                parts.append(pa.table({
                    "row": row[at], "anchor_id": names[at], "positive_id": bucket.ids[found], "positive_score": _longs(scores[at, found])}))
        return pa.concat_tables(parts)

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest negative score that ``low`` and ``high`` per cent of a positive's allow."""
    return -((-low * score) // 100), (high * score) // 100


def _negatives_cell(shape: Shape, positives: int, k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each positive of an anchor the best ``k`` rows of other labels in its window, in a bucket."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [_empty(_NEGATIVES)]
        if len(anchors) and len(rows):
            bucket = Bucket(rows, shape)
            for start in range(0, len(anchors), STEP):
                part = anchors.slice(start, STEP)
                names, row = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                asked = part.column("positives").to_pylist()
                kind, lowest = (np.int64, LOWEST) if shape.exact else (object, LOWEST_OF_ALL)
                least = np.full((len(part), positives), -lowest, dtype=kind)
                most = np.full((len(part), positives), lowest, dtype=kind)
                for i, found in enumerate(asked):
                    for j, positive in enumerate(found):
                        a, b = window(positive["score"], low, high)
                        least[i, j], most[i, j] = max(a, a if positive["bound"] is None else positive["bound"]), b
                open_ = least <= most
                bound = np.where(open_, least, -lowest).min(axis=1).astype(float)
                scores = bucket.scores(matrix(part, shape.width), bound)
                other = part.column("label").to_numpy()[:, None] != bucket.labels
                for j in range(positives):
                    inside = (scores >= least[:, j, None]) & (scores <= most[:, j, None])
                    at, found = best(scores, other & inside.astype(bool), k)
                    if len(at):
                        parts.append(pa.table({
                            "row": row[at], "anchor_id": names[at], "number": pa.array(np.full(len(at), j, dtype=np.int32)),
                            "positive_id": pa.array([asked[i][j]["id"] for i in at], pa.int64()),
                            "positive_score": pa.array([asked[i][j]["score"] for i in at], pa.int64()),
                            "negative_id": bucket.ids[found], "negative_score": _longs(scores[at, found])}))
        return pa.concat_tables(parts)

    return run


def _cells(anchors: DataFrame, rows: DataFrame, first: int, last: int, blocks: int, run, schema: str) -> DataFrame:
    """``run`` over every block of anchors and every bucket from ``first`` to ``last``."""
    numbers = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    asked = anchors.withColumn("bucket", F.explode(numbers))
    met = rows.where(F.col("bucket").between(first, last)).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return asked.groupBy("block", "bucket").cogroup(met.groupBy("block", "bucket")).applyInArrow(run, schema)


def _top(found: DataFrame, by: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(name))
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


# -- mining ----------------------------------------------------------------------------------

def mine(
    vectors: DataFrame, vec_id: Column, vector: Column, label: Column, is_anchor: Column,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become whole numbers, ``floor(scale * x)``. Each anchor's positives are the first ``positives``
    other rows of its label by falling score (ties: smaller id); for each, the first ``negatives`` rows of other
    labels whose score is between ``low`` and ``high`` per cent of the positive's.
    """
    double = vector.cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = vectors.select(
        vec_id.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), double.alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.coalesce(finite, F.lit(False)).alias("finite"),
    ).where("vec_id is not null and label is not null and x is not null and finite").select(
        "vec_id", "label", "is_anchor", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    rows = settled(rows, "whole-vectors")
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("v")).alias("width"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("largest")).first()
    n, width, largest = seen["n"], seen["width"] or 0, seen["largest"] or 0.0
    shape = Shape(width, largest * largest * max(width, 1) * ROWS < 2.0**52)
    length = -F.aggregate("v", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    small = F.col("v").cast("array<smallint>") if largest < 2**15 else F.col("v")
    by_length = ordered(
        rows.select("vec_id", "label", "is_anchor", small.alias("v"), length.alias("neg_length")), [], ["neg_length", "vec_id"]
    ).running(row=Running("sum", F.lit(1).cast("bigint"), through_row=False)).done()
    items = settled(by_length.select(
        "row", F.floor(F.col("row") / ROWS).alias("bucket"), "vec_id", "label", "is_anchor", "v"), "buckets")
    blocks = max(1, -(-seen["anchors"] // ANCHORS))
    anchors = settled(items.where("is_anchor").select(
        "row", "vec_id", "label", "v", F.pmod(F.xxhash64("row"), F.lit(blocks).cast("bigint")).alias("block")), "anchors")
    rows = items.select("row", "bucket", "vec_id", "label", "v")
    last = max(0, -(-n // ROWS) - 1)

    def searched(asked: Callable[[DataFrame | None], DataFrame], run, schema: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The first bucket without bounds, then all others with the bounds that its finds give."""
        found = settled(keep(_cells(asked(None), rows, 0, 0, blocks, run, schema)), "first-bucket")
        if not last:
            return found
        more = _cells(asked(found), rows, 1, last, blocks, run, schema)
        return settled(keep(found.select(*more.columns).unionByName(more)), "best-of-buckets")

    def seekers(found: DataFrame | None) -> DataFrame:
        if found is None:
            return anchors.withColumn("bound", F.lit(None).cast("bigint"))
        bounds = found.groupBy(F.col("row").alias("of_row")).agg(
            F.when(F.count(F.lit(1)) == positives, F.min("positive_score")).alias("bound"))
        return anchors.join(bounds, F.col("row") == F.col("of_row"), "left").drop("of_row")

    near = searched(seekers, _positives_cell(shape, positives), _POSITIVES,
                    lambda df: _top(df, ["row"], "positive_score", "positive_id", positives, "place"))

    def with_positives(found: DataFrame | None) -> DataFrame:
        number = (F.col("place") - 1).alias("number")
        listed = near.select(F.col("row").alias("of_row"), number, F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
        if found is None:
            listed = listed.withColumn("bound", F.lit(None).cast("bigint"))
        else:
            bounds = found.groupBy(F.col("row").alias("of_row"), "number").agg(
                F.when(F.count(F.lit(1)) == negatives, F.min("negative_score")).alias("bound"))
            listed = listed.join(bounds, ["of_row", "number"], "left")
        lists = listed.groupBy("of_row").agg(F.sort_array(F.collect_list(F.struct("number", "id", "score", "bound"))).alias("positives"))
        return anchors.join(lists, F.col("row") == F.col("of_row")).drop("of_row")

    far = searched(with_positives, _negatives_cell(shape, positives, negatives, low, high), _NEGATIVES,
                   lambda df: _top(df, ["row", "number"], "negative_score", "negative_id", negatives, "rank"))
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole a, whole b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
