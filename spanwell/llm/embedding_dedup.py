"""Near-duplicate vectors by counting collisions in one-dimensional projections.

Vectors are projected on many random lines. Near vectors lie close on every line, so a pair
that meets in the windows around each other on enough of the lines is compared in full. How
many lines it takes, how wide the windows are and how many tables there are follow from
the wanted recall for a pair just at the threshold.

Windows over all vectors would meet a fixed share of all pairs on every line. So the vectors are
first grouped, in several tables, by the slabs they fall into on a few lines; the number of
these lines grows with the logarithm of the number of vectors, which keeps groups small. In a
group every counting line is sorted, and each vector as a query collides with those in the window
around it; collisions are counted for each pair over all lines alike, in planes of bits. Groups
beyond a limit are cut into blocks. A pair that met in an earlier table is not counted again. Only
numbers of links and a star of links leave a group, never all pairs.

Equal vectors count as one from the start, with the number of copies.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, and so do rows without a vec_id (their component is null); vectors of different
lengths never link; repeated rows are vectors of their own; an empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwell.llm.common import blocks, column, components, runs, stars, whole_groups
from spanwell.session import settled


@dataclass(frozen=True)
class Plan:
    """Lines, slabs and windows; lengths are in units of a unit vector's spread on a line."""

    threshold: float
    slab: float
    tables: int
    lines_in_table: int
    counting_lines: int
    window: float
    least: int
    seed: int

    def directions(self, dim: int) -> np.ndarray:
        """All lines as columns: those of the tables, then the counting ones."""
        rng = np.random.default_rng([self.seed, dim])
        return rng.normal(size=(dim, self.tables * self.lines_in_table + self.counting_lines))

    def offsets(self) -> np.ndarray:
        rng = np.random.default_rng([self.seed, 0])
        return rng.uniform(0, self.slab, self.tables * self.lines_in_table)


def _binomial_tail(n: int, p: float, least: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def make_plan(n: int, threshold: float = 0.95, recall: float = 0.999, group: int = 1024, counting_lines: int = 16,
              slab: float = 1.5, seed: int = 11) -> Plan:
    """The plan for ``n`` vectors so that pairs at the threshold are found with ``recall``.

    Half of the misses allowed may come from the tables, half from the counts. On a line
    two vectors of cosine c differ by a normal number of variance 2 (1 - c).
    """
    spread = math.sqrt(2 * (1 - threshold))
    share = 1 - (1 - recall) / 2
    grid = np.linspace(-slab, slab, 2001)

    def same_slab(sigma: float) -> float:
        density = np.exp(-0.5 * (grid / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))
        return float(((1 - np.abs(grid) / slab) * density).sum() * (grid[1] - grid[0]))

    near, any_two = same_slab(spread), same_slab(math.sqrt(2))
    lines = max(0, math.ceil(math.log(max(n, 1) / group) / -math.log(any_two)))
    tables = 1 if lines == 0 else math.ceil(math.log(1 - share) / math.log(1 - near**lines))
    window = 2 * spread
    meets = math.erf(window / spread / math.sqrt(2))
    least = max(k for k in range(counting_lines + 1) if _binomial_tail(counting_lines, meets, k) >= share)
    return Plan(threshold, slab, tables, lines, counting_lines, window, least, seed)


def _vectors(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column in a row, and where each vector begins."""
    values = batch.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _cells(distinct: DataFrame, plan: Plan) -> DataFrame:
    """``distinct`` with ``cells``: for each table a hash of the vector's slabs."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in distinct.schema)}, cells array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = plan.offsets()
        n_lines = plan.tables * plan.lines_in_table
        for batch in batches:
            flat, starts = _vectors(batch, "vector")
            sizes = np.diff(starts)
            cells = np.zeros((len(batch), plan.tables), dtype=np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[starts[rows][:, None] + np.arange(dim)]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                slabs = np.floor((x @ plan.directions(int(dim))[:, :n_lines] + offsets) / plan.slab).astype(np.int64)
                slabs = slabs.reshape(len(rows), plan.tables, plan.lines_in_table)
                mixed = np.full((len(rows), plan.tables), dim, dtype=np.uint64)
                for k in range(plan.lines_in_table):
                    mixed = (mixed ^ slabs[:, :, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                cells[rows] = mixed.view(np.int64)
            made = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * plan.tables), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "cells"])

    return distinct.mapInArrow(run, schema)


def _windows(line: np.ndarray, window: float) -> np.ndarray:
    """For each row as a query, the rows in the window around it on one line, as a row of bits.

    The line is sorted, so a window is a range of ranks, and its rows are those before its end
    without those before its beginning.
    """
    n = len(line)
    order = np.argsort(line, kind="stable")
    sorted_line = line[order]
    before = np.zeros((n + 1, -(-n // 64)), dtype=np.uint64)
    before[np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_xor.accumulate(before, axis=0, out=before)
    begin = np.searchsorted(sorted_line, line - window, side="left")
    end = np.searchsorted(sorted_line, line + window, side="right")
    return before[end] ^ before[begin]


def _collisions(places: np.ndarray, window: float, least: int) -> np.ndarray:
    """Bits of the pairs that meet in the windows of at least ``least`` of the lines, a row for each query.

    Counts are kept as planes of bits, so that a line is added to 64 pairs at once. They begin
    below a power of two by ``least``: a pair met often enough when its count has come to that power.
    """
    top = max(len(places), 1).bit_length()
    first = (1 << top) - least
    n = places.shape[1]
    planes = [np.full((n, -(-n // 64)), -(first >> k & 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64) for k in range(top + 1)]
    for line in places:
        carry = _windows(line, window)
        for plane in planes:
            plane ^= carry
            carry &= ~plane
    return planes[top]


def _pairs_in_group(x: np.ndarray, lines: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at or above the threshold, by collisions on the counting lines."""
    norms = np.linalg.norm(x, axis=1)
    met = _collisions(((x / norms[:, None]) @ lines).T, plan.window, plan.least)
    for a in range(0, len(x), 256):
        i, word = np.nonzero(met[a: a + 256])
        bits = np.unpackbits(met[a + i, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        i, j = a + i[at], word[at] * 64 + bit
        ahead = i < j
        i, j = i[ahead], j[ahead]
        for start in range(0, len(i), 1 << 16):
            u, v = i[start: start + (1 << 16)], j[start: start + (1 << 16)]
            near = np.einsum("ij,ij->i", x[u], x[v]) / (norms[u] * norms[v]) >= plan.threshold
            yield u[near], v[near]


def _found(table: pa.Table, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Numbers of links and stars of links of whole groups."""
    keys = [table.column(c).to_numpy() for c in ("slot", "cell", "near", "far")]
    starts, sizes = runs(*keys)
    if not (sizes > 1).any():
        return
    ids, copies, chunk = (table.column(c).to_numpy() for c in ("first_id", "copies", "chunk"))
    flat, at = _vectors(table, "vector")
    cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    links = np.zeros(len(ids), dtype=np.int64)
    left, right = [], []
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        dims = np.diff(at[start: start + size + 1])
        for dim in np.unique(dims):
            own = start + np.flatnonzero(dims == dim)
            lines = plan.directions(int(dim))[:, plan.tables * plan.lines_in_table:]
            for u, v in _pairs_in_group(flat[at[own][:, None] + np.arange(dim)], lines, plan):
                u, v = own[u], own[v]
                new = ~(cells[u, : keys[0][start]] == cells[v, : keys[0][start]]).any(axis=1)
                if keys[2][start] != keys[3][start]:
                    new &= chunk[u] != chunk[v]
                u, v = u[new], v[new]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                left.append(ids[u])
                right.append(ids[v])
    linked = np.flatnonzero(links)
    if len(linked):
        a, b = stars(np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[linked], a])),
             pa.array(np.concatenate([ids[linked], b])),
             pa.array(np.concatenate([links[linked], np.zeros(len(a), dtype=np.int64)]))],
            ["a", "b", "links"],
        )


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
                 recall: float = 0.999, block: int = 2048, group: int = 1024, seed: int = 11) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``df``."""
    vector = column(embedding)
    usable = F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    ) & column(vec_id).isNotNull()
    keys = [F.xxhash64(vector).alias("key_a"), F.xxhash64(F.reverse(vector), F.lit(1)).alias("key_b")]
    rows = df.select(column(vec_id).cast("bigint").alias("vec_id"), usable.alias("usable"), *keys)
    distinct = settled(
        df.where(usable).select(column(vec_id).cast("bigint").alias("vec_id"), *keys, vector.alias("vector"))
        .groupBy("key_a", "key_b", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")),
        "distinct-vectors",
    )
    plan = make_plan(distinct.count(), threshold, recall, group, seed=seed)
    placed = settled(_cells(distinct.select("first_id", "copies", "vector"), plan), "vector-cells")
    met = blocks(
        placed.select("first_id", "copies", "vector", "cells", F.posexplode("cells").alias("slot", "cell")),
        ["slot", "cell"], "first_id", block,
    )
    by = ["slot", "cell", "near", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, by):
            yield from _found(table, plan)

    found = settled(
        met.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint, links bigint"), "vector-links"
    )
    joined = components(found.where("a != b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    classes = settled(
        distinct.select("key_a", "key_b", "first_id", "copies")
        .join(counts, F.col("first_id") == F.col("a"), "left")
        .join(joined, F.col("first_id") == F.col("node"), "left")
        .select("key_a", "key_b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("component", "first_id").alias("component")),
        "vector-classes",
    )
    known = rows.where("usable").join(classes, ["key_a", "key_b"], "left")
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id")).unionByName(
        alone
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
