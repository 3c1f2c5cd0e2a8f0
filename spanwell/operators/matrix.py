"""Matrices as dense blocks or coordinates; chunks and transposes.

Blocks: ``i, j, v`` with ``v`` the ``dim * dim`` values in row-major order.
Coordinates: ``row, col, v``, each cell at most once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwell.operators.ordered import Running, ordered

BLOCK = "i bigint, j bigint, v array<double>"


def block_places(spark: SparkSession, dim_blocks: int) -> DataFrame:
    """All ``i, j`` of a square grid."""
    cell = F.col("id")
    return spark.range(dim_blocks * dim_blocks).select(
        F.floor(cell / dim_blocks).alias("i"), (cell % dim_blocks).alias("j"))


def generate_blocks(places: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """A block of uniform values in [0, 1) for each place: those of ``uniform_cell`` at its cells."""
    cells = F.sequence(F.lit(0).cast("bigint"), F.lit(dim * dim - 1).cast("bigint"))
    value = F.transform(cells, lambda p: uniform_cell(
        seed, F.col("i") * dim + F.floor(p / dim), F.col("j") * dim + p % dim))
    return places.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).withColumn("v", value)


def uniform_cell(seed: int, row: Column, col: Column) -> Column:
    """A uniform value in [0, 1) fixed by seed and cell, for coordinates."""
    text = F.concat_ws(":", F.lit(str(seed)), row.cast("string"), col.cast("string"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(1 << 52))


def to_blocks(cells: DataFrame, dim: int) -> DataFrame:
    """Coordinates to dense blocks; absent cells are zero. A block gathers at most dim*dim cells."""
    place = (F.col("row") % dim) * dim + F.col("col") % dim
    gathered = cells.groupBy(
        F.floor(F.col("row") / dim).alias("i"), F.floor(F.col("col") / dim).alias("j")
    ).agg(F.collect_list(F.struct(place.alias("p"), F.col("v").cast("double").alias("v"))).alias("cells"))
    gathered = gathered.select("i", "j", F.col("cells.p").alias("p"), F.col("cells.v").alias("x"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dense = []
            for p, x in zip(frame["p"], frame["x"]):
                values = np.zeros(dim * dim)
                values[np.asarray(p, dtype=np.int64)] = x
                dense.append(values)
            yield pd.DataFrame({"i": frame["i"], "j": frame["j"], "v": dense})

    return gathered.mapInPandas(fill, BLOCK)


def vectors_to_blocks(df: DataFrame, row: str, vector: str, dim: int) -> DataFrame:
    """One vector per matrix row to dense blocks; a strip gathers at most ``dim`` rows."""
    strips = df.groupBy(F.floor(F.col(row) / dim).alias("i")).agg(
        F.collect_list(F.struct((F.col(row) % dim).alias("r"), F.col(vector).alias("x"))).alias("rows")
    ).select("i", F.col("rows.r").alias("r"), F.col("rows.x").alias("x"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, r, x in zip(frame["i"], frame["r"], frame["x"]):
                width = max(len(v) for v in x)
                grid = np.zeros((dim, -(-width // dim) * dim))
                for at, values in zip(r, x):
                    grid[int(at), : len(values)] = values
                for j in range(grid.shape[1] // dim):
                    block = grid[:, j * dim:(j + 1) * dim].ravel()
                    yield pd.DataFrame({"i": [i], "j": [j], "v": [block]})

    return strips.mapInPandas(fill, BLOCK)


def transpose_blocks(blocks: DataFrame, dim: int) -> DataFrame:
    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            turned = [np.asarray(v).reshape(dim, dim).T.ravel() for v in frame["v"]]
            yield pd.DataFrame({"i": frame["j"], "j": frame["i"], "v": turned})

    return blocks.select("i", "j", "v").mapInPandas(turn, BLOCK)


def from_blocks(blocks: DataFrame, dim: int, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Blocks to coordinates, without the zero padding beyond ``rows`` and ``cols``."""
    cells = blocks.select("i", "j", F.posexplode("v").alias("p", "v")).select(
        (F.col("i") * dim + F.floor(F.col("p") / dim)).alias("row"),
        (F.col("j") * dim + F.col("p") % dim).alias("col"),
        "v",
    )
    if rows is not None:
        cells = cells.where(F.col("row") < rows)
    if cols is not None:
        cells = cells.where(F.col("col") < cols)
    return cells


def multiply_blocks(a: DataFrame, b: DataFrame, dim: int, tile: int = 4, inner: int = 4,
                    grid: tuple[int, int, int] | None = None) -> DataFrame:
    """Block matrix product.

    Blocks meet by groups of ``tile`` result rows, ``tile`` result columns and
    ``inner`` inner indices. A group is one dense product, so it has summed over its
    inner indices before any partial block leaves it; a task holds ``2 * tile * inner`` input
    blocks whatever the grid is, and both one long inner side and one wide result spread
    over all tasks. No pair of blocks is ever a row. ``grid`` is the number of block rows of
    ``a``, inner blocks and block columns of ``b``; without it both sides are read once for it.
    """
    if grid is None:
        size = a.agg(F.max("i").alias("rows"), F.max("j").alias("inner")).first()
        other = b.agg(F.max("i").alias("inner"), F.max("j").alias("cols")).first()
        if size["rows"] is None or other["cols"] is None:
            return a.select("i", "j", "v").limit(0)
        if size["inner"] != other["inner"]:
            raise ValueError(
                f"inner sizes differ: {size['inner'] + 1} and {other['inner'] + 1} blocks")
        grid = size["rows"] + 1, size["inner"] + 1, other["cols"] + 1
    row_groups, inner_groups, col_groups = -(-grid[0] // tile), -(-grid[1] // inner), -(-grid[2] // tile)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = a.select(
        F.floor(F.col("j") / inner).alias("kg"), F.floor(F.col("i") / tile).alias("rg"), every(col_groups).alias("cg"),
        F.col("i").alias("at"), F.col("j").alias("k"), F.col("v").alias("values"))
    right = b.select(
        F.floor(F.col("i") / inner).alias("kg"), every(row_groups).alias("rg"), F.floor(F.col("j") / tile).alias("cg"),
        F.col("j").alias("at"), F.col("i").alias("k"), F.col("v").alias("values"))

    def panel(frame: pd.DataFrame, ks: dict[int, int], tall: bool) -> tuple[list[int], np.ndarray]:
        """A side's blocks as one matrix; absent blocks are zero."""
        places = sorted(set(frame["at"]))
        rows = {at: n for n, at in enumerate(places)}
        out = np.zeros((len(places), len(ks), dim, dim))
        for at, k, v in zip(frame["at"], frame["k"], frame["values"]):
            out[rows[at], ks[k]] = np.asarray(v).reshape(dim, dim)
        turned = out.transpose(0, 2, 1, 3) if tall else out.transpose(1, 2, 0, 3)
        return places, turned.reshape(len(places) * dim, -1) if tall else turned.reshape(len(ks) * dim, -1)

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"i": [], "j": [], "v": []})
        ks = {k: n for n, k in enumerate(sorted({*x["k"], *y["k"]}))}
        (rows, tall), (cols, wide) = panel(x, ks, True), panel(y, ks, False)
        made = tall @ wide
        out = [
            (i, j, made[r * dim:(r + 1) * dim, c * dim:(c + 1) * dim].ravel())
            for r, i in enumerate(rows) for c, j in enumerate(cols)
        ]
        return pd.DataFrame(out, columns=["i", "j", "v"])

    meet = ["kg", "rg", "cg"]
    parts = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(product, BLOCK)
    return parts if inner_groups == 1 else sum_blocks(parts, salts=-(-inner_groups // 64))


def sum_blocks(parts: DataFrame, salts: int = 1) -> DataFrame:
    """Add up the blocks of each place.

    The same streaming sum where the parts are, by place and salt, so that one place with
    many parts keeps many tasks busy, and by place. Rows arrive sorted, so a task holds one
    sum at a time. ``salts`` follows from the number of parts of a place.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, total = None, None
        for frame in frames:
            for i, j, v in zip(frame["i"], frame["j"], frame["v"]):
                if place == (i, j):
                    total += v
                else:
                    if place is not None:
                        yield pd.DataFrame({"i": [place[0]], "j": [place[1]], "v": [total]})
                    place, total = (i, j), np.array(v, dtype=np.float64)
        if place is not None:
            yield pd.DataFrame({"i": [place[0]], "j": [place[1]], "v": [total]})

    first = parts.sortWithinPartitions("i", "j").mapInPandas(add, BLOCK)
    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts))
        first = first.repartition("i", "j", salt).sortWithinPartitions("i", "j").mapInPandas(add, BLOCK)
    return first.repartition("i", "j").sortWithinPartitions("i", "j").mapInPandas(add, BLOCK)


def multiply_cells(a: DataFrame, b: DataFrame, dim: int = 64) -> DataFrame:
    """Product of two coordinate matrices, computed on blocks; zero cells are left out."""
    made = multiply_blocks(to_blocks(a, dim), to_blocks(b, dim), dim)
    return from_blocks(made, dim).where("v <> 0")


def transpose_cells(cells: DataFrame) -> DataFrame:
    """Swap rows and columns; columns beyond the shortest row are cut off."""
    lengths = cells.groupBy("row").agg((F.max("col") + 1).alias("n"))
    shortest = lengths.agg(F.min("n")).scalar()
    return cells.where(F.col("col") < shortest).select(
        F.col("col").alias("row"), F.col("row").alias("col"), "v")


def chunk_size(length: Column, n: int) -> Column:
    """Rows per chunk: ``(length - 1) / n + 1`` in whole numbers."""
    return F.floor((length - 1) / n) + 1


def chunk_rows(df: DataFrame, order: list[str], n: int, **sizing) -> DataFrame:
    """Add ``chunk``: at most ``n`` contiguous chunks along ``order``, the last one short.

    Row numbers come from the segmented ordered pass, not from one global window.
    """
    size = df.agg(chunk_size(F.count(F.lit(1)), n)).scalar()
    numbered = ordered(df, [], order, **sizing).running(
        __n=Running("sum", F.lit(1).cast("bigint"), through_row=False))
    return numbered.done().withColumn("chunk", F.floor(F.col("__n") / size)).drop("__n")


def chunk_array(values: Column, n: int) -> Column:
    """The same split for one array; an empty array has no chunks."""
    length = F.size(values).cast("bigint")
    size = chunk_size(length, n)
    starts = F.sequence(F.lit(0).cast("bigint"), length - 1, size)
    return F.when(length > 0, F.transform(
        starts, lambda s: F.slice(values, (s + 1).cast("int"), size.cast("int"))
    )).otherwise(F.slice(F.array(values), 1, 0))
