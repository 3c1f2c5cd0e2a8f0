"""Synthetic values by scale, scale series and arithmetic sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwell.functions.scalars import arithmetic_range
from spanwell.operators.words import _draw

KINDS = ("nstring", "pairs", "ntuple", "ones_array", "np_ones", "randints")


def _upto(n: Column) -> Column:
    """0, 1, … n-1."""
    n = n.cast("bigint")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint")) - 1)
    return F.slice(numbers, F.lit(1), n.cast("int"))


def generated(kind: str, n: Column, key: Column | None = None, seed: int = 0) -> Column:
    """One nested value of size ``n`` per row; ``key`` fixes the random one."""
    size = n.cast("int")
    if kind == "nstring":
        return F.repeat(F.lit("a"), size)
    if kind == "pairs":
        return F.map_from_arrays(_upto(n), _upto(n))
    if kind in ("ntuple", "ones_array"):
        return F.array_repeat(F.lit(1), size)
    if kind == "np_ones":
        return F.array_repeat(F.lit(1.0), size)
    if kind == "randints":
        key = key if key is not None else F.lit(0)
        return F.transform(_upto(n), lambda i: F.pmod(_draw(seed, key, i), F.lit(100)).cast("int"))
    raise ValueError(f"unknown kind {kind!r}")


def generate_rows(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """The same data with one row per entry, for sizes no single value can have."""
    ids = spark.range(n)
    if kind == "nstring":
        return ids.select(F.lit("a").alias("v"))
    if kind == "pairs":
        return ids.select(F.col("id").alias("k"), F.col("id").alias("v"))
    if kind in ("ntuple", "ones_array"):
        return ids.select(F.lit(1).alias("v"))
    if kind == "np_ones":
        return ids.select(F.lit(1.0).alias("v"))
    if kind == "randints":
        return ids.select(F.pmod(_draw(seed, F.lit(0), F.col("id")), F.lit(100)).cast("int").alias("v"))
    raise ValueError(f"unknown kind {kind!r}")


def ten_to_the(iteration: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), iteration)).cast("bigint")


def quarter_doublings(iteration: Column) -> Column:
    """Whole part of ``2 ** (iteration / 4)``."""
    return F.floor(F.pow(F.lit(2.0), iteration / F.lit(4.0)))


def tasks_for_workers(workers: Column) -> Column:
    return 100 * workers


def sweep_sizes(df: DataFrame, text: str, workers_per_node: Column) -> DataFrame:
    """Node and worker counts of each ``start:end:step`` sweep."""
    return df.withColumn("num_nodes", F.explode(arithmetic_range(F.col(text)))).withColumn(
        "num_workers", F.col("num_nodes") * workers_per_node
    )
