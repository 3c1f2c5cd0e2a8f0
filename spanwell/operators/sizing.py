"""Joins against lookup tables of any size, with any skew of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwell.operators.ordered import segment_limit
from spanwell.session import settled


def keep_matching(big: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``big`` whose keys stand in ``lookup`` (no nulls).

    A plain semi join: the planner broadcasts the lookup if it measures it to be small,
    and splits the partitions of heavy keys otherwise.
    """
    return big.join(lookup.select(*keys), keys, "left_semi")


def salted_lookup(
    big: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], heavy_rows: int | None = None,
) -> DataFrame:
    """Inner join on ``keys`` for any size of either side and any key skew.

    The lookup has one row per key; null keys match. Rows of a key above ``heavy_rows``
    are spread over as many tasks as its counted rows need, by the ``spread`` columns, and
    only the lookup rows of such keys are repeated.
    """
    limit = heavy_rows or segment_limit(big.sparkSession)
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    heavy = settled(
        counts.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], F.ceil(F.col("n") / limit).alias("__salts")),
        "heavy-keys",
    )

    def with_salts(df: DataFrame) -> DataFrame:
        match = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"h.`__{k}`")) for k in keys]
        return df.alias("d").join(heavy.alias("h"), match, "left").select(
            *[F.col(f"d.`{c}`") for c in df.columns], F.coalesce("h.__salts", F.lit(1)).alias("__salts"))

    left = with_salts(big).withColumn("__salt", F.pmod(F.xxhash64(*spread), F.col("__salts"))).alias("l")
    right = with_salts(lookup).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1))).alias("r")
    match = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    match.append(F.col("l.__salt") == F.col("r.__salt"))
    extra = [c for c in lookup.columns if c not in keys]
    return left.join(right, match).select(
        *[F.col(f"l.`{c}`") for c in big.columns], *[F.col(f"r.`{c}`") for c in extra]
    )
