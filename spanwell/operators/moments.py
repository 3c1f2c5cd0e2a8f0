"""Duration statistics as partial moments that can be stored, merged and finished later.

A partial row holds number, sum, mean, squared deviations from that mean, least and greatest value of some
spans of a key. Rows of one key merge in two aggregations with partial sums: the mean of all
first, then the deviations moved to it, so nothing is subtracted that nearly cancels out, however
the spans were split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_KEYS = ["start_phase", "end_phase", "event_type"]


def partial_moments(spans: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``n, total, mean, m2, least, most`` of ``elapsed`` by phase pair, event type and ``by``."""
    elapsed = F.col("elapsed")
    whole = isinstance(spans.schema["elapsed"].dataType, T.IntegralType)
    return spans.groupBy(*by, *SPAN_KEYS).agg(
        F.count(elapsed).alias("n"),
        F.sum(elapsed.cast("decimal(38,0)") if whole else elapsed).alias("total"),
        F.avg(elapsed).alias("mean"),
        (F.var_pop(elapsed) * F.count(elapsed)).alias("m2"),
        F.min(elapsed).alias("least"),
        F.max(elapsed).alias("most"),
    )


def moments_of(stats: DataFrame) -> DataFrame:
    """Finished statistics (``spans.span_stats``) as partial rows again."""
    figures = ("ct", "total_elapsed_time", "min_elapsed_time", "max_elapsed_time", "avg_elapsed_time", "stddev_elapsed_time")
    deviation = F.col("stddev_elapsed_time")
    return stats.select(
        *[c for c in stats.columns if c not in figures],
        F.col("ct").alias("n"), F.col("total_elapsed_time").alias("total"), F.col("avg_elapsed_time").alias("mean"),
        (F.col("ct") * deviation * deviation).alias("m2"), F.col("min_elapsed_time").alias("least"), F.col("max_elapsed_time").alias("most"))


def merge_moments(parts: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One partial row for each key out of any number of them."""
    keys = [*by, *SPAN_KEYS]
    total_type = parts.schema["total"].dataType
    sums = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").cast(total_type).alias("total"),
        (F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )
    match = [F.col(f"p.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    away = F.col("p.mean") - F.col("s.mean")
    moved = (
        parts.alias("p").join(sums.alias("s"), match)
        .select(*[F.col(f"p.`{k}`") for k in keys], (F.col("p.m2") + F.col("p.n") * away * away).alias("m2"))
        .groupBy(*keys).agg(F.sum("m2").alias("m2"))
    )
    match = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"m.`{k}`")) for k in keys]
    return sums.alias("s").join(moved.alias("m"), match).select(
        *[F.col(f"s.`{k}`") for k in keys], "s.n", "s.total", "s.mean", "m.m2", "s.least", "s.most")


def finished(moments: DataFrame) -> DataFrame:
    """Merged moments as the columns of ``spans.span_stats``."""
    keys = [c for c in moments.columns if c not in ("n", "total", "mean", "m2", "least", "most")]
    return moments.select(
        *keys,
        F.col("n").alias("ct"),
        F.col("total").alias("total_elapsed_time"),
        F.col("least").alias("min_elapsed_time"),
        F.col("most").alias("max_elapsed_time"),
        F.col("mean").alias("avg_elapsed_time"),
        F.sqrt(F.try_divide(F.col("m2"), F.col("n"))).alias("stddev_elapsed_time"),
    )
