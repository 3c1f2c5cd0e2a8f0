"""Running values over ordered rows, safe for keys that hold much of the data.

A window partitioned by key sorts a whole key in one task. Where a key is too large for
that, or there is no key, the rows are range-partitioned along keys and order, written once
with the number of their range, and each range of a key is a window partition of its own.
What a range needs from the ones before it is an aggregate by range (combined map-side);
only ranges that continue a key take anything over, so the table that is joined back has
at most a row for each range, whatever the number of keys and rows. Where all keys are light the plan
is the ordinary window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.session import settled

SEGMENT_ROWS_CONF = "spanwell.segment.rows"
SEGMENT_ROWS = 4_000_000      # rows one task may sort for one key
TASK_ROWS = 500_000           # rows of light keys that one task gets, as counted

SEGMENT = "__seg"
ALL = "__all"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, max, min or last (last non-null)."""

    how: str
    value: Column
    through_row: bool = True   # False: only the rows before this one


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a total order inside each key (``keys`` may be empty)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    segmented: bool

    @property
    def partition(self) -> list[str]:
        return [*self.keys, SEGMENT] if self.segmented else list(self.keys)

    def running(self, **values: Running) -> "OrderedRows":
        """Add running values; all of one call share one sort."""
        window = Window.partitionBy(*self.partition).orderBy(*self.order)
        rows = self.rows
        local = {}
        for name, spec in values.items():
            last = Window.currentRow if spec.through_row else -1
            frame = window.rowsBetween(Window.unboundedPreceding, last)
            local[name] = _combine(spec).over(frame)
        if not self.segmented:
            done = {
                name: F.coalesce(column, F.lit(0)) if values[name].how == "sum" else column
                for name, column in local.items()
            }
            return replace(self, rows=rows.withColumns(done))

        carry = self._carry(values)
        rows = rows.withColumns(local)
        match = [F.col(f"r.{SEGMENT}") == F.col(f"c.{SEGMENT}")]
        match += [F.col(f"r.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in self.keys]
        joined = rows.alias("r").join(carry.alias("c"), match, "left")
        kept = [F.col(f"r.`{c}`") for c in rows.columns if c not in local]
        merged = [
            _merge(spec.how, F.col(f"r.`{name}`"), F.col(f"c.`{name}`")).alias(name)
            for name, spec in values.items()
        ]
        return replace(self, rows=joined.select(*kept, *merged))

    def _carry(self, values: dict[str, Running]) -> DataFrame:
        """What each range that continues a key takes over; at most a row per range."""
        numbers = {n: spec for n, spec in values.items() if spec.how != "last"}
        lasts = {n: spec for n, spec in values.items() if spec.how == "last"}
        # Every segment has a row here, also one with nothing to take over.
        totals = self.rows.groupBy(*self.partition).agg(
            F.count(F.lit(1)).alias("__rows"),
            *[_combine(spec).alias(n) for n, spec in numbers.items()],
        )
        if lasts:
            # Last values need a sort; only rows that have one go there.
            some = reduce(lambda a, b: a | b, [spec.value.isNotNull() for spec in lasts.values()])
            position = F.struct(*self.order)
            found = self.rows.where(some).groupBy(*self.partition).agg(*[
                F.max_by(spec.value, F.when(spec.value.isNotNull(), position)).alias(n)
                for n, spec in lasts.items()
            ])
            match = [F.col(f"t.`{c}`").eqNullSafe(F.col(f"l.`{c}`")) for c in self.partition]
            totals = totals.alias("t").join(found.alias("l"), match, "left").select(
                "t.*", *[F.col(f"l.`{n}`") for n in lasts])
        # Without keys all ranges are one partition of this window: as many rows as there are ranges.
        before = (
            Window.partitionBy(*(self.keys or [ALL])).orderBy(SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        taken = totals.withColumn(ALL, F.lit(0)).select(
            *self.partition,
            F.count(F.lit(1)).over(before).alias("__earlier"),
            *[_combine(replace(spec, value=F.col(name))).over(before).alias(name)
              for name, spec in values.items()],
        )
        return settled(taken.where("__earlier > 0").drop("__earlier"), "carries")

    def done(self) -> DataFrame:
        return self.rows.drop(SEGMENT)


def ordered(
    df: DataFrame,
    keys: list[str] | tuple[str, ...],
    order: list[str] | tuple[str, ...],
    *,
    fits: bool = False,
    segment_rows: int | None = None,
    weights: tuple[DataFrame, Column] | None = None,
    look: DataFrame | None = None,
    settle: bool = False,
    gather: bool = False,
) -> OrderedRows:
    """Prepare ``df`` for running values.

    ``order`` must leave no ties inside a key. ``fits`` says that the keys are
    known to be light (for example finer than keys already looked at), which
    spares the look at the data. ``weights`` looks at another table with the
    key columns instead, where an upper bound of the rows is cheaper to sum, and
    ``look`` at one with the same rows that is cheaper to make.
    ``settle`` is for rows that are costly to make: if they have to be cut, which
    takes several passes, they are written to the shared folder once before. ``gather``
    writes ranges of narrow rows together, as ``gathered`` has it.
    """
    keys, order = tuple(keys), tuple(order)
    if fits:
        return OrderedRows(df, keys, order, False)
    limit = segment_rows or segment_limit(df.sparkSession)
    seen, weight = weights or (df if look is None else look, F.lit(1))
    total, most = _sizes(seen, weight, keys)
    if keys and most <= limit:
        return OrderedRows(dealt(df, keys, total), keys, order, False)
    return OrderedRows(_ranged(settled(df, "rows") if settle else df, keys, order, total, limit, gather), keys, order, True)


def segment_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(SEGMENT_ROWS_CONF, str(SEGMENT_ROWS)))


def _sizes(df: DataFrame, weight: Column, keys: tuple[str, ...]) -> tuple[int, int]:
    """Rows (or weights) in all and of the largest key: two numbers from exact counts by key."""
    counts = df.groupBy(*keys).agg(F.sum(weight).cast("bigint").alias("n")) if keys else df.agg(
        F.sum(weight).cast("bigint").alias("n"))
    found = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return found["total"] or 0, found["most"] or 0


def dealt(df: DataFrame, keys: list[str] | tuple[str, ...], total: int, always: bool = False) -> DataFrame:
    """``df`` by keys, in as many partitions as its ``total`` rows need.

    Where a part for each core is small enough it stays as it is, or is dealt as the planner likes (``always``).
    The planner sizes partitions by their compressed bytes, and has no more of them than one setting says.
    """
    parts = -(-total // TASK_ROWS)
    by = [F.col(f"`{c}`") for c in keys]
    if parts > df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(parts, *by)
    return df.repartition(*by) if always else df


def gathered(df: DataFrame, total: int) -> DataFrame:
    """``df`` in at most as many partitions as its ``total`` rows need, one for each core at least; nothing is shuffled.

    For narrow rows that are written next: Hadoop's local file system starts processes for every file, and
    a table of a few rows would be as many files as there are shuffle partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)))


def _ranged(
    df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], total: int, limit: int, gather: bool = False,
) -> DataFrame:
    """``df`` cut into ranges along keys and order, with each row's range in a column.

    The ranges follow from a sample, so they are fixed by writing them once.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    cut = df.repartitionByRange(ranges, *[F.col(f"`{c}`") for c in (*keys, *order)])
    cut = cut.withColumn(SEGMENT, F.spark_partition_id())
    return settled(gathered(cut, total) if gather else cut, "ranges")


def _combine(spec: Running) -> Column:
    if spec.how == "sum":
        return F.sum(spec.value)
    if spec.how == "max":
        return F.max(spec.value)
    if spec.how == "min":
        return F.min(spec.value)
    if spec.how == "last":
        return F.last(spec.value, ignorenulls=True)
    raise ValueError(f"unknown running value {spec.how!r}")


def _merge(how: str, local: Column, carried: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if how == "max":
        return F.greatest(local, carried)
    if how == "min":
        return F.least(local, carried)
    return F.coalesce(local, carried)
