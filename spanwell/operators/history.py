"""Sweep grids and run histories: streaks, outcomes, targets, waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwell.functions.scalars import keeps_running
from spanwell.operators.ordered import ALL, SEGMENT, OrderedRows, Running, ordered
from spanwell.session import settled
from spanwell.sources.logs import Logs


# Why a history ends.
FAILED_END, TARGET_END = "excessive_failures", "target_reached"


def sweep_grid(sweeps: DataFrame) -> DataFrame:
    """Every system config with every workload of the same sweep, config first.

    Both lists stand in one config row, so the grid is two explodes, no join.
    """
    kept = [c for c in sweeps.columns if c not in ("system_configs", "workloads")]
    return (
        sweeps.select(*kept, "workloads", F.posexplode("system_configs").alias("system_pos", "s"))
        .select(*kept, "system_pos", "s.*", F.posexplode("workloads").alias("workload_pos", "workload"))
    )


def cells_without_runs(grid: DataFrame, runs: DataFrame, cell: list[str]) -> DataFrame:
    """The planned cells of a sweep grid that no run belongs to; null is a value like any other."""
    match = [F.col(f"g.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in cell]
    return grid.alias("g").join(runs.select(*cell).alias("r"), match, "left_anti")


def _succeeded(success: Column) -> Column:
    """A run that does not say that it was successful has failed."""
    return F.coalesce(success, F.lit(False))


def _streaks(runs: DataFrame, keys, order, success: Column, limit: Column | None = None, **sizing) -> DataFrame:
    """Add ``run_number``, ``streak`` and, with a ``limit``, ``ends`` and ``ended`` (an earlier run ended the history).

    One pass, also where keys are cut into ranges. What a range does to the streak that comes in is a
    summary of five values: its rows, its failures after the last success, whether it has no success,
    the shortest incoming streak that ends the history in its first failures, and whether it ends it
    later on. Summaries of neighbours merge into one of the same kind, so only they are carried over.
    """
    done = _succeeded(success)
    scan = ordered(runs, keys, order, **sizing)
    window = Window.partitionBy(*scan.partition).orderBy(*scan.order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    place, reset = F.col("__place"), F.col("__reset")
    rows = scan.rows.withColumn("__place", F.count(F.lit(1)).over(so_far))
    rows = rows.withColumn("__reset", F.max(F.when(done, place)).over(so_far))
    if limit is not None:
        # in the first failures of a range the incoming streak decides, after a success the range itself
        rows = rows.withColumns({
            "__least": F.when(reset.isNull(), limit.cast("bigint") - place),
            "__late": F.coalesce(~done & (place - reset >= limit), F.lit(False)),
        }).withColumns({
            "__least_before": F.min("__least").over(earlier),
            "__late_before": F.coalesce(F.bool_or("__late").over(earlier), F.lit(False)),
        })
    if scan.segmented:
        rows = _with_carry(scan, rows, limit is not None)
    else:
        nothing = F.lit(0).cast("bigint")
        rows = rows.withColumns({"__rows": nothing, "__run": nothing, "__over": F.lit(False)})
    added = {
        "run_number": F.col("__rows") + place - 1,
        "streak": F.when(reset.isNull(), F.col("__run") + place).otherwise(place - reset),
    }
    if limit is not None:
        added["ends"] = F.coalesce(F.when(reset.isNull(), F.col("__run") >= F.col("__least")).otherwise(F.col("__late")), F.lit(False))
        added["ended"] = F.col("__over") | F.col("__late_before") | F.coalesce(F.col("__run") >= F.col("__least_before"), F.lit(False))
    return rows.withColumns(added).select(*runs.columns, *added)


def _with_carry(scan: OrderedRows, rows: DataFrame, limited: bool) -> DataFrame:
    """``rows`` with the merged summary of the ranges before: ``__rows``, ``__run`` and ``__over``."""
    reset = F.col("__reset")
    whole = F.max(reset).isNull()
    parts = rows.groupBy(*scan.partition).agg(
        F.count(F.lit(1)).alias("n"),
        whole.alias("whole"),
        (F.count(F.lit(1)) - F.coalesce(F.max(reset), F.lit(0))).alias("suffix"),
        *([F.min("__least").alias("least"), F.bool_or("__late").alias("late")] if limited else
          [F.lit(None).cast("bigint").alias("least"), F.lit(False).alias("late")]),
    )
    window = Window.partitionBy(*(scan.keys or [ALL])).orderBy(SEGMENT)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn(ALL, F.lit(0)).withColumns({
        "__rows": F.sum("n").over(earlier),
        "sum": F.sum("suffix").over(so_far),
    })
    # the streak that leaves a range: all suffixes since the last range with a success, its own included
    run = F.col("sum") - F.coalesce(
        F.last(F.when(~F.col("whole"), F.col("sum") - F.col("suffix")), ignorenulls=True).over(so_far), F.lit(0))
    merged = summed.withColumn("leaves", run).withColumn("__run", F.lag("leaves").over(window))
    here = F.col("late") | F.coalesce(F.coalesce("__run", F.lit(0)) >= F.col("least"), F.lit(False))
    merged = merged.withColumn("here", here).withColumn("__over", F.bool_or("here").over(earlier))
    carry = settled(merged.where("__rows is not null").select(*scan.partition, "__rows", "__run", "__over"), "carries")
    match = [F.col(f"r.{SEGMENT}") == F.col(f"c.{SEGMENT}")]
    match += [F.col(f"r.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in scan.keys]
    joined = rows.alias("r").join(carry.alias("c"), match, "left")
    return joined.select(
        "r.*",
        F.coalesce("c.__rows", F.lit(0)).alias("__rows"),
        F.coalesce("c.__run", F.lit(0)).alias("__run"),
        F.coalesce("c.__over", F.lit(False)).alias("__over"),
    )


def with_streaks(
    runs: DataFrame, keys: list[str], order: list[str], success: str = "success", **sizing
) -> DataFrame:
    """Add ``run_number`` (from 0) and ``streak``: failures in a row up to this run."""
    return _streaks(runs, keys, order, F.col(success), **sizing)


def executed_runs(
    runs: DataFrame, keys: list[str], order: list[str], limit: Column,
    success: str = "success", **sizing,
) -> DataFrame:
    """The runs up to the one whose failure streak reaches ``limit``.

    Adds ``run_number``, ``streak`` and ``ends`` (this run ends the history).
    """
    return _streaks(runs, keys, order, F.col(success), limit, **sizing).where("not ended").drop("ended")


def run_outcomes(
    runs: DataFrame, keys: list[str], order: list[str], limit: Column,
    success: str = "success", at: str | None = None, **sizing,
) -> DataFrame:
    """Successes, failures, last run and end reason of each history."""
    executed = executed_runs(runs, keys, order, limit, success, **sizing)
    elapsed = [(F.max(at) - F.min(at)).alias("elapsed_time")] if at else []
    return executed.groupBy(*keys).agg(
        F.count_if(_succeeded(F.col(success))).alias("num_successes"),
        F.count_if(~_succeeded(F.col(success))).alias("num_failures"),
        F.max("run_number").alias("last_run"),
        *elapsed,
        F.when(F.bool_or("ends"), FAILED_END).otherwise(TARGET_END)
        .alias("iteration_end_reason"),
    )


def with_run_number(runs: DataFrame, keys: list[str], order: list[str], **sizing) -> DataFrame:
    return ordered(runs, keys, order, **sizing).running(
        run_number=Running("sum", F.lit(1).cast("bigint"), through_row=False)
    ).done()


def with_continuation(
    runs: DataFrame, keys: list[str], order: list[str], at: str,
    iteration_target: Column, time_target: Column, **sizing,
) -> DataFrame:
    """Add ``run_number`` and ``continues``: whether the targets allow another run."""
    rows = ordered(runs, keys, order, **sizing).running(
        run_number=Running("sum", F.lit(1).cast("bigint"), through_row=False),
        __since=Running("min", F.col(at)),
    ).done()
    return rows.withColumn(
        "continues",
        keeps_running(F.col("run_number") + 1, F.col(at) - F.col("__since"),
                      iteration_target, time_target),
    ).drop("__since")


def wait_summary(logs: Logs) -> DataFrame:
    """Killed and waiting records and the longest wait of each file."""
    killed = F.col("type") == "killed"
    waited = F.when(killed, F.col("data.waited_time")).otherwise(F.col("data.time_waited"))
    return logs.records("killed", "waiting").groupBy("file").agg(
        F.count_if(killed).alias("killed"),
        F.count_if(~killed).alias("waiting"),
        F.max(waited).alias("longest_wait"),
    )
