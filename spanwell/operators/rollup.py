"""Experiment logs to one rollup per file, revisions, and summary tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwell.functions import names
from spanwell.operators.ordered import dealt
from spanwell.operators.sizing import keep_matching
from spanwell.operators.spans import build_spans, span_stats
from spanwell.session import settled
from spanwell.sources.logs import ANALYSED, EVENT_ORDER, LINE_ORDER, Logs, StoredLogs, run_events, stored

IDENTITY = ["workload", "num_workers", "num_nodes"]
REVISIONS = ["framework_rev", "benchmark_rev"]

# The reported statistics and their short labels.
REPORTED = {
    "min_elapsed_time": "min",
    "max_elapsed_time": "max",
    "avg_elapsed_time": "avg",
    "ct": "ct",
}


@dataclass(frozen=True)
class Rollups:
    """``rollups``: one row per accepted file; ``rejected``: file and reason."""

    rollups: DataFrame
    rejected: DataFrame


def headers(logs: Logs) -> DataFrame:
    """First experiment record of each file with its identity and revisions."""
    # aggregates of wide rows sort; before the shuffle that would be all that a scan task reads
    found = _experiments(logs).repartition("file").groupBy("file").agg(
        F.count(F.lit(1)).alias("headers"),
        *[F.min_by(c, F.struct(*LINE_ORDER)).alias(c) for c in ("timestamp", "experiment")],
    )
    return _with_identity(found).drop("experiment")


def _experiments(logs: Logs) -> DataFrame:
    """The experiment records with their place in the log."""
    config = F.struct(*[F.col(f"data.{c}") for c in ("experiment_name", "system_config", "workload")],
                      F.col("data.git-revs").alias("git-revs"))
    return logs.records("experiment").select("file", *LINE_ORDER, "timestamp", config.alias("experiment"))


def _with_identity(df: DataFrame) -> DataFrame:
    return df.select("*", *_identity("experiment"))


def _identity(config: str) -> list:
    revs = F.col(f"{config}.`git-revs`")
    framework = F.element_at(F.map_values(F.map_filter(revs, lambda k, _: k != "benchmark")), 1)
    return [
        F.col(f"{config}.workload")["name"].alias("workload"),
        F.col(f"{config}.system_config.num_workers").alias("num_workers"),
        F.col(f"{config}.system_config.num_nodes").alias("num_nodes"),
        F.when(F.size(revs) > 1, framework).alias("framework_rev"),
        revs["benchmark"].alias("benchmark_rev"),
    ]


def rollup(logs: Logs) -> Rollups:
    """Failures, highest successful iteration and its config, for each file.

    A file needs exactly one experiment record. Numbers go through one hash aggregation
    by file with partial results before the shuffle, so one file may hold most of the
    lines; the wide rows, headers and the config of the best iteration, are then fetched by
    joins. Lines of plain logs are parsed into a table first.
    """
    kept = stored(logs, *ANALYSED, events=False)
    is_run = F.coalesce(F.col("type") == "finish_work", F.lit(False))
    # A run that does not say that it was successful has failed.
    success = is_run & F.coalesce(F.col("data.success"), F.lit(False))
    iteration = F.col("data.iteration")
    totals = kept.parsed(*ANALYSED, events=False).groupBy("file").agg(
        F.count_if(F.coalesce(F.col("type") == "experiment", F.lit(False))).alias("headers"),
        F.count_if(is_run & ~success).alias("fail_ct"),
        F.max(F.when(success, iteration)).alias("max_success_iteration"),
        F.max(F.when(success & F.col("data.stats.config").isNotNull(), iteration)).alias("best"),
    )
    best = totals.select(F.col("file").alias("best_file"), "best")
    runs = kept.records("finish_work", events=False).where("data.success").select(
        "file", *LINE_ORDER, iteration.alias("iteration"), F.col("data.stats.config").alias("config")).where("config is not null")
    # of equal iterations the first in the file counts
    configs = runs.join(best, (F.col("file") == F.col("best_file")) & (F.col("iteration") == F.col("best"))).groupBy(
        F.col("file").alias("config_file")).agg(F.min_by("config", F.struct(*LINE_ORDER)).alias("max_success_workload_config"))
    headed = totals.where("headers = 1").join(_experiments(kept).drop(*LINE_ORDER), "file")
    good = _with_identity(headed.join(configs, F.col("file") == F.col("config_file"), "left")).select(
        "file", "timestamp", "experiment", *IDENTITY, *REVISIONS, "fail_ct",
        F.coalesce("max_success_iteration", F.lit(-1).cast("bigint")).alias("max_success_iteration"),
        "max_success_workload_config",
    )
    rejected = totals.where("headers <> 1").select(
        "file",
        F.when(F.col("headers") == 0, "no experiment record")
        .otherwise("duplicate experiment record").alias("reason"),
    )
    if logs.files is not None:
        empty = logs.files.select("file").join(totals.select("file"), "file", "left_anti")
        rejected = rejected.unionByName(empty.select("file", F.lit("empty file").alias("reason")))
    return Rollups(good, rejected)


# A span event takes at least this many bytes of a log line.
EVENT_BYTES = 40


def log_span_stats(logs: Logs, **sizing) -> DataFrame:
    """Duration statistics per file over all its successful runs, in log order.

    Heavy files are found by their number of events in stored logs, else by their size, before
    any line is read where the files are known.
    """
    if isinstance(logs, StoredLogs):
        weights = logs.runs(), F.col("n_events")
    elif logs.files is not None:
        weights = logs.files, F.col("length") / EVENT_BYTES
    else:
        weights = logs.lines, F.length("value") / EVENT_BYTES
    sizing = {"weights": weights, "settle": True, **sizing}
    built = build_spans(run_events(logs, extras=False), ["file"], EVENT_ORDER, **sizing)
    return span_stats(built.spans, ["file"])


@dataclass(frozen=True)
class Analysis:
    """What all reports start from: accepted rollups and span statistics."""

    rollups: DataFrame
    stats: DataFrame


def analyse(logs: Logs, unique_revs: bool = False) -> Analysis:
    """Roll up all log files; their lines are parsed once, and both tables are small and kept on disk."""
    chosen = stored(unique_revisions(logs) if unique_revs else logs)
    rollups = settled(rollup(chosen).rollups, "rollups")
    stats = log_span_stats(chosen).join(rollups.select("file"), "file", "left_semi")
    return Analysis(rollups, settled(stats, "stats"))


def first_per_revision(
    files: DataFrame, order: list[str] | None = None, identity: list[str] | None = None
) -> DataFrame:
    """The first row of each identity and revision pair; no revision is one value.

    Rank before rejecting files: a revision counts as seen from its first header
    on. An aggregate with partial results, not a window: a revision that holds
    most rows is reduced before it moves.
    """
    keys = identity or [*IDENTITY, *REVISIONS]
    place = F.struct(*[F.col(c) for c in order]) if order else names.path_order(F.col("file"))
    return files.groupBy(*keys).agg(F.min_by(F.struct(*files.columns), place).alias("kept")).select(
        "kept.*"
    )


def unique_revisions(logs: Logs) -> Logs:
    """Only the lines of files that are first for their revision.

    The headers decide; the large scan is then cut by a semi join on file,
    before anything else of it is parsed.
    """
    kept = settled(first_per_revision(headers(logs)).select("file"), "kept-files")
    files = None if logs.files is None else keep_matching(logs.files, kept, ["file"])
    return Logs(keep_matching(logs.lines, kept, ["file"]), files)


def experiment_groups(rollups: DataFrame) -> DataFrame:
    """Files and failures for each workload and system size, in report order."""
    return (
        rollups.groupBy(*IDENTITY)
        .agg(F.count(F.lit(1)).alias("experiments"), F.sum("fail_ct").alias("failures"))
        .orderBy(*IDENTITY)
    )


def summary_table(rollups: DataFrame, stats: DataFrame, *, cut_ten: bool = False) -> DataFrame:
    """Long table: four statistics per measurement and two run figures per file.

    The rows of ``stats`` are counted, so they should be settled.
    """
    kept = rollups.select(
        "file", *IDENTITY,
        *[names.short_revision(F.col(c)).alias(c) for c in REVISIONS],
        "max_success_iteration", "fail_ct",
    )
    front = ["file", *REVISIONS, *IDENTITY]
    # the join sorts, so statistics become rows of their own after it
    by_span = kept.join(dealt(stats, ["file"], stats.count()), "file").select(
        *front, "start_phase", "end_phase",
        names.measurement(F.col("start_phase"), F.col("end_phase"), F.col("event_type"),
                          cut_ten=cut_ten).alias("measurement"),
        F.explode(F.array(*[
            F.struct(F.lit(label).alias("stat"), F.col(name).cast("double").alias("value"))
            for name, label in REPORTED.items()
        ])).alias("s"),
    ).select(*front, "start_phase", "end_phase", "measurement", "s.stat", "s.value")
    nothing = F.lit(None).cast("string")
    by_file = kept.select(
        *front, nothing.alias("start_phase"), nothing.alias("end_phase"),
        F.inline(F.array(
            F.struct(F.lit("success_iteration").alias("measurement"), F.lit("max").alias("stat"),
                     F.col("max_success_iteration").cast("double").alias("value")),
            F.struct(F.lit("failures").alias("measurement"), F.lit("ct").alias("stat"),
                     F.col("fail_ct").cast("double").alias("value")),
        )),
    )
    return by_span.unionByName(by_file)
