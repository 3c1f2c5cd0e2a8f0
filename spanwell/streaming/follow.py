"""Follow a log folder: analyse new log files as they come, publish the latest report.

What reports need of all files so far is kept as state, a version for each batch: of each
revision the header, rollup and statistics of its first file, and the merged moments of all spans. A batch
reads the version before it and its own files, nothing else.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanwell.operators.metrics import key_metrics, stat_values
from spanwell.operators.moments import finished, merge_moments, moments_of
from spanwell.operators.rollup import first_per_revision, headers, log_span_stats, rollup
from spanwell.sources.logs import Logs, decoded_path
from spanwell.sources.writers import publish_latest
from spanwell.streaming.versions import Versions

PARTS = ("headers", "rollups", "rejected", "stats")


def follow_logs(
    spark: SparkSession, logs: str, out: str, config: DataFrame | None = None, **trigger
) -> StreamingQuery:
    """Analyse each finished log file once; a file must be complete when it appears.

    Every batch writes its part of the rollup tables under its own number, so a
    batch that is repeated after a failure replaces itself, and a new version of the state. With a metric config
    the key-metric report over all files so far is then published to
    ``out/latest``, one result per revision. The trigger is ``availableNow``
    unless given.
    """
    state = Versions(spark, f"{out}/state").begin()
    lines = spark.readStream.option("recursiveFileLookup", "true").text(logs).select(
        decoded_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )

    def analyse_batch(batch: DataFrame, number: int) -> None:
        # the parts read the batch's lines several times, the source only once
        lines = batch.withColumn("line", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
        found = Logs(lines)
        rolled = rollup(found)
        parts = (headers(found), rolled.rollups, rolled.rejected, log_span_stats(found))
        own = {}
        for name, part in zip(PARTS, parts):
            path = f"{out}/{name}/batch={number}"
            part.write.mode("overwrite").parquet(path)
            own[name] = spark.read.schema(part.schema).parquet(path)
        lines.unpersist()
        keep_state(state, number, own)
        if config is not None:
            publish_latest(report(spark, out, config), f"{out}/latest", number)

    return (
        lines.writeStream.foreachBatch(analyse_batch)
        .option("checkpointLocation", f"{out}/_progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def followed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the tables that ``follow_logs`` keeps."""
    return spark.read.parquet(f"{out}/{name}").drop("batch")


def keep_state(state: Versions, number: int, own: dict[str, DataFrame]) -> None:
    """The next version of the state: the one before, and the parts of one batch."""
    before = state.latest(number)

    def so_far(name: str, new: DataFrame) -> DataFrame:
        return new if before is None else state.read(name, before).unionByName(new)

    rolled = own["rollups"].select(F.col("file").alias("rolled_file"), F.struct(*own["rollups"].columns).alias("rollup"))
    seen = own["headers"].join(rolled, F.col("file") == F.col("rolled_file"), "left").drop("rolled_file")
    kept = state.write("kept", number, first_per_revision(so_far("kept", seen)))
    accepted = kept.where("rollup is not null").select(F.col("file").alias("kept_file"))
    stats = so_far("stats", own["stats"])
    state.write("stats", number, stats.join(accepted, F.col("file") == F.col("kept_file"), "left_semi"))
    # a file counts if it has one header, whether its revision was seen before or not
    counted = own["stats"].join(rolled, F.col("file") == F.col("rolled_file"), "left_semi").drop("file")
    state.write("moments", number, merge_moments(so_far("moments", moments_of(counted))))
    state.list(number, "kept", "stats", "moments")


def report(spark: SparkSession, out: str, config: DataFrame) -> DataFrame:
    """Key metrics over all files so far, the first file of each revision; only the state is read."""
    rollups, stats = kept_tables(spark, out)
    return key_metrics(rollups, stat_values(rollups, stats), config)


def kept_tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Rollups and span statistics of the first file of each revision."""
    state = Versions(spark, f"{out}/state")
    number = state.latest()
    return state.read("kept", number).where("rollup is not null").select("rollup.*"), state.read("stats", number)


def span_stats_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Duration statistics over all files so far, by phase pair and event type."""
    state = Versions(spark, f"{out}/state")
    return finished(state.read("moments", state.latest()))
