"""Sinks: event dumps, log records, published reports, partitioned experiments."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_dump(
    events: DataFrame,
    path: str,
    workers: DataFrame | None = None,
    config: DataFrame | None = None,
    form: str = "parquet",
) -> None:
    """Write span events, the registry and the config side by side.

    Rows stay rows (``path/events``, ``path/workers``, ``path/config``), so no
    dump has to fit one task; ``form="json"`` writes gzip JSON lines.
    """
    for name, part in (("events", events), ("workers", workers), ("config", config)):
        if part is not None:
            writer = part.write.mode("overwrite").format(form)
            if form == "json":
                writer = writer.option("compression", "gzip").option("ignoreNullFields", "false")
            writer.save(f"{path}/{name}")


def dump_documents(dumps: DataFrame) -> DataFrame:
    """Dumps (``config, events, worker_ips`` in one row) as JSON text rows."""
    return dumps.select(F.to_json(F.struct("config", "events", "worker_ips")).alias("value"))


def write_dump_documents(dumps: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Single-document dumps in gzip JSON, for readers of the file format."""
    columns = [*(partition_by or []), "config", "events", "worker_ips"]
    writer = dumps.select(*columns).write.mode("overwrite").option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def log_line(kind: Column, timestamp: Column, data: Column) -> Column:
    """One log record as JSON text; absent fields are left out."""
    return F.to_json(
        F.struct(kind.alias("type"), timestamp.cast("double").alias("timestamp"), data.alias("data"))
    )


def append_records(lines: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append JSON lines (column ``value``) as text, optionally by folder."""
    writer = lines.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.text(path)


EXPERIMENT_FOLDERS = ["experiment", "run_ts", "workload", "num_nodes", "num_workers"]


def write_experiments(df: DataFrame, base: str) -> None:
    """Records by experiment, run time and identity, one folder level for each.

    Rows are gathered by folder first, and the planner splits a folder with many rows by
    their measured size: few files per folder, and a folder with most rows is still written by
    several tasks.
    """
    df.hint("rebalance", *EXPERIMENT_FOLDERS).write.mode("append").partitionBy(*EXPERIMENT_FOLDERS).parquet(base)


def log_path_parts(path: Column) -> list[Column]:
    """Identity from ``base/experiment/YYYYmmdd_HHMMSS/{workload}_{nodes}_{workers}_{shm}.log``."""
    pattern = r"([^/]+)/([0-9]{8}_[0-9]{6})/([^/]+)_([0-9]+)_([0-9]+)_([^/_]+)\.log$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))

    return [
        part(1).alias("experiment"),
        part(2).alias("run_ts"),
        part(3).alias("workload"),
        part(4).cast("bigint").alias("num_nodes"),
        part(5).cast("bigint").alias("num_workers"),
        part(6).alias("shm_size"),
    ]


def publish_latest(report: DataFrame, path: str, number: int | None = None) -> None:
    """Make this report the latest one below ``path``.

    The report is written under its number (the time, unless given) first, and only then is
    the number listed as published: readers see the old report or the new one, whole, and
    a job that fails in between changes nothing for them.
    """
    number = time.time_ns() if number is None else number
    report.write.mode("overwrite").json(f"{path}/reports/number={number}")
    listed = report.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("published"))
    listed.write.mode("append").parquet(f"{path}/published")


def read_latest(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The report published last."""
    number = spark.read.parquet(f"{path}/published").agg(F.max("published")).first()[0]
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path}/reports/number={number}")
