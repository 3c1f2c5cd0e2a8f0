"""Trace sources: binary-keyed records, worker registries, event dumps, stdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanwell.functions.scalars import (
    EVENT_TASK_AT, EVENT_WORKER_AT, REGISTRY_WORKER_AT, hex_id,
)
from spanwell.sources.logs import EVENT, decoded_path, parse_once

# The fields of event dumps and run statistics.
DUMP = (
    f"config map<string,string>, events array<{EVENT}>, worker_ips map<string,string>"
)
STATS = f"config map<string,string>, events array<{EVENT}>, timing map<string,double>"

# Fixed value: the line a workload prints its statistics on.
STATS_LINE = r"(?m)^BENCHMARK_STATS: (\{.*\})$"


def _tuples(raw: DataFrame) -> DataFrame:
    """Each element of the records' arrays as text, with its place, its fields and the raw columns."""
    elements = raw.select("*", F.posexplode_outer(F.from_json("value", "array<string>")).alias("pos", "element"))
    return parse_once(elements, F.struct(F.from_json("element", "array<string>").alias("event")), ["*"])


NO_ARRAY, FEW_FIELDS = "value is no array", "fewer than four fields"
NO_TIMESTAMP, NO_STATUS = "timestamp is no number", "status is no number"
REASONS = (NO_ARRAY, FEW_FIELDS, NO_TIMESTAMP, NO_STATUS)


def _reason() -> Column:
    event = F.col("event")
    return (
        F.when(F.col("pos").isNull() & ~F.coalesce(F.trim("value") == "[]", F.lit(False)), NO_ARRAY)
        .when(F.col("pos").isNotNull() & (F.coalesce(F.array_size(event), F.lit(0)) < 4), FEW_FIELDS)
        .when(F.col("pos").isNotNull() & F.get(event, F.lit(0)).try_cast("double").isNull(), NO_TIMESTAMP)
        .when(F.col("pos").isNotNull() & F.get(event, F.lit(2)).try_cast("int").isNull(), NO_STATUS)
    )


def decode_records(raw: DataFrame, index: str | None = None, counts: Observation | None = None) -> DataFrame:
    """Raw trace records (binary ``key``, JSON ``value``) to span events.

    The value is an array of ``[timestamp, event_type, status, extras]``. ``index`` names a
    column with the place of a record among those of its key, which is let through. What
    cannot be read is in ``rejected_records``; ``counts`` is told by the first action on the result how many
    elements have been read, and how many were rejected for each of ``REASONS``, without
    another parse. That action should write the events without a shuffle (as ``settled`` does): a
    stage before a shuffle that is run again after the loss of an executor would count twice.
    """
    tuples = _tuples(raw)
    if counts is None:
        events = tuples.where(F.col("pos").isNotNull() & _reason().isNull())
    else:
        reason = F.col("__reason")
        seen = tuples.withColumn("__reason", _reason()).observe(
            counts,
            F.count_if(F.col("pos").isNotNull() & reason.isNull()).alias("read"),
            *(F.count_if(reason == r).alias(r) for r in REASONS),
        )
        events = seen.where(F.col("pos").isNotNull() & reason.isNull())
    field = lambda i: F.get("event", F.lit(i))
    return events.select(
        hex_id(F.col("key"), EVENT_WORKER_AT).alias("worker_id"),
        hex_id(F.col("key"), EVENT_TASK_AT).alias("task_id"),
        *([F.col(index)] if index else []),
        "pos",
        field(0).try_cast("double").alias("timestamp"),
        field(1).alias("event_type"),
        field(2).try_cast("int").alias("status"),
        field(3).alias("extras"),
    )


def rejected_records(raw: DataFrame) -> DataFrame:
    """Elements, or whole values, that are no span event: the raw columns, ``pos``, ``element``, ``reason``."""
    return _tuples(raw).withColumn("reason", _reason()).where("reason is not null").drop("event")


def variant_records(raw: DataFrame) -> DataFrame:
    """Raw trace records to span events whose extras keep their JSON types: ``extras`` is a VARIANT.

    One parse for each value, of which the fields are read in place. The elements are those
    of ``decode_records``: fewer than four fields, or a timestamp or status that is no number, and a value
    that is no array give no event. Extras that are JSON null are a variant null, not a missing value.
    """
    events = parse_once(raw, F.struct(F.from_json("value", "array<variant>").alias("elements")), ["*"]).select(
        "key", F.posexplode("elements").alias("pos", "event"))
    field = lambda i, kind: F.try_variant_get("event", f"$[{i}]", kind)
    return events.select(
        hex_id(F.col("key"), EVENT_WORKER_AT).alias("worker_id"),
        hex_id(F.col("key"), EVENT_TASK_AT).alias("task_id"),
        "pos",
        field(0, "double").alias("timestamp"),
        field(1, "string").alias("event_type"),
        field(2, "int").alias("status"),
        field(3, "variant").alias("extras"),
    ).where("timestamp is not null and status is not null and extras is not null")


def presence(document: Column, name: str) -> Column:
    """``absent``, ``null`` or ``value``: whether a variant object has a key, and whether it holds JSON null.

    Anything but an object, a missing document included, has no keys.
    """
    found = F.try_variant_get(document, f"$['{name}']", "variant")
    return F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null").otherwise("value")


def decode_workers(raw: DataFrame, driver_ip: str) -> DataFrame:
    """Registry records (binary ``key``, ``node_ip_address``) plus the driver's row."""
    workers = raw.select(
        hex_id(F.col("key"), REGISTRY_WORKER_AT).alias("worker_id"),
        F.col("node_ip_address").alias("ip"),
    )
    driver = raw.sparkSession.range(1).select(
        F.lit("DRIVER").alias("worker_id"), F.lit(driver_ip).alias("ip")
    )
    return workers.unionByName(driver)


def with_addresses(events: DataFrame, workers: DataFrame) -> DataFrame:
    """Add the ``ip`` of each event's worker; null if the registry (a row per worker) lacks it.

    A plain join: the planner broadcasts a registry that it measures to be small and splits
    the partitions of workers with most events otherwise.
    """
    known = workers.select(F.col("worker_id").alias("__worker"), "ip")
    return events.join(known, F.col("worker_id") == F.col("__worker"), "left").drop("__worker")


def read_dumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Event dumps, one JSON document per file (gzip by extension), both shapes."""
    return (
        spark.read.schema(DUMP).option("multiLine", True).json(paths)
        .select(decoded_path(F.col("_metadata.file_path")).alias("file"), "config", "events", "worker_ips")
    )


def parse_dumps(documents: DataFrame, text: str = "value") -> DataFrame:
    """Dumps already loaded as one document per row."""
    kept = [c for c in documents.columns if c != text]
    return documents.select(*kept, F.from_json(text, DUMP).alias("dump")).select(*kept, "dump.*")


def dump_events(dumps: DataFrame) -> DataFrame:
    """One row per event; ``pos`` keeps the order of a dump."""
    kept = [c for c in dumps.columns if c not in ("config", "events", "worker_ips")]
    return dumps.select(*kept, F.posexplode("events").alias("pos", "event")).select(
        *kept, "pos", "event.*"
    )


def dump_workers(dumps: DataFrame) -> DataFrame:
    kept = [c for c in dumps.columns if c not in ("config", "events", "worker_ips")]
    return dumps.select(*kept, F.explode("worker_ips").alias("worker_id", "ip"))


def extract_stats(df: DataFrame, text: str = "stdout") -> DataFrame:
    """Add ``stats`` from the first statistics line of captured output.

    Without such a line ``stats`` is an empty object: no config, no events.
    """
    found = F.regexp_extract(F.col(text), STATS_LINE, 1)
    return df.withColumn(
        "stats", F.from_json(F.when(found != "", found).otherwise("{}"), STATS)
    )
