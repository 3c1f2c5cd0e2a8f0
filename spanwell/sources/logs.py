"""JSON-lines experiment logs: find files, parse lines, dispatch on record type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.session import shared_folder

EVENT = (
    "struct<timestamp double, worker_id string, task_id string, "
    "event_type string, status int, extras string>"
)

# The fields of each record type of an experiment log.
RECORD_TYPES = {
    "experiment": (
        "struct<experiment_name string, "
        "system_config struct<num_workers bigint, num_nodes bigint, shm_size string, mem_size string>, "
        "workload map<string,string>, `git-revs` map<string,string>>"
    ),
    "start_node": "struct<container_id string, is_head boolean, num_workers bigint, shm_size string>",
    "start_iterations": (
        "struct<workload_script string, head_container_id string, "
        "iteration_target bigint, time_target bigint>"
    ),
    "start_work": "struct<head_container_id string, iteration bigint, pid bigint>",
    "waiting": "struct<pid bigint, time_waited double, waited_time_limit double>",
    "killed": "struct<pid bigint, waited_time double, waited_time_limit double>",
    "finish_work": (
        "struct<iteration bigint, head_container_id string, workload_script string, "
        f"elapsed_time double, success boolean, "
        f"stats struct<config map<string,string>, events array<{EVENT}>>>"
    ),
    "finish_iterations": (
        "struct<workload_script string, num_successes bigint, num_failures bigint, "
        "elapsed_time double, iteration_end_reason string>"
    ),
    "stop_node": (
        "struct<container_id string, is_head boolean, stop_success boolean, remove_success boolean>"
    ),
}

# Place of a line in its file: files may be read in blocks, lines in order in each.
LINE_ORDER = ["block", "line"]


@dataclass(frozen=True)
class Logs:
    """Log lines (``file, block, line, value``) and the records in them.

    A query names the record types it needs: each line is then parsed once, and
    only into the fields of those types.
    """

    lines: DataFrame
    #: ``file, length`` of all files, those without a line included; none if they are not known
    files: DataFrame | None = None

    def records(self, *kinds: str, events: bool = True) -> DataFrame:
        """``file, block, line, type, timestamp, data`` of the given types.

        ``data`` has the fields of all of them. Without ``events`` the span
        events inside run statistics are skipped over.
        """
        parsed = self.parsed(*(kinds or RECORD_TYPES), events=events)
        return parsed.where(F.col("type").isin(list(kinds)) if kinds else F.col("type").isNotNull())

    def parsed(self, *kinds: str, events: bool = True) -> DataFrame:
        """The same for every line; the type is null where there is no record."""
        schema = T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("timestamp", T.DoubleType()),
            T.StructField("data", data_schema(*kinds, events=events)),
        ])
        return parse_once(self.lines, F.from_json("value", schema), ["file", *LINE_ORDER])

    def rejected(self) -> DataFrame:
        """Lines that are no record or hold a value that cannot be read, with the ``reason``.

        Each line is read as it should be and as text only; a value that is there as
        text and not as it should be is malformed. The other values of such a record count.
        """
        def fields(kind: str, flag: str, number: str) -> str:
            return (f"type string, timestamp {number}, data struct<iteration {kind}, success {flag}, "
                    f"stats struct<events array<struct<timestamp {number}>>>>")

        read = F.struct(
            F.from_json("value", fields("bigint", "boolean", "double")).alias("read"),
            F.from_json("value", fields("string", "string", "string")).alias("text"),
            F.from_json("value", "data string").alias("raw"),
        )
        rows = parse_once(self.lines, read, ["file", *LINE_ORDER, "value"])
        run = F.col("text.type") == "finish_work"

        def lost(name: str) -> Column:
            return F.col(f"text.{name}").isNotNull() & F.col(f"read.{name}").isNull()

        def times(side: str) -> Column:
            found = F.filter(F.col(f"{side}.data.stats.events"), lambda e: e["timestamp"].isNotNull())
            return F.coalesce(F.array_size(found), F.lit(0))

        reason = (
            F.when(F.col("text.type").isNull(), "no record")
            .when(F.col("text.type").isin(list(RECORD_TYPES)) & ~F.coalesce(F.startswith("raw.data", F.lit("{")), F.lit(False)),
                  "data is no object")
            .when(lost("timestamp"), "timestamp is no number")
            .when(run & lost("data.iteration"), "iteration is no number")
            .when(run & lost("data.success"), "success is neither true nor false")
            .when(run & (times("text") > times("read")), "event time is no number")
        )
        return rows.select("file", *LINE_ORDER, "value", reason.alias("reason")).where("reason is not null")


@dataclass(frozen=True)
class StoredLogs(Logs):
    """Logs whose lines have been parsed once, into a table.

    What a query reads of them is pruned to its types and fields by the planner.
    """

    path: str = ""

    def _table(self) -> DataFrame:
        return self.lines.sparkSession.read.parquet(self.path)

    def records(self, *kinds: str, events: bool = True) -> DataFrame:
        table = self._table().where(F.col("kind").isin(list(kinds)) if kinds else F.col("type").isNotNull())
        return table.select("file", *LINE_ORDER, "type", "timestamp", _data(kinds or tuple(RECORD_TYPES), events))

    def parsed(self, *kinds: str, events: bool = True) -> DataFrame:
        return self._table().select("file", *LINE_ORDER, "type", "timestamp", _data(kinds, events))

    def runs(self) -> DataFrame:
        """Finished runs with the number of their events."""
        return self._table().where("kind = 'finish_work'")


def _data(kinds: tuple[str, ...], events: bool) -> Column:
    """The fields of the given record types out of those of all types."""
    fields = []
    for field in data_schema(*kinds, events=events).fields:
        value = F.col(f"data.`{field.name}`")
        if field.name == "stats" and not events:
            value = F.when(value.isNotNull(), F.struct(F.col("data.stats.config").alias("config")))
        fields.append(value.alias(field.name))
    return F.struct(*fields).alias("data")


def stored(logs: Logs, *kinds: str, events: bool = True) -> StoredLogs:
    """Parse all lines once, into the shared folder; only fields of ``kinds`` (default all) are kept.

    One table with the record type as a column: folders by type would have each task sort all it has parsed.
    """
    if isinstance(logs, StoredLogs):
        return logs
    spark = logs.lines.sparkSession
    path = shared_folder(spark, "log-records")
    n_events = F.coalesce(F.array_size("data.stats.events"), F.lit(0)) if events else F.lit(None)
    parsed = logs.parsed(*(kinds or RECORD_TYPES), events=events).withColumns({
        "n_events": n_events.cast("bigint"),
        "kind": F.coalesce(F.when(F.col("type").isin(list(RECORD_TYPES)), F.col("type")), F.lit("other")),
    })
    parsed.write.parquet(path)
    return StoredLogs(logs.lines, logs.files, path)


def parse_once(df: DataFrame, parsed: Column, kept: list[str]) -> DataFrame:
    """Columns ``kept`` and the fields of a parsed struct.

    A generator over the one struct keeps the parse a step of its own; as a plain
    projection it would be repeated in every filter and field that uses it.
    """
    return df.select(*kept, F.inline(F.array(parsed)))


def data_schema(*kinds: str, events: bool = True) -> T.StructType:
    """The fields of the given record types as one struct type."""
    fields: dict[str, T.StructField] = {}
    for kind in kinds:
        if kind not in RECORD_TYPES:
            raise ValueError(f"unknown record type {kind!r}")
        for field in T.StructType.fromDDL(f"x {RECORD_TYPES[kind]}")[0].dataType.fields:
            fields[field.name] = field
    if "stats" in fields and not events:
        stats = [f for f in fields["stats"].dataType.fields if f.name != "events"]
        fields["stats"] = T.StructField("stats", T.StructType(stats))
    return T.StructType(list(fields.values()))


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    prefix: str | None = None,
    recurse: bool = True,
) -> DataFrame:
    """Lines of all log files below ``paths`` with their place in the file."""
    reader = spark.read.option("recursiveFileLookup", str(recurse).lower())
    if prefix:
        reader = reader.option("pathGlobFilter", _glob_literal(prefix) + "*")
    return reader.text(paths).select(
        decoded_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def list_files(
    spark: SparkSession, paths: str | list[str], prefix: str | None = None, recurse: bool = True
) -> DataFrame:
    """``file, length`` of all log files, empty ones included; their contents are not read.

    Scans leave empty files out, so the names come from the listing that the reader has made
    on the driver in any case. Names that begin with ``_`` or ``.`` are hidden from all of
    Spark's readers, so from here too.
    """
    def options(reader):
        reader = reader.option("recursiveFileLookup", str(recurse).lower())
        return reader.option("pathGlobFilter", _glob_literal(prefix) + "*") if prefix else reader

    listed = [(name,) for name in options(spark.read).text(paths).inputFiles()]
    names = spark.createDataFrame(listed, "uri string").select(decoded_path(F.col("uri")).alias("file"))
    sizes = options(spark.read.format("binaryFile")).load(paths).select(
        decoded_path(F.col("_metadata.file_path")).alias("file"), "length")
    return names.join(sizes, "file", "left").select("file", F.coalesce("length", F.lit(0)).alias("length"))


def decoded_path(uri: Column) -> Column:
    """A file URI as the plain path it stands for."""
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/*(?=/)", "")


def _glob_literal(text: str) -> str:
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in text)


def read_logs(
    spark: SparkSession,
    paths: str | list[str],
    prefix: str | None = None,
    recurse: bool = True,
) -> Logs:
    return Logs(read_log_lines(spark, paths, prefix, recurse), list_files(spark, paths, prefix, recurse))


# The record types that analysis reads.
ANALYSED = ("experiment", "finish_work")


def run_events(logs: Logs, extras: bool = True) -> DataFrame:
    """Span events of successful runs, one row each, in log order.

    Order in a file is ``block, line, pos``. A run without events adds none.
    Nothing else of a line is parsed, and ``extras`` only if wanted.
    """
    event = EVENT if extras else EVENT.replace(", extras string", "")
    if isinstance(logs, StoredLogs):
        runs = logs.runs().where("data.success").select("file", *LINE_ORDER, "data")
    else:
        wanted = f"type string, data struct<success boolean, stats struct<events array<{event}>>>"
        runs = parse_once(logs.lines, F.from_json("value", wanted), ["file", *LINE_ORDER]).where(
            "type = 'finish_work' and data.success")
    names = [f.name for f in T.StructType.fromDDL(f"e {event}")[0].dataType.fields]
    return runs.select(
        "file", *LINE_ORDER, F.posexplode("data.stats.events").alias("pos", "event")
    ).select("file", *LINE_ORDER, "pos", *[F.col(f"event.{n}") for n in names]).where("timestamp is not null")


EVENT_ORDER = [*LINE_ORDER, "pos"]
