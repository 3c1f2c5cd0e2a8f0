"""Start and finish events to spans, phases and duration statistics.

Events: ``worker_id, task_id, event_type, status, timestamp`` plus columns that
name the session and the order of events in it. ``timestamp`` may be any numeric
type; elapsed time has the same type, so integer microseconds stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.functions import names
from spanwell.operators.ordered import Running, ordered

# Event status codes.
STARTED, FINISHED = 1, 2

# Fixed value: a span that runs into the next phase for less than this share of
# its time is counted under the phase it started in.
SLIP_SHARE = 0.1

SPAN_KEY = ["worker_id", "task_id", "event_type"]


@dataclass(frozen=True)
class Spans:
    """``spans`` that finished, and the events that break the start/finish rule."""

    spans: DataFrame
    events: DataFrame
    paired: DataFrame
    session: list[str]
    order: list[str]

    @property
    def errors(self) -> DataFrame:
        """Duplicate starts, finishes without a start, phase events of unknown status."""
        status = F.col("status")
        columns = list(dict.fromkeys(
            [*self.session, *SPAN_KEY, *self.order, "timestamp", "status"]))
        unpaired = self.paired.withColumn("reason", pair_error()).where("reason is not null")
        unknown = self.events.where(
            names.is_phase(F.col("event_type"))
            & ~F.coalesce(status.isin(STARTED, FINISHED), F.lit(False))
        ).withColumn("reason", F.lit("unknown status"))
        return unpaired.select(*columns, "reason").unionByName(unknown.select(*columns, "reason"))

    @property
    def open(self) -> DataFrame:
        """Starts that never finish: keys whose last event is a start."""
        key = [*self.session, *SPAN_KEY]
        last = F.max_by(F.struct("status", "timestamp", "phase"), F.struct(*self.order))
        return (
            self.paired.groupBy(*key).agg(last.alias("last"))
            .where(F.col("last.status") == STARTED)
            .select(*key, F.col("last.timestamp").alias("started"),
                    F.col("last.phase").alias("start_phase"))
        )


def with_phase(
    events: DataFrame,
    session: list[str],
    order: list[str],
    **sizing,
) -> DataFrame:
    """Add ``phase``, ``phase_at`` (last change) and ``phase_number`` to each event.

    A phase event sets the phase for itself when it starts and clears it only
    for the events after it when it finishes.
    """
    marked, _ = _phase_rows(events, session, order, **sizing)
    return marked


def _phase_rows(events, session, order, **sizing) -> tuple[DataFrame, bool]:
    kind, status = F.col("event_type"), F.col("status")
    marks = names.is_phase(kind) & status.isin(STARTED, FINISHED)
    ends = names.is_phase(kind) & (status == FINISHED)
    change = F.when(
        marks,
        F.struct(
            F.when(status == STARTED, names.phase_name(kind)).alias("phase"),
            F.col("timestamp").alias("at"),
        ),
    )
    scan = ordered(events, session, order, **sizing)
    state = scan.running(
        __upto=Running("last", change),
        __before=Running("last", change, through_row=False),
        phase_number=Running("sum", F.when(ends, 1).otherwise(0).cast("bigint"), through_row=False),
    )
    seen = F.when(ends, F.col("__before")).otherwise(F.col("__upto"))
    rows = state.done().withColumns(
        {"phase": seen["phase"], "phase_at": seen["at"]}
    ).drop("__upto", "__before")
    return rows, scan.segmented


def build_spans(
    events: DataFrame,
    session: list[str] | None = None,
    order: list[str] | None = None,
    slip: float = SLIP_SHARE,
    phases: bool = True,
    **sizing,
) -> Spans:
    """Pair each finish with the open start of its key and give it its phases.

    When no session is heavy, the events stay partitioned by session: one
    shuffle serves the phase state, the pairing and any later rollup by session.
    """
    session, order = session or ["session"], order or ["timestamp", "seq"]
    key = [*session, *SPAN_KEY]
    known = events.where(F.col("status").isin(STARTED, FINISHED))
    if phases:
        rows, heavy_session = _phase_rows(known, session, order, **sizing)
    else:
        rows, heavy_session = known.withColumns(
            {
                "phase": F.lit(None).cast("string"),
                "phase_at": F.lit(None).cast(events.schema["timestamp"].dataType),
                "phase_number": F.lit(0).cast("bigint"),
            }
        ), True
    this = F.struct("status", "timestamp", "phase", "phase_number")
    # The session weights say nothing about single span keys.
    sized = {**sizing, "weights": None, "look": known} if heavy_session else {"fits": True}
    paired = ordered(rows, key, order, **sized).running(
        __open=Running("last", this, through_row=False)
    ).done()

    spans = paired.where(is_span()).select(
        *session,
        *SPAN_KEY,
        *[c for c in order if c != "timestamp"],
        *[column.alias(name) for name, column in span_columns(slip).items()],
    )
    return Spans(spans, events, paired, session, order)


def is_span() -> Column:
    """A finish whose key has an open start; ``__open`` is the event before it in its key."""
    return (F.col("status") == FINISHED) & (F.col("__open.status") == STARTED)


def pair_error() -> Column:
    """Why an event breaks the start/finish rule; null if it does not."""
    status, before = F.col("status"), F.col("__open.status")
    return F.when((status == STARTED) & (before == STARTED), "already started").when(
        (status == FINISHED) & ~before.eqNullSafe(F.lit(STARTED)), "finish without start")


def span_columns(slip: float) -> dict[str, Column]:
    """Times and phases of the span that a finish ends."""
    before = F.col("__open")
    number, end_phase = before["phase_number"], F.col("phase")
    start_phase, elapsed = before["phase"], F.col("timestamp") - before["timestamp"]
    slipped = F.coalesce(
        ~start_phase.eqNullSafe(end_phase)
        & (F.col("phase_number") == number + 1)
        & (F.try_divide((F.col("timestamp") - F.col("phase_at")).cast("double"),
                        elapsed.cast("double")) < slip),
        F.lit(False),
    )
    return {
        "started": before["timestamp"], "finished": F.col("timestamp"), "elapsed": elapsed, "start_phase": start_phase,
        "end_phase": F.when(slipped, start_phase).otherwise(end_phase), "slipped": slipped,
    }


def duration_columns(elapsed: Column, whole: bool = False) -> list[Column]:
    """Duration statistics; ``whole`` numbers are summed as decimals, which do not overflow."""
    summed = elapsed.cast("decimal(38,0)") if whole else elapsed
    return [
        F.count(elapsed).alias("ct"),
        F.sum(summed).alias("total_elapsed_time"),
        F.min(elapsed).alias("min_elapsed_time"),
        F.max(elapsed).alias("max_elapsed_time"),
        F.avg(elapsed).alias("avg_elapsed_time"),
        F.stddev_pop(elapsed).alias("stddev_elapsed_time"),
    ]


def span_stats(spans: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Duration statistics by phase pair and event type, and ``by`` if given."""
    whole = isinstance(spans.schema["elapsed"].dataType, T.IntegralType)
    return spans.groupBy(*by, "start_phase", "end_phase", "event_type").agg(
        *duration_columns(F.col("elapsed"), whole)
    )


def span_report(stats: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One line per span key, sorted: ``total,ct,[min,avg,max],stddev``."""
    key = names.span_key(F.col("start_phase"), F.col("end_phase"), F.col("event_type"))
    shown = [
        F.col(c).cast("double")
        for c in ("total_elapsed_time", "min_elapsed_time", "avg_elapsed_time",
                  "max_elapsed_time", "stddev_elapsed_time")
    ]
    line = F.format_string(
        "%.6f,%d,[%.6f,%.6f,%.6f],%.6f", shown[0], F.col("ct"), *shown[1:]
    )
    return stats.select(*by, key.alias("key"), line.alias("line")).orderBy("key", *by)


def headline(stats: DataFrame, by: list[str]) -> DataFrame:
    """Average time of the measure phase itself, for each dump or session."""
    return stats.where(
        (F.col("start_phase") == "measure")
        & (F.col("end_phase") == "measure")
        & (F.col("event_type") == names.PHASE_PREFIX + "measure")
    ).select(*by, "avg_elapsed_time")


def stats_document(stats: DataFrame, by: list[str], config: Column | None = None) -> DataFrame:
    """``{config, timing}`` as JSON text, one document for each ``by`` group.

    A group holds one entry per distinct span key, not per span.
    """
    timing = F.struct(
        "ct", "total_elapsed_time", "min_elapsed_time", "max_elapsed_time",
        "avg_elapsed_time", "stddev_elapsed_time",
    )
    key = names.span_key(F.col("start_phase"), F.col("end_phase"), F.col("event_type"))
    entries = F.sort_array(F.collect_list(F.struct(key.alias("key"), timing.alias("value"))))
    config = config if config is not None else F.create_map().cast("map<string,string>")
    return (
        stats.groupBy(*by).agg(entries.alias("entries"))
        .select(*by, F.to_json(F.struct(
            config.alias("config"), F.map_from_entries("entries").alias("timing"),
        )).alias("document"))
    )


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"))
