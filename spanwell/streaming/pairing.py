"""Pair starts and finishes in a stream of events, with the state kept from batch to batch.

A session's state is what the events so far leave behind: its phase, the time and number of phase changes,
the place of its last event, and the starts that are still open. ``follow_spans`` keeps it as a table, a
version for each batch: its rows stand before the batch's events in the windows of ``spans.build_spans``, so
a batch is one plan whatever the number of sessions, and a stopped stream goes on where it was. Each batch
writes the state of all sessions anew: two or so rows for a session, and nothing of finished spans. A heavy session is cut
into ranges. Without phases the state is that of one span key.

``stream_spans`` gives the same rows as a streaming DataFrame, for a sink of the caller's own, with the state
in the state store under the session's key and one Python call for each session and batch. It is for
batches that touch few of many sessions; a batch of many sessions spends most of its time in those calls.

Events of one state must arrive in their order, batch by batch; inside a batch any order will do.
An event that is older than its state is an error (``late``) and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanwell.functions import names
from spanwell.operators.moments import merge_moments, partial_moments
from spanwell.operators.ordered import Running, ordered
from spanwell.operators.spans import FINISHED, SLIP_SHARE, SPAN_KEY, STARTED, is_span, pair_error, span_columns
from spanwell.session import forget, settled
from spanwell.streaming.versions import Versions

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Rows of a batch's windows in the order in which they stand: state of a session, open starts, events.
MARK, OPEN, EVENT = 0, 1, 2
# What an event is: of unknown status, older than its state, or taken.
UNKNOWN, LATE, TAKEN = 1, 2, 3


class SessionState:
    """Phase and open starts of a session; takes events in order and gives spans and errors."""

    def __init__(self, text: str | None, phases: bool, slip: float):
        found = json.loads(text) if text else {}
        self.phases, self.slip = phases, slip
        self.phase, self.phase_at, self.number = found.get("phase"), found.get("phase_at"), found.get("number", 0)
        self.last = found.get("last")
        #: Of each span key the time, phase and phase number of its open start.
        self.open = {tuple(key): start for key, start in found.get("open", [])}

    def text(self) -> str:
        return json.dumps({
            "phase": self.phase, "phase_at": self.phase_at, "number": self.number, "last": self.last,
            "open": [[list(key), start] for key, start in self.open.items()],
        })

    def take(self, key: tuple, status: int, at, place: list) -> dict | None:
        """The span or error that an event gives, if any."""
        is_phase = key[-1] is not None and key[-1].startswith(names.PHASE_PREFIX)
        if status not in (STARTED, FINISHED):
            return {"reason": "unknown status"} if is_phase else None
        if self.last is not None and place < self.last:
            return {"reason": "late"}
        self.last = place
        marks = self.phases and is_phase
        if marks and status == STARTED:
            self.phase, self.phase_at = key[-1][len(names.PHASE_PREFIX):], at
        phase, phase_at, number = self.phase, self.phase_at, self.number
        if marks and status == FINISHED:
            self.phase, self.phase_at, self.number = None, at, number + 1
        before = self.open.pop(key, None)
        if status == STARTED:
            self.open[key] = [at, phase, number]
            return {"reason": "already started"} if before else None
        if before is None:
            return {"reason": "finish without start"}
        started, start_phase, start_number = before
        elapsed = at - started
        slipped = bool(
            start_phase != phase and number == start_number + 1 and phase_at is not None
            and elapsed and (at - phase_at) / elapsed < self.slip
        )
        return {
            "started": started, "elapsed": elapsed, "start_phase": start_phase,
            "end_phase": start_phase if slipped else phase, "slipped": slipped,
        }


class _Pairing(StatefulProcessor):
    def __init__(self, order: list[str], columns: list[str], phases: bool, slip: float):
        self.order, self.columns, self.phases, self.slip = order, columns, phases, slip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        session = SessionState(stored[0] if stored else None, self.phases, self.slip)
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        found = []
        for event in events.to_dict("records"):
            at = event["timestamp"]
            result = session.take(
                tuple(event[c] for c in SPAN_KEY), event["status"], at, [event[c] for c in self.order])
            if result is not None:
                found.append({**dict.fromkeys(self.columns), **event, "finished": at, **result})
        self.state.update((session.text(),))
        if found:
            yield pd.DataFrame(found, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def paired_schema(events: T.StructType, session: list[str], order: list[str]) -> T.StructType:
    time = events["timestamp"].dataType
    kept = dict.fromkeys([*session, *SPAN_KEY, *order, "timestamp", "status"])
    return T.StructType([
        *(events[c] for c in kept),
        T.StructField("started", time), T.StructField("finished", time), T.StructField("elapsed", time),
        T.StructField("start_phase", T.StringType()), T.StructField("end_phase", T.StringType()),
        T.StructField("slipped", T.BooleanType()), T.StructField("reason", T.StringType()),
    ])


def stream_spans(
    events: DataFrame, session: list[str] | None = None, order: list[str] | None = None,
    slip: float = SLIP_SHARE, phases: bool = True,
) -> DataFrame:
    """Spans (``reason`` is null) and errors of a stream of events, each given once.

    Times and order columns must be numbers or text. The state store must be the one named
    ``STATE_STORE``.
    """
    session, order = session or ["session"], order or ["timestamp", "seq"]
    schema = paired_schema(events.schema, session, order)
    keys = session if phases else list(dict.fromkeys([*session, *SPAN_KEY]))
    kept = dict.fromkeys([*session, *SPAN_KEY, *order, "timestamp", "status"])
    return events.select(*kept).groupBy(*keys).transformWithStateInPandas(
        _Pairing(order, schema.fieldNames(), phases, slip), outputStructType=schema, outputMode="append", timeMode="None")


def pair_batch(
    events: DataFrame, state: DataFrame | None, session: list[str], order: list[str], phases: bool = True,
) -> DataFrame:
    """A batch's events and the state before it, in order, each with its phase and the event before it in its key."""
    key = [*session, *SPAN_KEY]
    unit = session if phases else list(dict.fromkeys(key))
    time = events.schema["timestamp"].dataType
    kept = dict.fromkeys([*session, *SPAN_KEY, *order, "timestamp", "status"])
    rows = events.select(
        *kept, F.lit(EVENT).alias("__row"), F.lit(None).cast("string").alias("phase"),
        F.lit(None).cast(time).alias("phase_at"), F.lit(0).cast("bigint").alias("phase_number"))
    if state is not None:
        rows = rows.unionByName(state)
    kind, status, row, place = F.col("event_type"), F.col("status"), F.col("__row"), F.struct(*order)
    known = (row == EVENT) & F.coalesce(status.isin(STARTED, FINISHED), F.lit(False))
    scan = ordered(rows, unit, ["__row", *order])
    scan = scan.running(__last=Running("last", F.when(row == MARK, place)))
    what = F.when((row == EVENT) & ~known, UNKNOWN).when(known & (place < F.col("__last")), LATE).otherwise(TAKEN)
    taken = (row == EVENT) & (F.col("__what") == TAKEN)
    marks = taken & F.coalesce(names.is_phase(kind), F.lit(False)) if phases else F.lit(False)
    change = F.when(row == MARK, F.struct("phase", F.col("phase_at").alias("at"))).when(
        marks, F.struct(F.when(status == STARTED, names.phase_name(kind)).alias("phase"), F.col("timestamp").alias("at")))
    step = F.when(row == MARK, F.col("phase_number")).when(marks & (status == FINISHED), 1).otherwise(0).cast("bigint")
    scan = replace(scan, rows=scan.rows.withColumn("__what", what).withColumns({"__change": change, "__step": step}).drop("__last"))
    scan = scan.running(
        __upto=Running("last", F.col("__change")),
        __before=Running("last", F.col("__change"), through_row=False),
        __number=Running("sum", F.col("__step"), through_row=False),
    )
    seen = F.when(marks & (status == FINISHED), F.col("__before")).otherwise(F.col("__upto"))
    phased = scan.done().withColumns({
        "phase": F.when(row == EVENT, seen["phase"]).otherwise(F.col("phase")),
        "phase_at": F.when(row == EVENT, seen["at"]).otherwise(F.col("phase_at")),
        "phase_number": F.when(row == EVENT, F.col("__number")).otherwise(F.col("phase_number")),
    }).drop("__upto", "__before", "__number")
    # events that are not taken and the session's own row are nobody's event before
    phased = phased.withColumn("__side", F.when(row == MARK, MARK).otherwise(F.col("__what")))
    sized = {"look": rows.withColumn("__side", F.lit(TAKEN))} if scan.segmented else {"fits": True}
    this = F.struct("status", "timestamp", "phase", "phase_number")
    return ordered(phased, [*dict.fromkeys(key), "__side"], ["__row", *order], **sized).running(
        __open=Running("last", this, through_row=False)).done().drop("__side")


def _results(rows: DataFrame, columns: list[str], slip: float) -> DataFrame:
    """The spans and errors among the rows of ``pair_batch``."""
    taken = F.col("__what") == TAKEN
    reason = (
        F.when(taken, pair_error()).when(F.col("__what") == LATE, "late")
        .when(names.is_phase(F.col("event_type")), "unknown status"))
    span = taken & is_span()
    made = {name: F.when(span, column) for name, column in span_columns(slip).items()}
    made = {**made, "finished": F.col("timestamp"), "reason": reason}
    return rows.where((F.col("__row") == EVENT) & (span | reason.isNotNull())).select(
        *[made[c].alias(c) if c in made else F.col(c) for c in columns])


def _state_after(rows: DataFrame, session: list[str], order: list[str], phases: bool) -> DataFrame:
    """Of each session its place, phase and number of phases, and its open starts, as rows for ``pair_batch``."""
    key = list(dict.fromkeys([*session, *SPAN_KEY]))
    unit = session if phases else key
    place = F.struct("__row", *order)
    carried = rows.where((F.col("__row") != EVENT) | (F.col("__what") == TAKEN))
    marks = carried.where(F.col("__row") != OPEN).groupBy(*unit).agg(
        F.max(F.struct(*order)).alias("last"),
        F.max_by("__change", F.when(F.col("__change").isNotNull(), place)).alias("change"),
        F.sum("__step").alias("number"),
    )
    opens = carried.where(F.col("__row") != MARK).groupBy(*key).agg(
        F.max_by(F.struct("status", "timestamp", "phase", "phase_number"), place).alias("last")
    ).where(F.col("last.status") == STARTED)
    kept = dict.fromkeys([*key, *order, "timestamp", "status"])
    types = {c: rows.schema[c].dataType for c in kept}

    def shaped(table: DataFrame, row: int, known: dict) -> DataFrame:
        return table.select(
            *[(known[c] if c in known else F.lit(None)).cast(types[c]).alias(c) for c in kept],
            F.lit(row).alias("__row"), *[known[c].alias(c) for c in ("phase", "phase_at", "phase_number")])

    time = types["timestamp"]
    return shaped(marks, MARK, {
        **{c: F.col(f"`{c}`") for c in unit}, **{c: F.col("last")[c] for c in order if c not in unit},
        "phase": F.col("change.phase"), "phase_at": F.col("change.at").cast(time), "phase_number": F.col("number"),
    }).unionByName(shaped(opens, OPEN, {
        **{c: F.col(f"`{c}`") for c in key}, "status": F.col("last.status"), "timestamp": F.col("last.timestamp"),
        "phase": F.col("last.phase"), "phase_at": F.lit(None).cast(time), "phase_number": F.col("last.phase_number"),
    }))


def follow_spans(
    spark: SparkSession, events: DataFrame, out: str, by: tuple[str, ...] = (), trigger: dict | None = None,
    session: list[str] | None = None, order: list[str] | None = None, slip: float = SLIP_SHARE, phases: bool = True,
) -> StreamingQuery:
    """Keep ``out/paired`` (spans and errors) and the merged moments of a stream of events.

    A batch's rows go under its number, so a batch that is repeated after a failure replaces itself.
    The moments of all spans up to a batch are those up to the one before, merged with its own.
    """
    session, order = session or ["session"], order or ["timestamp", "seq"]
    columns = paired_schema(events.schema, session, order).fieldNames()
    state = Versions(spark, f"{out}/state").begin()

    def keep(batch: DataFrame, number: int) -> None:
        before = state.latest(number)
        # the source is read once; the planner adapts to what it measures in the given session, not in the stream's own
        taken = settled(batch, "batch", spark)
        carried = None if before is None else state.read("sessions", before)
        rows = settled(pair_batch(taken, carried, session, order, phases), "paired")
        results = f"{out}/paired/batch={number}"
        found = _results(rows, columns, slip)
        found.write.mode("overwrite").parquet(results)
        state.write("sessions", number, _state_after(rows, session, order, phases))
        forget(rows, taken)
        merged = partial_moments(spark.read.schema(found.schema).parquet(results).where("reason is null"), by)
        if before is not None:
            merged = merge_moments(state.read("moments", before).unionByName(merged), by)
        state.write("moments", number, merged)
        state.list(number, "moments", "sessions")

    return (
        events.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{out}/_progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def paired(spark: SparkSession, out: str) -> DataFrame:
    """All spans and errors that ``follow_spans`` has kept."""
    return spark.read.parquet(f"{out}/paired").drop("batch")


def latest_moments(spark: SparkSession, out: str) -> DataFrame:
    """The merged moments of all spans so far; only the last batch's table is read."""
    state = Versions(spark, f"{out}/state")
    return state.read("moments", state.latest())
