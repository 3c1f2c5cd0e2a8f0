"""Streams over the given tables: each is fed in parts, is stopped after each, and goes on."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwell.operators import rollup
from spanwell.operators.moments import finished, merge_moments, partial_moments
from spanwell.operators.spans import build_spans
from spanwell.plans.inputs import LOG_FILES_SQL, LOOSE_EVENTS_SQL, PHASES_SQL, log_lines, loose_events, span_events
from spanwell.plans.registry import query
from spanwell.plans.span_queries import STATS_SQL, _seconds
from spanwell.session import settled, shared_folder
from spanwell.sources import logs
from spanwell.streaming import follow, pairing
from spanwell.streaming.versions import Versions

PARTS = 3


def _followed(spark, events, **options):
    """The folder of a stream that has taken the events in ``PARTS`` stretches of time, one run for each."""
    folder, out = shared_folder(spark, "stream-events"), shared_folder(spark, "stream-spans")
    first, last = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = max(1, -(-((last or 0) - (first or 0) + 1) // PARTS))
    for part in range(PARTS):
        low, high = (first or 0) + part * span, (first or 0) + (part + 1) * span
        events.where((F.col("timestamp") >= low) & (F.col("timestamp") < high)).write.mode("append").parquet(folder)
        source = spark.readStream.schema(events.schema).parquet(folder)
        pairing.follow_spans(spark, source, out, **options).awaitTermination()
    return out


@query("streamed_spans", f"""WITH {PHASES_SQL}
SELECT session, task_id, event_type, started, finished, elapsed, start_phase, end_phase, slipped FROM spans""")
def streamed_spans(spark, sf):
    out = _followed(spark, span_events(spark, sf))
    return pairing.paired(spark, out).where("reason is null").select(
        "session", "task_id", "event_type", "started", "finished", "elapsed", "start_phase", "end_phase", "slipped")


@query("streamed_span_stats", f"""WITH {PHASES_SQL}
SELECT start_phase, end_phase, event_type, {STATS_SQL} FROM spans GROUP BY ALL""")
def streamed_span_stats(spark, sf):
    return _seconds(finished(pairing.latest_moments(spark, _followed(spark, span_events(spark, sf)))))


@query("streamed_errors", f"""WITH {LOOSE_EVENTS_SQL}
SELECT session, event_type, seq, status, reason FROM (
  SELECT session, event_type, seq, status,
         CASE WHEN status = 1 AND before = 1 THEN 'already started'
              WHEN status = 2 AND before IS DISTINCT FROM 1 THEN 'finish without start' END AS reason
  FROM known
  UNION ALL
  SELECT session, event_type, seq, status, 'unknown status' FROM loose
  WHERE status NOT IN (1, 2) AND event_type LIKE 'benchmark:%')
WHERE reason IS NOT NULL""")
def streamed_errors(spark, sf):
    out = _followed(spark, loose_events(spark, sf))
    return pairing.paired(spark, out).where("reason is not null").select("session", "event_type", "seq", "status", "reason")


@query("merged_span_stats", f"""WITH {PHASES_SQL}
SELECT start_phase, end_phase, event_type, {STATS_SQL} FROM spans GROUP BY ALL""")
def merged_span_stats(spark, sf):
    """Moments by day and session, merged over sessions and then over days."""
    spans = build_spans(span_events(spark, sf)).spans
    by_day = spans.withColumn("day", F.floor(F.col("finished") / 86_400_000_000))
    parts = partial_moments(by_day, ["day", "session"])
    return _seconds(finished(merge_moments(merge_moments(parts, ["day"]))))


def _log_state(spark, sf):
    """The state after three batches of log files."""
    found = logs.stored(logs.Logs(log_lines(spark, sf)))
    rolled = rollup.rollup(found)
    whole = {"headers": rollup.headers(found), "rollups": rolled.rollups, "stats": rollup.log_span_stats(found)}
    tables = {name: settled(table, name) for name, table in whole.items()}
    out = shared_folder(spark, "log-state")
    state = Versions(spark, f"{out}/state").begin()
    for part in range(PARTS):
        chosen = F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(PARTS)) == part
        follow.keep_state(state, part, {name: table.where(chosen) for name, table in tables.items()})
    return out


@query("kept_revisions", f"""WITH {LOG_FILES_SQL}
SELECT file, workload, fail_ct, max_success_iteration FROM rolled WHERE file IN (
  SELECT file FROM files WHERE headers > 0
  QUALIFY row_number() OVER (
    PARTITION BY workload, num_workers, num_nodes, framework_rev, benchmark_rev ORDER BY string_split(file, '/')) = 1)""")
def kept_revisions(spark, sf):
    rollups, _ = follow.kept_tables(spark, _log_state(spark, sf))
    return rollups.select("file", "workload", "fail_ct", "max_success_iteration")


@query("followed_span_stats", f"""WITH {LOG_FILES_SQL}
SELECT phase AS start_phase, phase AS end_phase, event_type, count(*) AS ct, round(sum(elapsed), 3) AS total_elapsed_time,
       min(elapsed) AS min_elapsed_time, max(elapsed) AS max_elapsed_time, round(avg(elapsed), 6) AS avg_elapsed_time,
       round(stddev_pop(elapsed), 6) AS stddev_elapsed_time
FROM run_spans JOIN files USING (file) WHERE headers = 1 GROUP BY ALL""")
def followed_span_stats(spark, sf):
    found = follow.span_stats_so_far(spark, _log_state(spark, sf))
    return found.withColumns({
        "total_elapsed_time": F.round("total_elapsed_time", 3), "avg_elapsed_time": F.round("avg_elapsed_time", 6),
        "stddev_elapsed_time": F.round("stddev_elapsed_time", 6)})
