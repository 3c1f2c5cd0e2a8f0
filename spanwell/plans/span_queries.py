"""Spans, phases and duration statistics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwell.functions.scalars import rate
from spanwell.operators import metrics, spans
from spanwell.plans.inputs import (
    LOOSE_EVENTS_SQL, PHASES_SQL, SPAN_EVENTS_SQL, loose_events, micros, span_events, table,
)
from spanwell.plans.registry import query

STATS_SQL = """count(*) AS ct, round(CAST(sum(elapsed) AS DOUBLE) / 1e6, 3) AS total_elapsed_time,
  min(elapsed) AS min_elapsed_time, max(elapsed) AS max_elapsed_time,
  round(avg(elapsed) / 1e6, 4) AS avg_elapsed_time,
  round(stddev_pop(elapsed / 1e6), 4) AS stddev_elapsed_time"""


def _seconds(stats):
    """Totals and averages in rounded seconds, for a comparison that floats survive."""
    return stats.withColumns({
        "total_elapsed_time": F.round(F.col("total_elapsed_time").cast("double") / 1e6, 3),
        "avg_elapsed_time": F.round(F.col("avg_elapsed_time") / 1e6, 4),
        "stddev_elapsed_time": F.round(F.col("stddev_elapsed_time") / 1e6, 4),
    })


def _phase_spans(spark, sf):
    return spans.build_spans(span_events(spark, sf)).spans


@query("event_count", f"WITH {SPAN_EVENTS_SQL} SELECT count(*) AS events FROM ev")
def event_count(spark, sf):
    return spans.count_events(span_events(spark, sf))


@query("phase_state", f"""WITH {PHASES_SQL}
SELECT session, seq, event_type, status, "timestamp", phase, phase_at, phase_number FROM phased""")
def phase_state(spark, sf):
    return spans.with_phase(span_events(spark, sf), ["session"], ["timestamp", "seq"]).select(
        "session", "seq", "event_type", "status", "timestamp", "phase", "phase_at", "phase_number")


@query("span_pairs", f"""WITH {SPAN_EVENTS_SQL}
SELECT f.session, f.task_id, f.event_type, s."timestamp" AS started, f."timestamp" AS finished,
       f."timestamp" - s."timestamp" AS elapsed
FROM ev f JOIN ev s ON s.task_id = f.task_id AND s.status = 1 AND f.status = 2""")
def span_pairs(spark, sf):
    built = spans.build_spans(span_events(spark, sf), phases=False)
    return built.spans.select("session", "task_id", "event_type", "started", "finished", "elapsed")


@query("phase_spans", f"""WITH {PHASES_SQL}
SELECT session, task_id, event_type, started, finished, elapsed, start_phase, end_phase, slipped
FROM spans""")
def phase_spans(spark, sf):
    return _phase_spans(spark, sf).select(
        "session", "task_id", "event_type", "started", "finished", "elapsed",
        "start_phase", "end_phase", "slipped")


@query("span_stats", f"""WITH {SPAN_EVENTS_SQL},
spans AS (
  SELECT f.event_type, f."timestamp" - s."timestamp" AS elapsed
  FROM ev f JOIN ev s ON s.task_id = f.task_id AND s.status = 1 AND f.status = 2)
SELECT event_type, {STATS_SQL} FROM spans GROUP BY event_type""")
def span_stats(spark, sf):
    built = spans.build_spans(span_events(spark, sf), phases=False)
    return _seconds(spans.span_stats(built.spans)).drop("start_phase", "end_phase")


@query("phase_span_stats", f"""WITH {PHASES_SQL}
SELECT start_phase, end_phase, event_type, {STATS_SQL} FROM spans GROUP BY ALL""")
def phase_span_stats(spark, sf):
    return _seconds(spans.span_stats(_phase_spans(spark, sf)))


@query("session_span_stats", f"""WITH {PHASES_SQL}
SELECT session, start_phase, end_phase, event_type, {STATS_SQL} FROM spans GROUP BY ALL""")
def session_span_stats(spark, sf):
    return _seconds(spans.span_stats(_phase_spans(spark, sf), ["session"]))


@query("span_report", f"""WITH {PHASES_SQL},
stats AS (
  SELECT coalesce(start_phase, 'None') || ':' || coalesce(end_phase, 'None') || ':' || event_type AS key,
         count(*) AS ct, CAST(sum(elapsed) AS DOUBLE) / 1e6 AS total, min(elapsed) / 1e6 AS low,
         avg(elapsed) / 1e6 AS mean, max(elapsed) / 1e6 AS high, stddev_pop(elapsed / 1e6) AS deviation
  FROM spans GROUP BY ALL)
SELECT key, total, ct, low, round(mean, 4) AS mean, high, round(deviation, 4) AS deviation FROM stats""")
def span_report(spark, sf):
    """All six figures of each line of the report; averages are rounded as a comparison needs it."""
    stats = spans.span_stats(_phase_spans(spark, sf))
    seconds = stats.withColumns({
        c: F.col(c).cast("double") / 1e6 for c in stats.columns if c.endswith("_elapsed_time")})
    figure = r"([0-9]+\.[0-9]{6})"
    line = rf"^{figure},([0-9]+),\[{figure},{figure},{figure}\],{figure}$"

    def part(i, kind="double"):
        return F.regexp_extract("line", line, i).cast(kind)

    return spans.span_report(seconds).select(
        "key", part(1).alias("total"), part(2, "bigint").alias("ct"), part(3).alias("low"),
        F.round(part(4), 4).alias("mean"), part(5).alias("high"), F.round(part(6), 4).alias("deviation"))


@query("headline", f"""WITH {PHASES_SQL}
SELECT session, round(avg(elapsed) / 1e6, 4) AS avg_elapsed_time FROM spans
WHERE start_phase = 'measure' AND end_phase = 'measure' AND event_type = 'benchmark:measure'
GROUP BY session""")
def headline(spark, sf):
    stats = spans.span_stats(_phase_spans(spark, sf), ["session"])
    return spans.headline(stats, ["session"]).withColumn(
        "avg_elapsed_time", F.round(F.col("avg_elapsed_time") / 1e6, 4))


@query("stats_document", f"""WITH {PHASES_SQL}
SELECT session,
       coalesce(start_phase, 'None') || ':' || coalesce(end_phase, 'None') || ':' || event_type AS key,
       {STATS_SQL}
FROM spans GROUP BY ALL""")
def stats_document(spark, sf):
    stats = spans.span_stats(_phase_spans(spark, sf), ["session"])
    documents = spans.stats_document(
        stats, ["session"], F.create_map(F.lit("user"), F.col("session")))
    schema = ("config map<string,string>, timing map<string,struct<ct bigint, total_elapsed_time decimal(38,0), "
              "min_elapsed_time bigint, max_elapsed_time bigint, avg_elapsed_time double, stddev_elapsed_time double>>")
    back = documents.select(F.from_json("document", schema).alias("d"))
    return _seconds(back.select(
        F.col("d.config")["user"].alias("session"), F.explode("d.timing").alias("key", "t")
    ).select("session", "key", "t.*"))


@query("span_errors", f"""WITH {LOOSE_EVENTS_SQL}
SELECT session, event_type, seq, status, reason FROM (
  SELECT session, event_type, seq, status,
         CASE WHEN status = 1 AND before = 1 THEN 'already started'
              WHEN status = 2 AND before IS DISTINCT FROM 1 THEN 'finish without start' END AS reason
  FROM known
  UNION ALL
  SELECT session, event_type, seq, status, 'unknown status' FROM loose
  WHERE status NOT IN (1, 2) AND event_type LIKE 'benchmark:%')
WHERE reason IS NOT NULL""")
def span_errors(spark, sf):
    return spans.build_spans(loose_events(spark, sf), phases=False).errors.select(
        "session", "event_type", "seq", "status", "reason")


@query("open_spans", f"""WITH {LOOSE_EVENTS_SQL}
SELECT session, event_type, "timestamp" AS started FROM known WHERE status = 1 AND after IS NULL""")
def open_spans(spark, sf):
    return spans.build_spans(loose_events(spark, sf), phases=False).open.select(
        "session", "event_type", "started")


@query("loose_span_stats", f"""WITH {LOOSE_EVENTS_SQL},
spans AS (
  SELECT event_type, "timestamp" - lag("timestamp") OVER (
           PARTITION BY session, worker_id, task_id, event_type ORDER BY "timestamp", seq) AS elapsed,
         status, before
  FROM known)
SELECT event_type, {STATS_SQL} FROM spans WHERE status = 2 AND before = 1 GROUP BY event_type""")
def loose_span_stats(spark, sf):
    built = spans.build_spans(loose_events(spark, sf), phases=False)
    return _seconds(spans.span_stats(built.spans)).drop("start_phase", "end_phase")


@query("slow_down", """
WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, value FROM events)
SELECT event_id, user_id, event_type,
       round(value / nullif(first_value(value) OVER (
         PARTITION BY user_id, event_type ORDER BY us, event_id), 0), 6) AS ratio
FROM e""")
def slow_down(spark, sf):
    e = table(spark, sf, "events").withColumn("at", micros(F.col("ts")))
    ratios = metrics.relative_to_first(
        e.select("event_id", "user_id", "event_type", "at", "value"),
        ["user_id", "event_type"], ["at", "event_id"], "value")
    return ratios.select("event_id", "user_id", "event_type", F.round("ratio", 6).alias("ratio"))


@query("event_rate", """
SELECT event_type, count(*) AS ct,
       round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS per_second
FROM events GROUP BY event_type""")
def event_rate(spark, sf):
    at = micros(F.col("ts"))
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("ct"), (F.max(at) - F.min(at)).alias("us"),
    ).select("event_type", "ct", F.round(rate(F.col("ct"), F.col("us") / 1e6), 6).alias("per_second"))
