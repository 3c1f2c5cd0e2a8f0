"""Experiment logs, rollups, reports and histories over customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwell.functions import names
from spanwell.functions.scalars import failure_limit, wait_limit
from spanwell.operators import history, metrics, rollup
from spanwell.plans.inputs import (
    LOG_FILES_SQL, SWEEPS_SQL, log_file, log_lines, metric_documents, micros, sweep_documents, table,
)
from spanwell.plans.registry import query
from spanwell.session import settled
from spanwell.sources import configs, logs


def _logs(spark, sf):
    return logs.Logs(log_lines(spark, sf))


def _parts(spark, sf):
    """Accepted rollups and span statistics of all files."""
    found = rollup.analyse(_logs(spark, sf))
    return found.rollups, found.stats


@query("log_record_types", f"""WITH {LOG_FILES_SQL}
SELECT 'experiment' AS type, CAST(sum(headers) AS BIGINT) AS records FROM files
UNION ALL SELECT 'finish_work', count(*) FROM runs
UNION ALL SELECT 'killed', count(*) FROM runs WHERE status = 'F'
UNION ALL SELECT 'waiting', count(*) FROM runs WHERE status = 'P'""")
def log_record_types(spark, sf):
    return _logs(spark, sf).records().groupBy("type").agg(F.count(F.lit(1)).alias("records"))


@query("analysed_records", f"""WITH {LOG_FILES_SQL}
SELECT file, count(*) AS records FROM (
  SELECT file FROM files, range(headers) UNION ALL SELECT file FROM runs) GROUP BY file""")
def analysed_records(spark, sf):
    return _logs(spark, sf).records(*logs.ANALYSED, events=False).groupBy("file").agg(
        F.count(F.lit(1)).alias("records"))


@query("rejected_lines", f"""WITH {LOG_FILES_SQL}
SELECT file, iteration * 2 AS line, '{{broken' AS value FROM runs
WHERE status = 'O' AND priority = '5-LOW'""")
def rejected_lines(spark, sf):
    return _logs(spark, sf).rejected().select("file", "line", "value")


@query("log_span_events", f"""WITH {LOG_FILES_SQL}
SELECT file, count(*) * 4 AS events, CAST(sum(2) * count(*) // count(*) AS BIGINT) AS starts,
       count(*) FILTER (priority = '2-HIGH') * 2 AS phase_events
FROM runs WHERE success AND priority <> '1-URGENT' GROUP BY file""")
def log_span_events(spark, sf):
    events = logs.run_events(_logs(spark, sf))
    return events.groupBy("file").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("status") == 1).alias("starts"),
        F.count_if(names.is_phase(F.col("event_type"))).alias("phase_events"),
    )


@query("log_rollup", f"""WITH {LOG_FILES_SQL}
SELECT file, epoch, workload, num_workers, num_nodes, framework_rev, benchmark_rev, fail_ct,
       max_success_iteration, batch_size, label FROM rolled""")
def log_rollup(spark, sf):
    config = F.col("max_success_workload_config")
    return rollup.rollup(_logs(spark, sf)).rollups.select(
        "file", F.col("timestamp").alias("epoch"), *rollup.IDENTITY, *rollup.REVISIONS,
        "fail_ct", "max_success_iteration",
        config["batch_size"].try_cast("bigint").alias("batch_size"), config["label"].alias("label"))


@query("rejected_files", f"""WITH {LOG_FILES_SQL}
SELECT file, CASE WHEN headers > 0 THEN 'duplicate experiment record'
                  WHEN file IN (SELECT file FROM runs) THEN 'no experiment record'
                  ELSE 'empty file' END AS reason
FROM files WHERE headers <> 1""")
def rejected_files(spark, sf):
    files = table(spark, sf, "customer").select(log_file(F.col("c_custkey")).alias("file"), F.lit(None).cast("bigint").alias("length"))
    return rollup.rollup(logs.Logs(log_lines(spark, sf), files)).rejected


@query("rejected_records", f"""WITH {LOG_FILES_SQL}
SELECT file, iteration * 2 AS line, 'no record' AS reason FROM runs WHERE status = 'O' AND priority = '5-LOW'
UNION ALL
SELECT file, iteration * 2 + 1, CASE iteration % 7 WHEN 0 THEN 'data is no object' WHEN 1 THEN 'iteration is no number'
    WHEN 2 THEN 'success is neither true nor false' ELSE 'event time is no number' END
FROM runs WHERE iteration % 7 < 3 OR (iteration % 7 = 3 AND priority <> '1-URGENT')""")
def rejected_records(spark, sf):
    """Of every seven runs three or four have a malformed value."""
    kind = F.pmod(F.floor(F.col("line") / 2), F.lit(7))
    spoilt = (
        F.when(kind == 0, F.regexp_replace("value", r'"data":\{.*', '"data":7}'))
        .when(kind == 1, F.regexp_replace("value", r'"iteration":\d+', '"iteration":"many"'))
        .when(kind == 2, F.regexp_replace("value", r'"success":\w+', '"success":"maybe"'))
        .when(kind == 3, F.regexp_replace("value", r'"events":\[\{"timestamp":[^,]*', '"events":[{"timestamp":"noon"'))
    )
    is_run = F.contains("value", F.lit('"type":"finish_work"'))
    lines = log_lines(spark, sf).withColumn("value", F.when(is_run, F.coalesce(spoilt, "value")).otherwise(F.col("value")))
    return logs.Logs(lines).rejected().select("file", "line", "reason")


@query("log_span_stats", f"""WITH {LOG_FILES_SQL}
SELECT * REPLACE (round(stddev_elapsed_time, 6) AS stddev_elapsed_time,
                  round(avg_elapsed_time, 6) AS avg_elapsed_time) FROM run_stats""")
def log_span_stats(spark, sf):
    return rollup.log_span_stats(_logs(spark, sf)).withColumns({
        "stddev_elapsed_time": F.round("stddev_elapsed_time", 6),
        "avg_elapsed_time": F.round("avg_elapsed_time", 6),
    })


@query("experiment_groups", f"""WITH {LOG_FILES_SQL}
SELECT workload, num_workers, num_nodes, count(*) AS experiments,
       CAST(sum(fail_ct) AS BIGINT) AS failures FROM rolled GROUP BY ALL""")
def experiment_groups(spark, sf):
    return rollup.experiment_groups(rollup.rollup(_logs(spark, sf)).rollups)


SHORT = "substr(framework_rev, 1, 7) AS framework_rev, substr(benchmark_rev, 1, 7) AS benchmark_rev"


def _summary_sql(measurement: str) -> str:
    return f"""WITH {LOG_FILES_SQL},
long AS (
  SELECT file, start_phase, end_phase, {measurement} AS measurement, s.stat,
         CASE s.stat WHEN 'min' THEN min_elapsed_time WHEN 'max' THEN max_elapsed_time
                     WHEN 'avg' THEN avg_elapsed_time ELSE CAST(ct AS DOUBLE) END AS value
  FROM run_stats, (VALUES ('min'), ('max'), ('avg'), ('ct')) s(stat)
  UNION ALL
  SELECT file, NULL, NULL, 'success_iteration', 'max', max_success_iteration FROM rolled
  UNION ALL
  SELECT file, NULL, NULL, 'failures', 'ct', fail_ct FROM rolled)
SELECT r.file, {SHORT}, workload, num_workers, num_nodes, start_phase, end_phase, measurement, stat,
       round(value, 6) AS value
FROM rolled r JOIN long l ON l.file = r.file"""


@query("summary_table", _summary_sql("event_type"))
def summary_table(spark, sf):
    rollups, stats = _parts(spark, sf)
    return rollup.summary_table(rollups, stats).withColumn("value", F.round("value", 6))


@query("summary_cut_names", _summary_sql(
    "substr(coalesce(start_phase, 'None') || ':' || coalesce(end_phase, 'None') || ':' || event_type, 11)"))
def summary_cut_names(spark, sf):
    rollups, stats = _parts(spark, sf)
    return rollup.summary_table(rollups, stats, cut_ten=True).withColumn("value", F.round("value", 6))


@query("unique_log_revisions", f"""WITH {LOG_FILES_SQL}
SELECT file, headers FROM (
  SELECT *, row_number() OVER (
    PARTITION BY workload, num_workers, num_nodes, framework_rev, benchmark_rev
    ORDER BY string_split(file, '/')) AS place
  FROM files WHERE headers > 0) WHERE place = 1""")
def unique_log_revisions(spark, sf):
    kept = rollup.unique_revisions(_logs(spark, sf))
    return (
        kept.records("experiment").groupBy("file")
        .agg(F.count(F.lit(1)).cast("int").alias("headers"))
    )


@query("unique_revisions", """
SELECT l_returnflag, l_linestatus, l_linenumber, rev, l_orderkey, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_returnflag, l_linestatus, l_linenumber, rev
    ORDER BY l_orderkey, l_partkey, l_suppkey) AS place
  FROM (SELECT *, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 5 END AS rev FROM lineitem))
WHERE place = 1""")
def unique_revisions(spark, sf):
    rev = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 5)
    items = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", rev.alias("rev"),
        "l_orderkey", "l_partkey", "l_suppkey")
    return rollup.first_per_revision(
        items, ["l_orderkey", "l_partkey", "l_suppkey"],
        ["l_returnflag", "l_linestatus", "l_linenumber", "rev"])


VALUES_SQL = LOG_FILES_SQL + """,
named AS MATERIALIZED (
  SELECT file, CASE WHEN start_phase IS NULL AND end_phase IS NULL THEN event_type
                    ELSE coalesce(start_phase, 'None') || ':' || coalesce(end_phase, 'None')
                         || ':' || event_type END || '_' || s.stat AS name,
         'measure' AS kind,
         CASE s.stat WHEN 'min_elapsed_time' THEN min_elapsed_time
                     WHEN 'max_elapsed_time' THEN max_elapsed_time
                     WHEN 'avg_elapsed_time' THEN avg_elapsed_time ELSE CAST(ct AS DOUBLE) END AS value,
         NULL AS label
  FROM run_stats, (VALUES ('min_elapsed_time'), ('max_elapsed_time'), ('avg_elapsed_time'), ('ct')) s(stat)
  WHERE file IN (SELECT file FROM rolled)
  UNION ALL SELECT file, 'max_successful_iteration', 'count', max_success_iteration, NULL FROM rolled
  UNION ALL SELECT file, 'success_iteration_max', 'trend', max_success_iteration, NULL FROM rolled
  UNION ALL SELECT file, 'failures_ct', 'trend', fail_ct, NULL FROM rolled
  UNION ALL SELECT file, 'batch_size', 'config', batch_size, NULL FROM rolled WHERE batch_size IS NOT NULL
  UNION ALL SELECT file, 'label', 'config', NULL, label FROM rolled WHERE label IS NOT NULL
)"""


def _values(rollups, stats):
    return settled(metrics.stat_values(rollups, stats), "values")


@query("stat_values", f"""WITH {VALUES_SQL}
SELECT file, kind, name, round(value, 6) AS value,
       CASE WHEN kind = 'config' THEN coalesce(label, CAST(CAST(value AS BIGINT) AS VARCHAR)) END AS given FROM named""")
def stat_values(spark, sf):
    return _values(*_parts(spark, sf)).select(
        "file", "kind", "name", F.round("value", 6).alias("value"), F.when(F.col("kind") == "config", F.col("text")).alias("given"))


@query("stat_columns", f"""WITH {VALUES_SQL}
SELECT file, round(max(value) FILTER (name = 'load_avg_elapsed_time'), 6) AS load_avg_elapsed_time,
       max(value) FILTER (name = 'failures_ct') AS failures_ct,
       max(value) FILTER (name = 'batch_size') AS batch_size
FROM named WHERE name IN ('load_avg_elapsed_time', 'failures_ct', 'batch_size') GROUP BY file""")
def stat_columns(spark, sf):
    wide = metrics.pivot_values(
        _values(*_parts(spark, sf)), ["load_avg_elapsed_time", "failures_ct", "batch_size"])
    return wide.withColumn("load_avg_elapsed_time", F.round("load_avg_elapsed_time", 6))


@query("key_metrics", f"""WITH {VALUES_SQL},
v AS (SELECT file, max(value) FILTER (name = 'load_ct') AS load_ct,
             max(label) FILTER (name = 'label') AS label,
             max(value) FILTER (name = 'load_min_elapsed_time') AS load_min,
             max(value) FILTER (name = 'load_max_elapsed_time') AS load_max,
             max(value) FILTER (name = 'total_max_elapsed_time') AS total_max
      FROM named GROUP BY file),
m(workload, description, metric) AS (VALUES
  ('building', 'Buildings', 'loads'), ('building', 'Buildings', 'evenness'),
  ('automobile', 'Cars', 'best iteration'), ('automobile', 'Cars', 'failures per total'),
  ('machinery', 'Machines', 'label'), ('machinery', 'Machines', 'missing'))
SELECT r.file, r.workload, num_workers, num_nodes, "timestamp", {SHORT}, m.description, m.metric,
       CASE WHEN m.metric = 'label' THEN v.label END AS label,
       round(CASE m.metric WHEN 'loads' THEN v.load_ct
                     WHEN 'evenness' THEN v.load_min / v.load_max
                     WHEN 'best iteration' THEN r.max_success_iteration
                     WHEN 'failures per total' THEN r.fail_ct / v.total_max END, 5) AS value
FROM rolled r LEFT JOIN m ON m.workload = r.workload LEFT JOIN v ON v.file = r.file""")
def key_metrics(spark, sf):
    rollups, stats = _parts(spark, sf)
    config = configs.parse_metrics(metric_documents(spark))
    found = metrics.key_metrics(rollups, _values(rollups, stats), config)
    return found.select(
        "file", *rollup.IDENTITY, "timestamp", *rollup.REVISIONS, "description", "metric",
        F.when(F.col("metric") == "label", F.col("text")).alias("label"),
        F.round("value", 5).alias("value"))


SHOWN_SQL = f"""{VALUES_SQL},
cols(workload, name, label) AS (VALUES
  ('building', 'load_ct', 'loads'), ('building', 'load_max_elapsed_time', 'slowest load'),
  ('building', 'success_iteration_max', 'last good'), ('machinery', 'measure:measure:total_ct', 'measured'),
  ('machinery', 'success_iteration_max', 'best')),
about(workload, description) AS (VALUES ('building', 'Buildings'), ('machinery', 'Machines'),
  ('automobile', 'Cars'), ('household', 'Homes')),
shown AS MATERIALIZED (
  SELECT r.file, r.workload, num_workers, num_nodes, "timestamp", {SHORT},
         coalesce(a.description, 'Unknown description') AS description, n.kind,
         CASE WHEN r.workload IN ('building', 'machinery') THEN c.label ELSE n.name END AS label,
         round(n.value, 6) AS value
  FROM rolled r JOIN named n ON n.file = r.file
  LEFT JOIN about a ON a.workload = r.workload
  LEFT JOIN cols c ON c.workload = r.workload AND c.name = n.name
  WHERE n.kind IN ('measure', 'trend')),
long_trend AS (
SELECT * EXCLUDE (kind) FROM shown
WHERE label IS NOT NULL
  AND file IN (SELECT file FROM shown WHERE kind = 'measure' AND label IS NOT NULL))"""


@query("trend", f"WITH {SHOWN_SQL} SELECT * FROM long_trend")
def trend(spark, sf):
    rollups, stats = _parts(spark, sf)
    config = configs.parse_metrics(metric_documents(spark))
    return metrics.trend(rollups, _values(rollups, stats), config).withColumn(
        "value", F.round("value", 6))


TREND_LABELS = ["loads", "slowest load", "last good", "measured", "best", "load_ct", "load_avg_elapsed_time"]


@query("trend_table", f"""WITH {SHOWN_SQL}
SELECT * EXCLUDE (file) FROM (
SELECT file, "timestamp", framework_rev, benchmark_rev, workload, num_workers, num_nodes,
       {', '.join(f"max(value) FILTER (label = '{label}') AS {chr(34)}{label}{chr(34)}" for label in TREND_LABELS)}
FROM long_trend GROUP BY ALL)""")
def trend_table(spark, sf):
    rollups, stats = _parts(spark, sf)
    config = configs.parse_metrics(metric_documents(spark))
    long = metrics.trend(rollups, _values(rollups, stats), config).withColumn("value", F.round("value", 6))
    return metrics.metric_table(long, "label", TREND_LABELS)


@query("wait_summary", f"""WITH {LOG_FILES_SQL}
SELECT file, count(*) FILTER (status = 'F') AS killed, count(*) FILTER (status = 'P') AS waiting,
       max(CASE WHEN status = 'F' THEN 10 * size ELSE size END) AS longest_wait
FROM runs WHERE status IN ('F', 'P') GROUP BY file""")
def wait_summary(spark, sf):
    return history.wait_summary(_logs(spark, sf))


@query("metric_config", """
WITH w AS (
  SELECT p_partkey, p_brand AS workload, 0 AS pos, p_name AS description FROM part
  UNION ALL SELECT p_partkey, p_type, 1, 'type' FROM part
  UNION ALL SELECT p_partkey, p_brand, 2, 'size ' || p_size FROM part)
SELECT p_partkey, workload, description, CAST(CASE WHEN pos = 2 THEN 1 END AS INTEGER) AS metrics,
       CASE WHEN pos = 1 THEN 'shown' END AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, workload ORDER BY pos DESC) AS place FROM w)
WHERE place = 1""")
def metric_config(spark, sf):
    text = F.format_string(
        '{"workloads":[{"name":"%1$s","description":"%2$s"},'
        '{"name":"%3$s","description":"type","cols":{"x_ct":"shown"}},'
        '{"name":"%1$s","description":"size %4$d","key_metrics":[{"name":"m","expression":'
        '{"expression_type":"value","value":"x_ct"}}]}]}',
        F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_size"))
    documents = table(spark, sf, "part").select("p_partkey", text.alias("value"))
    return configs.parse_metrics(documents).select(
        "p_partkey", "workload", "description",
        F.when(F.col("key_metrics").isNotNull(), F.size("key_metrics")).alias("metrics"),
        F.col("cols")["x_ct"].alias("shown"))


@query("sweep_systems", f"WITH {SWEEPS_SQL} SELECT * FROM sweep_systems")
def sweep_systems(spark, sf):
    return configs.systems(configs.parse_sweeps(sweep_documents(spark, sf)))


@query("sweep_grid", f"""WITH {SWEEPS_SQL}
SELECT s.p_partkey, s.system_pos, w.workload_pos, s.num_workers, s.num_nodes, s.shm_size, w.name
FROM sweep_systems s JOIN sweep_workloads w ON w.p_partkey = s.p_partkey""")
def sweep_grid(spark, sf):
    grid = history.sweep_grid(configs.parse_sweeps(sweep_documents(spark, sf)))
    return grid.select("p_partkey", "system_pos", "workload_pos", "num_workers", "num_nodes",
                       "shm_size", F.col("workload")["name"].alias("name"))


@query("run_limits", f"""WITH {SWEEPS_SQL}
SELECT p_partkey, workload_pos, name,
       CASE WHEN nullif(time_target, 0) IS NULL THEN nullif(execution_time_limit, 0)
            WHEN nullif(execution_time_limit, 0) IS NULL THEN 2 * time_target
            ELSE least(2 * time_target, execution_time_limit) END AS wait_limit, failure_limit
FROM sweep_workloads""")
def run_limits(spark, sf):
    loads = configs.workloads(configs.parse_sweeps(sweep_documents(spark, sf)))
    w = F.col("workload")
    return loads.select(
        "p_partkey", "workload_pos", w["name"].alias("name"),
        wait_limit(w["time_target"].cast("bigint"), w["execution_time_limit"].cast("bigint"))
        .alias("wait_limit"),
        failure_limit(w).alias("failure_limit"))


HISTORY_SQL = """
h AS (
  SELECT *, o_orderstatus = 'F' AS failed,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS run_number,
         sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) OVER (
           PARTITION BY o_custkey ORDER BY o_orderkey) AS island
  FROM orders
),
streaks AS (
  SELECT *, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (
              PARTITION BY o_custkey, island ORDER BY o_orderkey) AS BIGINT) AS streak
  FROM h
),
stops AS (
  SELECT o_custkey, min(run_number) AS stop FROM streaks WHERE streak >= 3 GROUP BY o_custkey
)"""


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").alias("success"),
        micros(F.col("o_orderdate")).alias("at"))


@query("run_numbers", f"WITH {HISTORY_SQL} SELECT o_custkey, o_orderkey, run_number FROM streaks")
def run_numbers(spark, sf):
    return history.with_run_number(_runs(spark, sf), ["o_custkey"], ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "run_number")


@query("failure_streaks", f"""WITH {HISTORY_SQL}
SELECT o_custkey, o_orderkey, run_number, streak FROM streaks""")
def failure_streaks(spark, sf):
    return history.with_streaks(_runs(spark, sf), ["o_custkey"], ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "run_number", "streak")


@query("run_outcomes", f"""WITH {HISTORY_SQL}
SELECT s.o_custkey, count(*) FILTER (NOT failed) AS num_successes,
       count(*) FILTER (failed) AS num_failures, max(run_number) AS last_run,
       CAST(max(epoch_us(o_orderdate)) - min(epoch_us(o_orderdate)) AS BIGINT) AS elapsed_time,
       CASE WHEN max(stop) IS NULL THEN 'target_reached' ELSE 'excessive_failures' END
         AS iteration_end_reason
FROM streaks s LEFT JOIN stops t ON t.o_custkey = s.o_custkey
WHERE stop IS NULL OR run_number <= stop GROUP BY s.o_custkey""")
def run_outcomes(spark, sf):
    return history.run_outcomes(
        _runs(spark, sf), ["o_custkey"], ["o_orderkey"], F.lit(3), at="at")


@query("log_run_outcomes", f"""WITH {LOG_FILES_SQL},
h AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (
        PARTITION BY file ORDER BY iteration) AS island,
        row_number() OVER (PARTITION BY file ORDER BY iteration) - 1 AS run_number FROM runs),
s AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (
        PARTITION BY file, island ORDER BY iteration) AS streak FROM h),
stops AS (SELECT file, min(iteration) AS stop FROM s WHERE streak >= 2 GROUP BY file)
SELECT s.file, count(*) FILTER (success) AS num_successes, count(*) FILTER (NOT success) AS num_failures,
       max(run_number) AS last_run,
       CASE WHEN max(stop) IS NULL THEN 'target_reached' ELSE 'excessive_failures' END
         AS iteration_end_reason
FROM s LEFT JOIN stops t ON t.file = s.file WHERE stop IS NULL OR iteration <= stop GROUP BY s.file""")
def log_run_outcomes(spark, sf):
    runs = _logs(spark, sf).records("finish_work", events=False).select(
        "file", F.col("data.iteration").alias("iteration"), F.col("data.success").alias("success"))
    return history.run_outcomes(runs, ["file"], ["iteration"], F.lit(2))


@query("run_continuation", f"""WITH {HISTORY_SQL}
SELECT o_custkey, o_orderkey, run_number,
       run_number + 1 < 6 AND max(0) = 0 AND
       epoch_us(o_orderdate) - min(min(epoch_us(o_orderdate))) OVER (
         PARTITION BY o_custkey ORDER BY o_orderkey) < 40000000000000 AS continues
FROM h GROUP BY o_custkey, o_orderkey, run_number, o_orderdate""")
def run_continuation(spark, sf):
    return history.with_continuation(
        _runs(spark, sf), ["o_custkey"], ["o_orderkey"], "at", F.lit(6), F.lit(40_000_000_000_000),
    ).select("o_custkey", "o_orderkey", "run_number", "continues")


@query("log_layout", """
SELECT c_custkey, 'exp' || (c_custkey % 10) AS experiment,
       '20160101_00' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '30' AS run_ts,
       lower(c_mktsegment) || '_x' AS workload, CAST(c_nationkey % 3 AS BIGINT) AS num_nodes,
       CAST(c_nationkey AS BIGINT) AS num_workers, '2G' AS shm_size FROM customer""")
def log_layout(spark, sf):
    from spanwell.sources.writers import log_path_parts

    path = F.format_string(
        "/base/exp%d/20160101_00%02d30/%s_x_%d_%d_2G.log", F.col("c_custkey") % 10,
        F.col("c_custkey") % 60, F.lower("c_mktsegment"), F.col("c_nationkey") % 3, F.col("c_nationkey"))
    return table(spark, sf, "customer").select("c_custkey", *log_path_parts(path))


@query("cells_without_runs", f"""WITH {SWEEPS_SQL}
SELECT p_partkey, system_pos, workload_pos FROM sweep_systems JOIN sweep_workloads USING (p_partkey)
EXCEPT SELECT l_partkey, l_linenumber % 2, l_linenumber % 3 FROM lineitem""")
def cells_without_runs(spark, sf):
    """Line numbers of a part's items stand for the cells of its sweep that have been run."""
    grid = history.sweep_grid(configs.parse_sweeps(sweep_documents(spark, sf))).select("p_partkey", "system_pos", "workload_pos")
    runs = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") % 2).alias("system_pos"), (F.col("l_linenumber") % 3).alias("workload_pos"))
    return history.cells_without_runs(grid, runs, grid.columns)
