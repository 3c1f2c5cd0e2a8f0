"""Operator inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwell.sources.writers import log_line


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows that one task gets of a table of whose rows each gives many times its bytes.
SPREAD_ROWS = 250_000


def spread_table(spark: SparkSession, sf: str, name: str, key: str | None = None) -> DataFrame:
    """A table for work that is heavy on each row.

    One file read by fewer tasks than there are cores is dealt out over all of
    them; a table of many files is left as it is, so at size nothing is shuffled. With a
    ``key`` it is dealt by that into as many parts as its counted rows need.
    """
    df = table(spark, sf, name)
    parts = spark.sparkContext.defaultParallelism
    if key:
        parts = max(parts, -(-df.count() // SPREAD_ROWS))
    if df.rdd.getNumPartitions() >= parts:
        return df
    return df.repartition(parts, key) if key else df.repartition(parts)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def span_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a start and a finish; sign-ups are the measure phase.

    Session and worker are the user, the task is the event, the duration comes
    from its value, and times are whole microseconds.
    """
    took = F.round(F.col("value") * 100).cast("bigint") * 6_000_000
    kind = F.when(F.col("event_type") == "signup", "benchmark:measure").otherwise(F.col("event_type"))
    user = F.col("user_id").cast("string")
    both = F.array(
        F.struct(F.lit(1).alias("status"), F.col("at").alias("timestamp")),
        F.struct(F.lit(2).alias("status"), (F.col("at") + took).alias("timestamp")),
    )
    return (
        table(spark, sf, "events").withColumn("at", micros(F.col("ts")))
        .select("event_id", user.alias("session"), user.alias("worker_id"),
                F.col("event_id").cast("string").alias("task_id"), kind.alias("event_type"),
                F.inline(both))
        .withColumn("seq", F.col("event_id") * 2 + F.col("status") - 1)
        .drop("event_id")
    )


SPAN_EVENTS_SQL = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session, event_id * 2 + s.status - 1 AS seq,
         CAST(user_id AS VARCHAR) AS worker_id, CAST(event_id AS VARCHAR) AS task_id,
         CASE WHEN event_type = 'signup' THEN 'benchmark:measure' ELSE event_type END AS event_type,
         s.status,
         epoch_us(ts) + (s.status - 1) * CAST(round(value * 100) AS BIGINT) * 6000000 AS "timestamp"
  FROM events, (VALUES (1), (2)) s(status)
)"""

PHASES_SQL = SPAN_EVENTS_SQL + """,
numbered AS (
  SELECT *, event_type LIKE 'benchmark:%' AS marks,
         row_number() OVER (PARTITION BY session ORDER BY "timestamp", seq) AS rn
  FROM ev
),
changed AS (
  SELECT *,
    CASE WHEN marks AND status = 2
      THEN max(CASE WHEN marks THEN rn END) OVER (PARTITION BY session ORDER BY rn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      ELSE max(CASE WHEN marks THEN rn END) OVER (PARTITION BY session ORDER BY rn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS change_rn,
    CAST(coalesce(sum(CASE WHEN marks AND status = 2 THEN 1 ELSE 0 END) OVER (
      PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
      AS phase_number
  FROM numbered
),
phased AS (
  SELECT c.*, CASE WHEN h.status = 1 THEN substr(h.event_type, 11) END AS phase,
         h."timestamp" AS phase_at
  FROM changed c LEFT JOIN numbered h ON h.session = c.session AND h.rn = c.change_rn
),
raw_spans AS (
  SELECT f.session, f.worker_id, f.task_id, f.event_type, s."timestamp" AS started,
         f."timestamp" AS finished, f."timestamp" - s."timestamp" AS elapsed,
         s.phase AS start_phase, f.phase AS last_phase,
         coalesce(s.phase IS DISTINCT FROM f.phase AND f.phase_number = s.phase_number + 1
           AND CAST(f."timestamp" - f.phase_at AS DOUBLE)
               / nullif(f."timestamp" - s."timestamp", 0) < 0.1, false) AS slipped
  FROM phased f JOIN phased s
    ON s.session = f.session AND s.task_id = f.task_id AND s.event_type = f.event_type
   AND s.status = 1 AND f.status = 2
),
spans AS (
  SELECT * EXCLUDE (last_phase),
         CASE WHEN slipped THEN start_phase ELSE last_phase END AS end_phase
  FROM raw_spans
)"""


def loose_events(spark: SparkSession, sf: str) -> DataFrame:
    """One event per row with a status that often breaks the start/finish rule."""
    user = F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "signup", "benchmark:measure").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        user.alias("session"), user.alias("worker_id"), F.lit("-1").alias("task_id"),
        kind.alias("event_type"), F.pmod("event_id", F.lit(4)).cast("int").alias("status"),
        micros(F.col("ts")).alias("timestamp"), F.col("event_id").alias("seq"),
    )


LOOSE_EVENTS_SQL = """
loose AS (
  SELECT CAST(user_id AS VARCHAR) AS session, CAST(user_id AS VARCHAR) AS worker_id,
         '-1' AS task_id,
         CASE WHEN event_type = 'signup' THEN 'benchmark:measure' ELSE event_type END AS event_type,
         CAST(event_id % 4 AS INTEGER) AS status, epoch_us(ts) AS "timestamp", event_id AS seq
  FROM events
),
known AS (
  SELECT *, lag(status) OVER w AS before, lead(status) OVER w AS after
  FROM loose WHERE status IN (1, 2)
  WINDOW w AS (PARTITION BY session, worker_id, task_id, event_type ORDER BY "timestamp", seq)
)"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment logs: a file per customer, a run per order, in JSON lines.

    Some files have no header or two; some runs have no statistics, some run
    inside a measure phase; failed runs were killed; some lines are broken.
    """
    customer = table(spark, sf, "customer")
    orders = spread_table(spark, sf, "orders", "o_orderkey")

    segment = F.lower("c_mktsegment")
    header = F.struct(
        F.lit("customers").alias("experiment_name"),
        F.struct(
            (F.col("c_nationkey") + 1).alias("num_workers"),
            F.when(F.col("c_nationkey") >= 12, 2).otherwise(1).alias("num_nodes"),
            F.lit("1G").alias("shm_size"),
        ).alias("system_config"),
        F.struct(segment.alias("name"), F.lit(10).alias("iteration_target")).alias("workload"),
        F.when(F.col("c_acctbal") >= 0, F.struct(
            F.md5(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).cast("binary")).alias("framework"),
            F.md5(F.concat(F.lit("b"), F.col("c_mktsegment")).cast("binary")).alias("benchmark"),
        )).alias("git-revs"),
    )
    copies = F.when(F.col("c_acctbal") < -900, 0).when(F.col("c_acctbal") > 9900, 2).otherwise(1)
    head_lines = customer.select(
        log_file(F.col("c_custkey")).alias("file"),
        F.explode(F.slice(F.array(F.lit(-2), F.lit(-1)), F.lit(1), copies)).alias("line"),
        log_line(F.lit("experiment"), F.lit(1.4e9) + F.col("c_custkey") * 0.5, header).alias("value"),
    )

    size = F.col("size")
    start = F.col("start")
    status = F.col("o_orderstatus")

    def event(name: str, code: int, at: Column) -> Column:
        return F.struct(at.alias("timestamp"), F.lit(-1).alias("worker_id"), F.lit(-1).alias("task_id"),
                        F.lit(name).alias("event_type"), F.lit(code).alias("status"))

    plain = F.array(event("total", 1, start), event("load", 1, start),
                    event("load", 2, start + size), event("total", 2, start + 2 * size))
    phased = F.array(event("benchmark:measure", 1, start), event("total", 1, start),
                     event("total", 2, start + 2 * size), event("benchmark:measure", 2, start + 2 * size))
    has_stats = F.col("o_orderpriority") != "1-URGENT"
    stats = F.struct(
        F.when(has_stats, F.struct(
            F.floor("o_totalprice").alias("batch_size"), F.col("o_orderpriority").alias("label"),
        )).alias("config"),
        F.when(F.col("o_orderpriority") == "2-HIGH", phased).when(has_stats, plain).alias("events"),
    )
    finish = log_line(F.lit("finish_work"), start + 2 * size, F.struct(
        F.col("o_orderkey").alias("iteration"), F.lit("w.py").alias("workload_script"),
        (2 * size).alias("elapsed_time"), stats.alias("stats"), (status != "F").alias("success"),
    ))
    killed = log_line(F.lit("killed"), start, F.struct(
        F.col("o_orderkey").alias("pid"), (10 * size).alias("waited_time"),
        F.lit(30).alias("waited_time_limit")))
    waiting = log_line(F.lit("waiting"), start, F.struct(
        F.col("o_orderkey").alias("pid"), size.alias("time_waited")))
    broken = F.when(F.col("o_orderpriority") == "5-LOW", "{broken")
    extra = F.when(status == "F", killed).when(status == "P", waiting).otherwise(broken)
    run_lines = (
        orders.withColumn("size", (F.pmod("o_orderkey", F.lit(40)) + 1) * 0.25)
        .withColumn("start", F.lit(1.4e9) + F.col("o_orderkey") * 64.0)
        .select(
            log_file(F.col("o_custkey")).alias("file"), F.col("o_orderkey"),
            F.posexplode(F.array(extra, finish)).alias("pos", "value"),
        )
        .where("value is not null")
        .select("file", (F.col("o_orderkey") * 2 + F.col("pos")).alias("line"), "value")
    )
    return head_lines.unionByName(run_lines).select(
        "file", F.lit(0).cast("bigint").alias("block"), "line", "value")


def log_file(key: Column) -> Column:
    return F.concat(F.lit("logs/exp"), key.cast("string"), F.lit(".log"))


LOG_FILES_SQL = """
files AS (
  SELECT 'logs/exp' || c_custkey || '.log' AS file, 1.4e9 + c_custkey * 0.5 AS epoch,
         strftime(make_timestamp(CAST(floor(1.4e9 + c_custkey * 0.5) AS BIGINT) * 1000000),
                  '%Y%m%d %H:%M:%S') AS "timestamp",
         lower(c_mktsegment) AS workload, CAST(c_nationkey + 1 AS BIGINT) AS num_workers,
         CAST(CASE WHEN c_nationkey >= 12 THEN 2 ELSE 1 END AS BIGINT) AS num_nodes,
         CASE WHEN c_acctbal >= 0 THEN md5('f' || c_nationkey) END AS framework_rev,
         CASE WHEN c_acctbal >= 0 THEN md5('b' || c_mktsegment) END AS benchmark_rev,
         CASE WHEN c_acctbal < -900 THEN 0 WHEN c_acctbal > 9900 THEN 2 ELSE 1 END AS headers
  FROM customer
),
runs AS (
  SELECT 'logs/exp' || o_custkey || '.log' AS file, o_orderkey AS iteration,
         o_orderstatus <> 'F' AS success, o_orderstatus AS status, o_orderpriority AS priority,
         (o_orderkey % 40 + 1) * 0.25::DOUBLE AS size, CAST(floor(o_totalprice) AS BIGINT) AS batch_size
  FROM orders
),
rolled AS (
  SELECT f.*, coalesce(r.fail_ct, 0) AS fail_ct, coalesce(r.best, -1) AS max_success_iteration,
         c.batch_size, c.priority AS label
  FROM files f
  LEFT JOIN (SELECT file, count(*) FILTER (NOT success) AS fail_ct,
                    max(iteration) FILTER (success) AS best,
                    max(iteration) FILTER (success AND priority <> '1-URGENT') AS best_config
             FROM runs GROUP BY file) r ON r.file = f.file
  LEFT JOIN runs c ON c.iteration = r.best_config
  WHERE f.headers = 1
),
run_spans AS (
  SELECT file, 'load' AS event_type, CAST(NULL AS VARCHAR) AS phase, size AS elapsed
  FROM runs WHERE success AND priority NOT IN ('1-URGENT', '2-HIGH')
  UNION ALL
  SELECT file, 'total', CASE WHEN priority = '2-HIGH' THEN 'measure' END, 2 * size
  FROM runs WHERE success AND priority <> '1-URGENT'
  UNION ALL
  SELECT file, 'benchmark:measure', 'measure', 2 * size
  FROM runs WHERE success AND priority = '2-HIGH'
),
run_stats AS (
  SELECT file, phase AS start_phase, phase AS end_phase, event_type, count(*) AS ct,
         sum(elapsed) AS total_elapsed_time, min(elapsed) AS min_elapsed_time,
         max(elapsed) AS max_elapsed_time, avg(elapsed) AS avg_elapsed_time,
         stddev_pop(elapsed) AS stddev_elapsed_time
  FROM run_spans GROUP BY ALL
)"""


# A small metric config in the documented JSON form. One name stands twice, one
# workload has no metrics, one has no column choice, and one is not mentioned.
METRIC_CONFIG = """
{"workloads": [
  {"name": "building", "description": "Buildings", "key_metrics": [
     {"name": "loads", "expression": {"expression_type": "value", "value": "load_ct"}},
     {"name": "evenness", "expression": {"expression_type": "frac_values",
        "numer": "load_min_elapsed_time", "denom": "load_max_elapsed_time"}}],
   "cols": {"load_ct": "loads", "load_max_elapsed_time": "slowest load", "success_iteration_max": "last good"}},
  {"name": "machinery", "description": "Superseded", "key_metrics": []},
  {"name": "automobile", "description": "Cars", "key_metrics": [
     {"name": "best iteration", "expression": {"expression_type": "value",
        "value": "max_successful_iteration"}},
     {"name": "failures per total", "expression": {"expression_type": "frac_values",
        "numer": "failures_ct", "denom": "total_max_elapsed_time"}}]},
  {"name": "machinery", "description": "Machines", "key_metrics": [
     {"name": "label", "expression": {"expression_type": "value", "value": "label"}},
     {"name": "missing", "expression": {"expression_type": "frac_values",
        "numer": "batch_size", "denom": "no_such_value"}}],
   "cols": {"measure:measure:total_ct": "measured", "success_iteration_max": "best"}},
  {"name": "household", "description": "Homes"}
]}
"""


def metric_documents(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(METRIC_CONFIG).alias("value"))


def sweep_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A sweep config per part, as JSON text: two systems, three workloads.

    The workloads leave the failure limit out, set it to null, or set a number.
    """
    p = table(spark, sf, "part")
    text = F.format_string(
        '{"system_configs":['
        '{"num_workers":%1$d,"num_nodes":1,"mem_size":"1G","shm_size":"1G","mem_size":null},'
        '{"num_workers":%2$d,"num_nodes":2,"shm_size":"2G","mem_size":"4G"}],'
        '"workloads":['
        '{"name":"%3$s","iteration_target":%1$d,"time_target":null,"execution_time_limit":%1$d},'
        '{"name":"%4$s","iteration_target":null,"time_target":%1$d,"execution_time_limit":30,'
        '"sequential_failures_limit":null},'
        '{"name":"both","iteration_target":%1$d,"time_target":%2$d,"execution_time_limit":0,'
        '"sequential_failures_limit":%1$d}]}',
        F.col("p_size"), F.col("p_size") * 2, F.col("p_brand"), F.col("p_type"),
    )
    return p.select("p_partkey", text.alias("value"))


SWEEPS_SQL = """
sweep_systems AS (
  SELECT p_partkey, s.system_pos, CAST(p_size * s.factor AS BIGINT) AS num_workers, s.num_nodes,
         s.shm_size, s.mem_size
  FROM part, (VALUES (0, 1, CAST(1 AS BIGINT), '1G', NULL), (1, 2, CAST(2 AS BIGINT), '2G', '4G'))
    s(system_pos, factor, num_nodes, shm_size, mem_size)
),
sweep_workloads AS (
  SELECT p_partkey, 0 AS workload_pos, p_brand AS name, CAST(p_size AS BIGINT) AS iteration_target,
         CAST(NULL AS BIGINT) AS time_target, CAST(p_size AS BIGINT) AS execution_time_limit,
         CAST(3 AS BIGINT) AS failure_limit FROM part
  UNION ALL
  SELECT p_partkey, 1, p_type, NULL, p_size, 30, 1 FROM part
  UNION ALL
  SELECT p_partkey, 2, 'both', p_size, p_size * 2, 0, greatest(p_size, 1) FROM part
)"""
