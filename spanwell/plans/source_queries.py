"""Sources and sinks over data that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from spanwell.plans.inputs import SPAN_EVENTS_SQL, log_lines, span_events, sweep_documents, table
from spanwell.plans.inputs import LOG_FILES_SQL, SWEEPS_SQL
from spanwell.plans.registry import query
from spanwell.session import settled, shared_folder
from spanwell.sources import committed, configs, large_dumps, listing, logs, traces, writers


def _raw_records(spark, sf):
    """A trace record per event: ids in a binary key, two tuples in a JSON array."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    key = F.concat(
        F.encode(F.lit("event_log:"), "UTF-8"), F.unhex(F.sha1(F.col("user_id").cast("string").cast("binary"))),
        F.encode(F.lit(":"), "UTF-8"), F.unhex(F.sha1(F.col("event_id").cast("string").cast("binary"))))
    value = F.format_string(
        '[[%1$d.5, "%2$s", 1, {"k": 1}], [%1$d.75, "%2$s", 2, {}]]',
        F.floor(at / 1000000), F.col("event_type"))
    return table(spark, sf, "events").select(key.alias("key"), value.alias("value"))


@query("trace_records", """
SELECT sha1(CAST(user_id AS VARCHAR)) AS worker_id, sha1(CAST(event_id AS VARCHAR)) AS task_id,
       CAST(s.status - 1 AS INTEGER) AS pos,
       epoch_us(ts) // 1000000 + CASE WHEN s.status = 1 THEN 0.5 ELSE 0.75 END::DOUBLE AS "timestamp",
       event_type, s.status, CASE WHEN s.status = 1 THEN '{"k":1}' ELSE '{}' END AS extras
FROM events, (VALUES (1), (2)) s(status)""")
def trace_records(spark, sf):
    return traces.decode_records(_raw_records(spark, sf))


def _damaged_records(spark, sf):
    """Of every five records four have an element, or a value, that cannot be read."""
    kind = F.pmod("event_id", F.lit(5))
    value = F.when(kind == 0, '{"a": 1}').otherwise(F.concat(F.lit('[[1.5, "x", 1, {}], '), F.when(
        kind == 1, '[2.5, "x", 2]').when(kind == 2, '["noon", "x", 2, {}]').when(
        kind == 3, '[2.5, "x", "done", {}]').otherwise('[2.5, "x", 2, {}]'), F.lit("]")))
    return table(spark, sf, "events").select("event_id", F.lit(None).cast("binary").alias("key"), value.alias("value"))


@query("rejected_trace_records", """
SELECT event_id, CAST(CASE WHEN event_id % 5 <> 0 THEN 1 END AS INTEGER) AS pos,
       CASE event_id % 5 WHEN 0 THEN 'value is no array' WHEN 1 THEN 'fewer than four fields'
                         WHEN 2 THEN 'timestamp is no number' ELSE 'status is no number' END AS reason
FROM events WHERE event_id % 5 < 4""")
def rejected_trace_records(spark, sf):
    """Elements and values that cannot be read, with the reason."""
    return traces.rejected_records(_damaged_records(spark, sf)).select("event_id", "pos", "reason")


@query("counted_trace_records", """
SELECT CASE event_id % 5 WHEN 0 THEN 'value is no array' WHEN 1 THEN 'fewer than four fields'
                         WHEN 2 THEN 'timestamp is no number' ELSE 'status is no number' END AS outcome,
       count(*) AS elements
FROM events WHERE event_id % 5 < 4 GROUP BY outcome
UNION ALL SELECT 'read', sum(CASE event_id % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END)::BIGINT FROM events""")
def counted_trace_records(spark, sf):
    """How many elements were read, and how many rejected why, counted while the events are written."""
    counts = Observation("trace-records")
    settled(traces.decode_records(_damaged_records(spark, sf), counts=counts), "events")
    return spark.createDataFrame(sorted(counts.get.items()), "outcome string, elements bigint").where("elements > 0")


@query("typed_extras", """
SELECT sha1(CAST(event_id AS VARCHAR)) AS task_id, CAST(s.pos AS INTEGER) AS pos,
       epoch_us(ts) // 1000000 + CASE WHEN s.pos = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS "timestamp",
       event_type, CAST(s.pos + 1 AS INTEGER) AS status,
       CASE WHEN s.pos = 1 THEN 'absent' WHEN event_id % 4 = 0 THEN 'absent' WHEN event_id % 4 = 1 THEN 'null' ELSE 'value' END AS presence,
       CASE WHEN s.pos = 0 AND event_id % 4 >= 2 THEN CASE event_id % 4 WHEN 2 THEN 'number' ELSE 'text' END END AS kind,
       CASE WHEN s.pos = 0 AND event_id % 4 >= 2 THEN event_id END AS size
FROM events, (VALUES (0), (1)) s(pos)""")
def typed_extras(spark, sf):
    """Extras whose key ``size`` is missing, null, a number or text; the second element's extras are null."""
    id_ = F.col("event_id").cast("string")
    size = F.element_at(F.array(F.lit("{}"), F.lit('{"size": null}'), F.concat(F.lit('{"size": '), id_, F.lit("}")),
                                F.concat(F.lit('{"size": "'), id_, F.lit('"}'))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    key = F.concat(F.encode(F.lit("event_log:"), "UTF-8"), F.unhex(F.sha1(F.col("user_id").cast("string").cast("binary"))),
                   F.encode(F.lit(":"), "UTF-8"), F.unhex(F.sha1(id_.cast("binary"))))
    value = F.format_string('[[%1$d.5, "%2$s", 1, %3$s], [%1$d.75, "%2$s", 2, null]]', at, F.col("event_type"), size)
    events = traces.variant_records(table(spark, sf, "events").select(key.alias("key"), value.alias("value")))
    found = F.try_variant_get("extras", "$.size", "variant")
    state = traces.presence(F.col("extras"), "size")
    return events.select(
        "task_id", "pos", "timestamp", "event_type", "status", state.alias("presence"),
        F.when(state == "value", F.when(F.schema_of_variant(found) == "STRING", "text").otherwise("number")).alias("kind"),
        F.try_variant_get("extras", "$.size", "bigint").alias("size"))


@query("worker_registry", """
SELECT sha1(CAST(c_custkey AS VARCHAR)) AS worker_id,
       '10.0.' || c_nationkey || '.' || (c_custkey % 250) AS ip FROM customer
UNION ALL SELECT 'DRIVER', '127.0.0.1'""")
def worker_registry(spark, sf):
    key = F.concat(F.encode(F.lit("Workers:"), "UTF-8"),
                   F.unhex(F.sha1(F.col("c_custkey").cast("string").cast("binary"))))
    ip = F.concat_ws(".", F.lit("10.0"), F.col("c_nationkey").cast("string"),
                     (F.col("c_custkey") % 250).cast("string"))
    raw = table(spark, sf, "customer").select(key.alias("key"), ip.alias("node_ip_address"))
    return traces.decode_workers(raw, "127.0.0.1")


@query("event_addresses", """
SELECT event_id, CAST(user_id AS VARCHAR) AS worker_id, '10.0.' || c_nationkey || '.' || (c_custkey % 250) AS ip
FROM events LEFT JOIN customer ON user_id = c_custkey""")
def event_addresses(spark, sf):
    workers = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("worker_id"),
        F.concat_ws(".", F.lit("10.0"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 250).cast("string")).alias("ip"))
    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("worker_id"))
    return traces.with_addresses(events, workers)


@query("stdout_stats", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END AS first_turn,
       CAST(CASE WHEN role = 'user' THEN 1 END AS INTEGER) AS events,
       CASE WHEN role = 'user' THEN CAST(conv_id + 0.5 AS DOUBLE) END AS started
FROM conversations""")
def stdout_stats(spark, sf):
    line = F.format_string(
        'BENCHMARK_STATS: {"config": {"turn": %d}, "events": [{"timestamp": %d.5, "worker_id": -1, '
        '"task_id": -1, "event_type": "x", "status": 1, "extras": {}}]}', F.col("turn"), F.col("conv_id"))
    later = F.lit('BENCHMARK_STATS: {"config": {"turn": -1}, "events": []}')
    stdout = F.when(F.col("role") == "user", F.concat_ws("\n", "text", line, later, F.lit("done"))).otherwise(
        F.concat(F.lit(" BENCHMARK_STATS: {}\n"), F.col("text")))
    found = traces.extract_stats(table(spark, sf, "conversations").withColumn("stdout", stdout))
    return found.select(
        "conv_id", "turn", F.col("stats.config")["turn"].alias("first_turn"),
        F.when(F.col("stats.events").isNotNull(), F.size("stats.events")).alias("events"),
        F.get("stats.events", F.lit(0))["timestamp"].alias("started"))


@query("dump_documents", """
SELECT event_id, pos, CASE WHEN pos = 0 THEN 1 ELSE 2 END AS status, event_type,
       CAST(user_id AS VARCHAR) AS worker_id, '10.1.1.1' AS ip
FROM events, (VALUES (0), (1)) p(pos)""")
def dump_documents(spark, sf):
    """A dump per event, written as JSON text and parsed again."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    step = [F.struct(F.lit(i / 2).alias("timestamp"), user.alias("worker_id"), F.lit("-1").alias("task_id"),
                     kind.alias("event_type"), F.lit(i + 1).alias("status"), F.lit(None).cast("string").alias("extras"))
            for i in (0, 1)]
    dumps = table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(
            F.array(*step).alias("events"), F.create_map(user, F.lit("10.1.1.1")).alias("worker_ips"),
        )).alias("value"))
    parsed = traces.parse_dumps(dumps)
    events = traces.dump_events(parsed.withColumn("ips", F.col("worker_ips")))
    return events.select("event_id", "pos", "status", "event_type", "worker_id",
                         F.col("ips")[F.col("worker_id")].alias("ip"))


@query("dump_roundtrip", f"""WITH {SPAN_EVENTS_SQL}
SELECT session, seq, worker_id, task_id, event_type, status, "timestamp" FROM ev""")
def dump_roundtrip(spark, sf):
    """Events written as gzip JSON lines and read back."""
    path = shared_folder(spark, "dump")
    events = span_events(spark, sf)
    writers.write_dump(events, path, form="json")
    return spark.read.schema(events.schema).json(f"{path}/events").select(
        "session", "seq", "worker_id", "task_id", "event_type", "status", "timestamp")


@query("log_roundtrip", f"""WITH {LOG_FILES_SQL}
SELECT 'experiment' AS type, epoch AS "timestamp", NULL AS number, workload, framework_rev, num_workers, num_nodes,
       NULL AS success, NULL AS seconds, NULL AS label, NULL AS events
FROM files, range(headers)
UNION ALL
SELECT 'finish_work', 1.4e9 + iteration * 64.0 + 2 * size, iteration, NULL, NULL, NULL, NULL, success, 2 * size,
       CASE WHEN priority <> '1-URGENT' THEN priority END, CAST(CASE WHEN priority <> '1-URGENT' THEN 4 END AS BIGINT) FROM runs
UNION ALL
SELECT 'killed', 1.4e9 + iteration * 64.0, iteration, NULL, NULL, NULL, NULL, NULL, 10 * size, NULL, NULL FROM runs WHERE status = 'F'
UNION ALL
SELECT 'waiting', 1.4e9 + iteration * 64.0, iteration, NULL, NULL, NULL, NULL, NULL, size, NULL, NULL FROM runs WHERE status = 'P'
UNION ALL
SELECT '{{broken', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM runs WHERE status = 'O' AND priority = '5-LOW'""")
def log_roundtrip(spark, sf):
    """Log lines appended as text files and read back with the file reader, record by record; broken lines as they are."""
    path = shared_folder(spark, "logs")
    writers.append_records(log_lines(spark, sf).select("value"), path)
    back = logs.read_logs(spark, path, prefix="part-")
    data = F.col("data")
    records = back.records().select(
        "type", "timestamp", F.coalesce(data["iteration"], data["pid"]).alias("number"),
        data["workload"]["name"].alias("workload"), data["git-revs"]["framework"].alias("framework_rev"),
        data["system_config"]["num_workers"].alias("num_workers"), data["system_config"]["num_nodes"].alias("num_nodes"),
        data["success"].alias("success"),
        F.coalesce(data["elapsed_time"], data["waited_time"], data["time_waited"]).alias("seconds"),
        data["stats"]["config"]["label"].alias("label"), F.array_size(data["stats"]["events"]).cast("bigint").alias("events"))
    return records.unionByName(back.rejected().select(F.col("value").alias("type")), allowMissingColumns=True)


@query("committed_records", f"""WITH {LOG_FILES_SQL}
SELECT o.batch, file, line, value_type, value_number FROM (
  SELECT CAST(iteration % 3 AS BIGINT) AS batch, file, iteration * 2 + 1 AS line, 'finish_work' AS value_type, iteration AS value_number FROM runs
  UNION ALL SELECT iteration % 3, file, iteration * 2, CASE status WHEN 'F' THEN 'killed' ELSE 'waiting' END, iteration
  FROM runs WHERE status IN ('F', 'P')
  UNION ALL SELECT iteration % 3, file, iteration * 2, NULL, NULL FROM runs WHERE status = 'O' AND priority = '5-LOW') o""")
def committed_records(spark, sf):
    """Run lines written in three committed batches, the second of them twice, and read back whole."""
    path = shared_folder(spark, "committed")
    lines = log_lines(spark, sf).where("line >= 0").select(
        "file", F.to_json(F.struct("line", "value")).alias("value"), F.pmod(F.floor(F.col("line") / 2), F.lit(3)).alias("batch"))
    for batch in (0, 1, 2, 1):
        committed.append_batch(lines.where(F.col("batch") == batch), path, batch)
    back = committed.read_committed(spark, path).select("batch", "file", F.from_json("value", "line bigint, value string").alias("v"))
    record = F.from_json("v.value", "type string, data struct<iteration bigint, pid bigint>")
    return logs.parse_once(back, record, ["batch", "file", F.col("v.line").alias("line")]).select(
        "batch", "file", "line", F.col("type").alias("value_type"), F.coalesce("data.iteration", "data.pid").alias("value_number"))


@query("listed_files", """
SELECT CAST(o_orderkey % 8 AS BIGINT) AS k, o_orderpriority AS name, CAST(sum(length(o_orderkey::VARCHAR) + 1) AS BIGINT) AS bytes
FROM orders GROUP BY ALL""")
def listed_files(spark, sf):
    """Order keys as lines in folders by priority, found and measured by the directory reader."""
    path = shared_folder(spark, "listed")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("value"), (F.col("o_orderkey") % 8).alias("k"), F.col("o_orderpriority").alias("name"))
    orders.write.partitionBy("k", "name").text(path)
    found = listing.walk(spark, path, prefix="part-")
    return found.groupBy(
        F.regexp_extract("file", "/k=([0-9]+)/", 1).cast("bigint").alias("k"),
        F.url_decode(F.regexp_extract("file", "/name=([^/]*)/", 1)).alias("name")).agg(F.sum("length").alias("bytes"))


def _written_documents(docs, path, by=("k",)):
    """Documents (``value``) in a file of their own each, in folders by the columns ``by``."""
    docs.select(*by, "value").repartition(*by).write.partitionBy(*by).text(path)


def _ranged(number, size):
    """The range of ``size`` whole numbers that a number lies in."""
    return F.floor(F.col(number) / size).alias("part")


def _sweep_configs(parts, size=10_000):
    """A sweep config for each ``k`` and range of part keys."""
    one = F.format_string(
        '{"num_workers":%1$d,"num_nodes":1,"mem_size":"1G","shm_size":"1G","mem_size":null},'
        '{"num_workers":%2$d,"num_nodes":2,"shm_size":"2G","mem_size":"4G"}', F.col("p_size"), F.col("p_size") * 2)
    return parts.groupBy((F.col("p_partkey") % 16).alias("k"), _ranged("p_partkey", size)).agg(
        F.format_string('{"system_configs":[%s],"workloads":[]}', F.array_join(F.collect_list(one), ",")).alias("value"))


def _event_dumps(events, size=100_000):
    """A dump for each ``k`` and range of event ids, so that a user with many events has many dumps."""
    event = F.struct(
        F.col("event_id").cast("double").alias("timestamp"), F.col("user_id").cast("string").alias("worker_id"),
        F.lit("-1").alias("task_id"), "event_type", F.lit(1).alias("status"), F.lit(None).cast("string").alias("extras"))
    return events.groupBy((F.col("user_id") % 16).alias("k"), _ranged("event_id", size)).agg(
        F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("value"))


@query("sweep_config_files", f"""WITH {SWEEPS_SQL}
SELECT p_partkey % 16 AS k, num_workers, num_nodes, shm_size, mem_size, count(*) AS systems
FROM sweep_systems GROUP BY ALL""")
def sweep_config_files(spark, sf):
    """All parts' systems in sixteen folders of sweep configs, one document a file, read by the file reader."""
    path = shared_folder(spark, "sweeps")
    _written_documents(_sweep_configs(table(spark, sf, "part")), path, ("k", "part"))
    found = configs.systems(configs.read_sweeps(spark, path))
    return found.groupBy(
        F.regexp_extract("file", "/k=(\\d+)/", 1).cast("bigint").alias("k"),
        "num_workers", "num_nodes", "shm_size", "mem_size").agg(F.count(F.lit(1)).alias("systems"))


@query("metric_config_files", """
SELECT o_orderkey % 4 AS k, o_orderstatus AS workload, o_orderpriority AS name, count(*) AS orders
FROM orders GROUP BY ALL""")
def metric_config_files(spark, sf):
    """Four metric configs whose column choices carry counts of orders, read by the file reader."""
    path = shared_folder(spark, "metrics")
    counts = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 4).alias("k"), "o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).cast("string").alias("n"))
    entries = counts.groupBy("k", "o_orderstatus").agg(F.struct(
        F.col("o_orderstatus").alias("name"), F.lit("orders").alias("description"),
        F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("cols")).alias("entry"))
    docs = entries.groupBy("k").agg(F.to_json(F.struct(F.collect_list("entry").alias("workloads"))).alias("value"))
    _written_documents(docs, path)
    read = None
    for k in range(4):  # a config is one file
        one = configs.read_metrics(spark, f"{path}/k={k}").select(F.lit(k).cast("bigint").alias("k"), "workload", F.explode("cols").alias("name", "n"))
        read = one if read is None else read.unionByName(one)
    return read.select("k", "workload", "name", F.col("n").cast("bigint").alias("orders"))


@query("dump_files", """
SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS worker_id, CAST(user_id % 16 AS BIGINT) AS k FROM events""")
def dump_files(spark, sf):
    """All events in sixteen folders of dumps, one document a file, read by the file reader."""
    path = shared_folder(spark, "dumps")
    _written_documents(_event_dumps(table(spark, sf, "events")), path, ("k", "part"))
    return traces.dump_events(traces.read_dumps(spark, path)).select(
        F.col("timestamp").cast("bigint").alias("event_id"), "event_type", "worker_id",
        F.regexp_extract("file", "/k=(\\d+)/", 1).cast("bigint").alias("k"))


@query("split_dump_files", """
SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS worker_id, CAST(user_id % 16 AS BIGINT) AS k,
       row_number() OVER (PARTITION BY user_id % 16, event_id // 100000 ORDER BY event_id) AS place FROM events""")
def split_dump_files(spark, sf):
    """All events in dumps of many events, read by ranges of bytes; a dump's events come in order of their ids."""
    path = shared_folder(spark, "dumps")
    dumps = _event_dumps(table(spark, sf, "events"))
    in_order = F.from_json("value", "events array<struct<timestamp double, worker_id string, task_id string, event_type string, status int>>")
    ordered = dumps.withColumn("value", F.to_json(F.struct(F.array_sort(in_order["events"]).alias("events"))))
    _written_documents(ordered, path, ("k", "part"))
    found = large_dumps.read_events(spark, path, prefix="part-", chunk=1 << 20)
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return found.select(
        F.col("timestamp").cast("bigint").alias("event_id"), "event_type", "worker_id",
        F.regexp_extract("file", "/k=(\\d+)/", 1).cast("bigint").alias("k"), place.alias("place"))


@query("corpus_roundtrip", """
SELECT line, count(*) AS lines FROM (
  SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents) GROUP BY line""")
def corpus_roundtrip(spark, sf):
    """Document lines written as text files and read back as a corpus."""
    path = shared_folder(spark, "corpus")
    lines = F.split(F.translate("text", "\r", " "), "\n")
    table(spark, sf, "documents").select(F.explode(lines).alias("value")).write.text(path)
    return configs.read_corpus(spark, path).groupBy(F.col("text").alias("line")).agg(
        F.count(F.lit(1)).alias("lines"))


@query("experiment_folders", """
SELECT CAST(o_custkey % 3 AS VARCHAR) AS experiment, o_orderpriority AS workload, count(*) AS records,
       min(o_orderkey) AS low, max(o_orderkey) AS high
FROM orders GROUP BY ALL""")
def experiment_folders(spark, sf):
    """Records written by experiment and identity folders and read back."""
    path = shared_folder(spark, "experiments")
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("e"), (F.col("o_custkey") % 3).cast("string")).alias("experiment"),
        F.lit("20160101_000000").alias("run_ts"), F.col("o_orderpriority").alias("workload"),
        F.lit(1).alias("num_nodes"), F.lit(4).alias("num_workers"), "o_orderkey")
    writers.write_experiments(orders, path)
    return spark.read.parquet(path).groupBy(
        F.substring("experiment", 2, 9).alias("experiment"), "workload"
    ).agg(F.count(F.lit(1)).alias("records"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("published_report", """
SELECT o_orderpriority AS workload, o_orderstatus AS status, count(*) AS records, count(DISTINCT o_custkey) AS customers,
       min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, CAST(min(o_orderdate) AS DATE) AS since
FROM orders GROUP BY ALL""")
def published_report(spark, sf):
    """A report published twice to one place; the latest is read back."""
    path = shared_folder(spark, "latest")
    report = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("workload"), F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("o_custkey").alias("customers"),
        F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"),
        F.min(F.col("o_orderdate").cast("date")).alias("since"))
    writers.publish_latest(report.withColumn("records", F.lit(0)), path)
    writers.publish_latest(report, path)
    return writers.read_latest(spark, path, report.schema)
