"""Trace records, registries, dumps, configs, stdout lines and sinks."""

import gzip
import json

from pyspark.sql import functions as F

from spanwell.functions import scalars
from spanwell.operators import generate, history, spans
from spanwell.sources import configs, traces, writers


def test_record_key_layout(spark):
    key = b"event_log:ABCDEFGHIJKLMNOPQRST:abcdefghijklmnopqrst"
    value = json.dumps([[1.25, "x", 1, {"a": [1, 2]}], [2.5, "x", 2, {}]])
    raw = spark.createDataFrame([(key, value)], "key binary, value string")
    got = [tuple(r) for r in traces.decode_records(raw).orderBy("pos").collect()]
    worker, task = "4142434445464748494a4b4c4d4e4f5051525354", "6162636465666768696a6b6c6d6e6f7071727374"
    assert got == [(worker, task, 0, 1.25, "x", 1, '{"a":[1,2]}'), (worker, task, 1, 2.5, "x", 2, "{}")]


def test_registry_adds_the_driver(spark):
    raw = spark.createDataFrame([(b"Workers:ABCDEFGHIJKLMNOPQRST", "10.0.0.1")], "key binary, node_ip_address string")
    got = {tuple(r) for r in traces.decode_workers(raw, "10.0.0.9").collect()}
    assert got == {("4142434445464748494a4b4c4d4e4f5051525354", "10.0.0.1"), ("DRIVER", "10.0.0.9")}


def dump(path, config):
    events = [
        {"timestamp": 1.0, "worker_id": -1, "task_id": -1, "event_type": "benchmark:measure", "status": 1, "extras": {}},
        {"timestamp": 4.0, "worker_id": -1, "task_id": -1, "event_type": "benchmark:measure", "status": 2, "extras": {}},
    ]
    document = {"events": events, "worker_ips": {"DRIVER": "10.0.0.9"}}
    if config:
        document["config"] = config
    with gzip.open(path, "wt") as f:
        json.dump(document, f, indent=1)


def test_dumps_of_both_shapes_and_their_headline(spark, tmp_path):
    dump(tmp_path / "a.json.gz", None)
    dump(tmp_path / "b.json.gz", {"num_nodes": 2, "workload": "wc"})
    dumps = traces.read_dumps(spark, str(tmp_path))
    assert {r.file.split("/")[-1]: r.config for r in dumps.collect()} == {
        "a.json.gz": None, "b.json.gz": {"num_nodes": "2", "workload": "wc"}}
    built = spans.build_spans(traces.dump_events(dumps), ["file"], ["timestamp", "pos"])
    lines = spans.headline(spans.span_stats(built.spans, ["file"]), ["file"]).collect()
    assert [r.avg_elapsed_time for r in lines] == [3.0, 3.0]
    assert traces.dump_workers(dumps).count() == 2


def test_dump_written_as_documents_is_read_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    dump(tmp_path / "in" / "a.json.gz", {"n": 1})
    dumps = traces.read_dumps(spark, str(tmp_path / "in"))
    writers.write_dump_documents(dumps, str(tmp_path / "out"))
    back = traces.read_dumps(spark, str(tmp_path / "out"))
    assert back.drop("file").collect() == dumps.drop("file").collect()
    assert writers.dump_documents(dumps).count() == 1


def test_stdout_takes_the_first_statistics_line(spark):
    text = 'x\nBENCHMARK_STATS: {"config": {"a": 1}, "events": []}\nBENCHMARK_STATS: {"config": {"a": 2}}\n'
    df = spark.createDataFrame([(text,), ("nothing",), (None,)], "stdout string")
    got = [r.stats for r in traces.extract_stats(df).collect()]
    assert got[0].config == {"a": "1"} and got[0].events == []
    assert got[1].config is None and got[1].events is None
    assert got[2].config is None


# A key may stand twice; the last one counts.
SWEEP = """{"system_configs": [
  {"num_workers": 3, "num_nodes": 2, "mem_size": "7G", "shm_size": "2G", "mem_size": "5G"},
  {"num_workers": 48, "num_nodes": 6, "shm_size": "9G"}],
 "workloads": [
  {"name": "sorts", "iteration_target": 25, "execution_time_limit": null, "sequential_failures_limit": null},
  {"name": "joins", "time_target": 900, "execution_time_limit": 45},
  {"name": "scans", "iteration_target": 4, "execution_time_limit": 20, "sequential_failures_limit": 6}]}"""


def test_sweep_file(spark, tmp_path):
    (tmp_path / "sweep.json").write_text(SWEEP)
    sweeps = configs.read_sweeps(spark, str(tmp_path))
    assert [r.mem_size for r in configs.systems(sweeps).collect()] == ["5G", None]
    grid = history.sweep_grid(sweeps).select("num_nodes", F.col("workload")["name"]).collect()
    assert [tuple(r) for r in grid] == [(n, w) for n in (2, 6) for w in ("sorts", "joins", "scans")]
    w = F.col("workload")
    limits = configs.workloads(sweeps).select(
        scalars.failure_limit(w), scalars.wait_limit(
            w["time_target"].cast("bigint"), w["execution_time_limit"].cast("bigint"))).collect()
    assert [tuple(r) for r in limits] == [(1, None), (3, 45), (6, 20)]


def test_metric_file_keeps_the_last_of_a_name(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"workloads": [
        {"name": "a", "description": "old"}, {"name": "a", "description": "new", "cols": {"x": "y"}}]}))
    got = configs.read_metrics(spark, str(tmp_path)).collect()
    assert [(r.workload, r.description, r.cols, r.key_metrics) for r in got] == [("a", "new", {"x": "y"}, None)]


def test_log_lines_written_are_valid_records(spark, tmp_path):
    lines = spark.range(3).select(writers.log_line(
        F.lit("killed"), F.col("id"), F.struct(F.col("id").alias("pid"), F.lit(1.5).alias("waited_time"))).alias("value"))
    writers.append_records(lines, str(tmp_path / "log"))
    writers.append_records(lines, str(tmp_path / "log"))
    texts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(texts) == 6
    assert {"type": "killed", "timestamp": 2.0, "data": {"pid": 2, "waited_time": 1.5}} in texts


def test_continuation(spark):
    rows = spark.sql("""select * from values (1, 5, 10, null), (10, 5, 10, null), (1, 5, null, 6),
        (1, 7, null, 6), (1, 5, 10, 6), (10, 5, 10, 6), (1, 5, 0, 0) t(n, took, count_limit, time_limit)""")
    got = [r[0] for r in rows.select(scalars.keeps_running(
        F.col("n"), F.col("took"), F.col("count_limit"), F.col("time_limit"))).collect()]
    assert got == [True, False, True, False, True, False, None]


def test_sweep_text(spark):
    df = spark.createDataFrame([("1:10:3",), ("4:2:1",), ("1:2",), ("1:5:0",)], "s string")
    got = [r[0] for r in df.select(scalars.arithmetic_range(F.col("s"))).collect()]
    assert got == [[1, 4, 7, 10], [], None, None]


def test_rate_of_zero_time_is_null(spark):
    assert spark.range(1).select(scalars.rate(F.lit(5), F.lit(0))).first()[0] is None


def test_generated_values(spark):
    df = spark.createDataFrame([(0,), (3,)], "n int")
    got = df.select(*[generate.generated(k, F.col("n"), F.col("n")).alias(k) for k in generate.KINDS]).collect()
    assert tuple(got[0]) == ("", {}, [], [], [], [])
    assert tuple(got[1])[:5] == ("aaa", {0: 0, 1: 1, 2: 2}, [1, 1, 1], [1, 1, 1], [1.0, 1.0, 1.0])
    assert all(0 <= v < 100 for v in got[1].randints)
    for kind in generate.KINDS:
        assert generate.generate_rows(spark, kind, 5).count() == 5
    same = [generate.generate_rows(spark, "randints", 50, seed=4).collect() for _ in range(2)]
    assert same[0] == same[1]


def test_scale_series(spark):
    got = spark.range(9).select(generate.quarter_doublings(F.col("id")), generate.ten_to_the(F.col("id"))).collect()
    assert [r[0] for r in got] == [1, 1, 1, 1, 2, 2, 2, 3, 4]
    assert [r[1] for r in got] == [10**i for i in range(9)]


def test_unreadable_trace_elements_are_listed_and_the_rest_is_kept(spark):
    raw = spark.createDataFrame([
        (bytearray(80), '[[1.5, "x", 1, {}], [2.5], ["noon", "x", 2, {}], [3.5, "x", "done", {}]]', 0),
        (bytearray(80), "[]", 1), (bytearray(80), "7", 2), (bytearray(80), None, 3)], "key binary, value string, place int")
    kept = traces.decode_records(raw, index="place").collect()
    assert [(r.place, r.pos, r.timestamp, r.status) for r in kept] == [(0, 0, 1.5, 1)]
    lost = traces.rejected_records(raw).orderBy("place", "pos").collect()
    assert [(r.place, r.pos, r.reason) for r in lost] == [
        (0, 1, "fewer than four fields"), (0, 2, "timestamp is no number"), (0, 3, "status is no number"),
        (2, None, "value is no array"), (3, None, "value is no array")]


def test_timing_of_statistics_lines_is_kept(spark):
    text = 'BENCHMARK_STATS: {"config": {"a": 1}, "timing": {"sort": 1.25}}'
    got = traces.extract_stats(spark.createDataFrame([(text,)], "stdout string")).first().stats
    assert got.timing == {"sort": 1.25} and got.events is None


def test_array_chunks_keep_their_type(spark):
    from spanwell.operators import matrix

    df = spark.sql("select array(1, 2, 3) as x, array(named_struct('a', 1)) as y")
    got = df.select(matrix.chunk_array(F.col("x"), 2).alias("x"), matrix.chunk_array(F.col("y"), 2).alias("y"))
    assert got.schema["x"].dataType.simpleString() == "array<array<int>>"
    assert got.first().x == [[1, 2], [3]]


def test_metric_entries_are_sorted_behind_a_shuffle_only(spark):
    text = '{"workloads":[{"name":"a","description":"x"},{"name":"a","description":"y"},{"description":"z"}]}'
    found = configs.parse_metrics(spark.createDataFrame([(1, text), (2, text), (None, text)], "k bigint, value string"))
    assert sorted((r.k or 0, r.workload or "", r.description) for r in found.collect()) == [
        (k, *entry) for k in range(3) for entry in (("", "z"), ("a", "y"))]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" in plan and "SortAggregate" not in plan[plan.index("Exchange hashpartitioning(k"):]
