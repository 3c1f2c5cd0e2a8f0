"""Log files on disk: reading, rollups, reports, revisions, following."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spanwell.operators import history, metrics, rollup
from spanwell.plans.inputs import log_lines
from spanwell.session import settled
from spanwell.sources import configs, logs, writers
from spanwell.streaming import follow

# Own measurements: studies that ingest batches of rows and scan them.
CONFIG = {"workloads": [
    {"name": "scan_study", "description": "Plain scans of one batch", "key_metrics": [
        {"name": "rows held", "expression": {"expression_type": "value", "value": "batch_rows"}}]},
    {"name": "join_study", "description": "Joins of growing width", "key_metrics": [
        {"name": "evenness", "expression": {"expression_type": "frac_values",
            "numer": "ingest_min_elapsed_time", "denom": "ingest_max_elapsed_time"}},
        {"name": "worst ingest", "expression": {"expression_type": "value", "value": "ingest_max_elapsed_time"}}],
     "cols": {"failures_ct": "lost", "ingest_min_elapsed_time": "quickest",
              "ingest_avg_elapsed_time": "typical"}},
]}


def header(ts, name, nodes, workers, revs=None):
    data = {
        "experiment_name": "e1",
        "system_config": {"num_workers": workers, "num_nodes": nodes, "shm_size": "1G", "mem_size": None},
        "workload": {"name": name, "workload_script": "w.py", "iteration_target": 10},
    }
    if revs:
        data["git-revs"] = {"framework": revs[0], "benchmark": revs[1]}
    return {"type": "experiment", "timestamp": ts, "data": data}


def run(iteration, success=True, config=None, spans=(), stats=True):
    events = []
    for name, start, took in spans:
        for status, at in ((1, start), (2, start + took)):
            events.append({"timestamp": at, "worker_id": -1, "task_id": -1, "event_type": name,
                           "status": status, "extras": {}})
    found = {"config": config or {}, "events": events} if stats else {}
    return {"type": "finish_work", "timestamp": 1.0, "data": {
        "iteration": iteration, "success": success, "elapsed_time": 1.0, "stats": found}}


REVS = ("aaaaaaaaaa", "bbbbbbbbbb")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs") / "e1"
    write(base / "20160101_000000/join_study_1_100_1G.log", [
        header(1000.0, "join_study", 1, 100, REVS),
        {"type": "start_work", "timestamp": 1.0, "data": {"iteration": 0, "pid": 1}},
        run(0, config={"batch_rows": 1}, spans=[("ingest", 5.0, 0.5)]),
        {"type": "killed", "timestamp": 1.0, "data": {"pid": 1, "waited_time": 31.5}},
        run(1, success=False, stats=False),
        {"type": "waiting", "timestamp": 1.0, "data": {"pid": 1, "time_waited": 10.0}},
        run(2, config={"batch_rows": 2}, spans=[("ingest", 8.0, 1.5)]),
        run(3, success=False, stats=False)])
    write(base / "20160101_000000/scan_study_1_10_1G.log", [
        header(2000.0, "scan_study", 1, 10),
        run(0, config={"batch_rows": 1000}, spans=[("ingest", 1.0, 0.25), ("total", 3.0, 1.0)]),
        run(1, stats=False)])
    write(base / "20160102_000000/join_study_1_100_1G.log", [
        header(3000.0, "join_study", 1, 100, REVS),
        run(0, config={"batch_rows": 64}, spans=[("ingest", 1.0, 1.0)]), "{broken"])
    write(base / "20160102_000000/nohdr_1_1_1G.log", [run(0, config={"batch_rows": 1})])
    write(base / "20160102_000000/twohdr_1_1_1G.log", [
        header(1.0, "twohdr", 1, 1), header(2.0, "twohdr", 1, 1)])
    return str(base)


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def short(file):
    return "/".join(file.split("/")[-2:]).replace("201601", "").replace("_000000", "").replace("_1G.log", "")


def test_rollup(spark, folder):
    found = rollup.rollup(logs.read_logs(spark, folder))
    got = {short(r.file): (r.fail_ct, r.max_success_iteration,
                           (r.max_success_workload_config or {}).get("batch_rows"), r.timestamp)
           for r in found.rollups.collect()}
    assert got == {
        "01/join_study_1_100": (2, 2, "2", 1000.0),
        "01/scan_study_1_10": (0, 1, "1000", 2000.0),
        "02/join_study_1_100": (0, 0, "64", 3000.0)}
    assert {short(r.file): r.reason for r in found.rejected.collect()} == {
        "02/nohdr_1_1": "no experiment record", "02/twohdr_1_1": "duplicate experiment record"}
    bad = logs.read_logs(spark, folder).rejected().collect()
    assert [(short(r.file), r.value) for r in bad] == [("02/join_study_1_100", "{broken")]


def test_revisions_are_null_unless_both_are_given(spark, folder):
    heads = {short(r.file): (r.framework_rev, r.benchmark_rev)
             for r in rollup.headers(logs.read_logs(spark, folder)).collect()}
    assert heads["01/join_study_1_100"] == REVS
    assert heads["01/scan_study_1_10"] == (None, None)


def test_span_stats(spark, folder):
    stats = {(short(r.file), r.event_type): r for r in
             rollup.log_span_stats(logs.read_logs(spark, folder)).collect()}
    s = stats["01/join_study_1_100", "ingest"]
    assert (s.ct, s.total_elapsed_time, s.min_elapsed_time, s.max_elapsed_time,
            s.avg_elapsed_time, s.stddev_elapsed_time) == (2, 2.0, 0.5, 1.5, 1.0, 0.5)
    assert stats["01/scan_study_1_10", "total"].avg_elapsed_time == 1.0
    cut = rollup.log_span_stats(logs.read_logs(spark, folder), segment_rows=1).collect()
    assert sorted(map(str, cut)) == sorted(map(str, stats.values()))


def test_unique_revisions_rank_before_rejecting(spark, folder, tmp_path):
    kept = rollup.unique_revisions(logs.read_logs(spark, folder))
    files = {short(r.file) for r in kept.records("experiment").select("file").distinct().collect()}
    assert files == {"01/join_study_1_100", "01/scan_study_1_10", "02/twohdr_1_1"}
    write(tmp_path / "a.log", [header(1.0, "w", 1, 1, REVS), header(1.0, "w", 1, 1, REVS)])
    write(tmp_path / "b.log", [header(2.0, "w", 1, 1, REVS)])
    chosen = rollup.unique_revisions(logs.read_logs(spark, str(tmp_path)))
    assert rollup.rollup(chosen).rollups.count() == 0


def test_file_order_is_a_sorted_walk(spark, tmp_path):
    write(tmp_path / "a" / "x.log", [header(1.0, "w", 1, 1)])
    write(tmp_path / "a.log", [header(2.0, "w", 1, 1)])
    first = rollup.first_per_revision(rollup.headers(logs.read_logs(spark, str(tmp_path))))
    assert [r.file.endswith("/a/x.log") for r in first.collect()] == [True]


def test_prefix_and_no_recursion(spark, folder, tmp_path):
    def names(**options):
        rows = logs.read_log_lines(spark, folder, **options).select("file").distinct().collect()
        return {short(r.file) for r in rows}

    assert names(prefix="scan") == {"01/scan_study_1_10"}
    write(tmp_path / "top.log", [header(1.0, "w", 1, 1)])
    write(tmp_path / "sub" / "deep.log", [header(1.0, "w", 1, 1)])
    flat = logs.read_log_lines(spark, str(tmp_path), recurse=False).select("file").distinct().collect()
    assert [r.file.split("/")[-1] for r in flat] == ["top.log"]


def test_odd_path_characters(spark, tmp_path):
    write(tmp_path / "a +b%41.log", [header(1.0, "w", 1, 1)])
    rows = logs.read_log_lines(spark, str(tmp_path)).select("file").collect()
    assert rows[0].file == str(tmp_path / "a +b%41.log")


def test_summary_has_four_rows_per_measurement_and_two_per_file(spark, folder):
    done = rollup.analyse(logs.read_logs(spark, folder))
    table = rollup.summary_table(done.rollups, done.stats)
    assert table.count() == 4 * 4 + 2 * 3
    row = table.where("measurement = 'ingest' and stat = 'avg' and workload = 'scan_study'").first()
    assert (row.value, row.framework_rev, row.num_workers) == (0.25, None, 10)
    assert table.where("framework_rev = 'aaaaaaa'").count() == 4 * 2 + 2 * 2


@pytest.fixture(scope="module")
def config(spark):
    return configs.parse_metrics(spark.createDataFrame([(json.dumps(CONFIG),)], "value string"))


def test_key_metrics(spark, folder, config):
    done = rollup.analyse(logs.read_logs(spark, folder))
    values = metrics.stat_values(done.rollups, done.stats)
    got = sorted((r.workload, r.timestamp, r.metric, r.value)
                 for r in metrics.key_metrics(done.rollups, values, config).collect())
    assert got == [
        ("join_study", "19700101 00:16:40", "evenness", pytest.approx(1 / 3)),
        ("join_study", "19700101 00:16:40", "worst ingest", 1.5),
        ("join_study", "19700101 00:50:00", "evenness", 1.0),
        ("join_study", "19700101 00:50:00", "worst ingest", 1.0),
        ("scan_study", "19700101 00:33:20", "rows held", 1000.0)]


def test_trend(spark, folder, config):
    done = rollup.analyse(logs.read_logs(spark, folder))
    values = metrics.stat_values(done.rollups, done.stats)
    long = metrics.trend(done.rollups, values, config)
    wide = metrics.metric_table(
        long.where("workload = 'join_study'"), "label",
        ["lost", "quickest", "typical"])
    assert [tuple(r) for r in wide.collect()] == [
        ("19700101 00:16:40", "aaaaaaa", "bbbbbbb", "join_study", 100, 1, 2.0, 0.5, 1.0),
        ("19700101 00:50:00", "aaaaaaa", "bbbbbbb", "join_study", 100, 1, 0.0, 1.0, 1.0)]
    labels = {r.label for r in long.where("workload = 'scan_study'").collect()}
    assert labels == {f"{m}_{s}" for m in ("ingest", "total") for s in rollup.REPORTED} | {
        "success_iteration_max", "failures_ct"}


def test_unknown_metric_form_is_an_error(spark):
    df = spark.sql("select map('a','1') as s, named_struct('expression_type','ratio','numer','a',"
                   "'denom','a','value','a') as e")
    with pytest.raises(Exception, match="unknown metric expression: ratio"):
        df.select(metrics.eval_metric(F.col("s"), F.col("e"))).collect()


def test_config_entry_wins_over_a_measurement_of_the_same_name(spark):
    rollups = spark.sql(
        "select 'f' as file, 1L as max_success_iteration, 0L as fail_ct, "
        "map('failures_ct', 'mine', 'x', '2') as max_success_workload_config")
    stats = spark.sql(
        "select 'f' as file, null as start_phase, 'p' as end_phase, 'x' as event_type, 1L as ct, "
        "1D as min_elapsed_time, 1D as max_elapsed_time, 1D as avg_elapsed_time")
    got = {r.name: (r.kind, r.text, r.value) for r in metrics.stat_values(rollups, stats).collect()}
    assert got["failures_ct"] == ("config", "mine", None)
    assert got["None:p:x_ct"] == ("measure", "1.0", 1.0)


def test_waits(spark, folder):
    rows = history.wait_summary(logs.read_logs(spark, folder)).collect()
    assert [(short(r.file), r.killed, r.waiting, r.longest_wait) for r in rows] == [
        ("01/join_study_1_100", 1, 1, 31.5)]


def test_layout_from_path(spark, folder):
    rows = logs.read_log_lines(spark, folder).select(
        *writers.log_path_parts(F.col("file"))).distinct().collect()
    assert ("e1", "20160101_000000", "join_study", 1, 100, "1G") in [tuple(r) for r in rows]


def test_large_file_read_in_blocks_keeps_line_order(spark, tmp_path):
    records = [header(1.0, "w", 1, 1)] + [
        run(i, config={"n": i}, spans=[("s", float(i), 0.5)]) for i in range(3000)]
    write(tmp_path / "big.log", records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        found = logs.read_logs(spark, str(tmp_path))
        assert found.lines.select("block").distinct().count() > 3
        assert rollup.log_span_stats(found).first().ct == 3000
        assert rollup.log_span_stats(found, segment_rows=100).first().ct == 3000
        assert rollup.rollup(found).rollups.first().max_success_workload_config == {"n": "2999"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_following_equals_one_pass(spark, folder, config, tmp_path):
    import shutil

    inbox, out = tmp_path / "in", str(tmp_path / "out")
    shutil.copytree(folder + "/20160101_000000", inbox / "d1")
    follow.follow_logs(spark, str(inbox), out, config).awaitTermination()
    assert follow.followed(spark, out, "rollups").count() == 2
    shutil.copytree(folder + "/20160102_000000", inbox / "d2")
    follow.follow_logs(spark, str(inbox), out, config).awaitTermination()
    whole = rollup.rollup(logs.read_logs(spark, str(inbox))).rollups
    columns = ["file", "fail_ct", "max_success_iteration", "workload"]
    kept = follow.followed(spark, out, "rollups").select(*columns)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    latest = writers.read_latest(spark, f"{out}/latest")
    assert sorted(r.value for r in latest.collect()) == [pytest.approx(1 / 3), 1.5, 1000.0]


def lines_of(spark, *records):
    rows = [("f", 0, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return logs.Logs(spark.createDataFrame(rows, "file string, block bigint, line bigint, value string"))


def test_malformed_values_are_listed_with_a_reason(spark):
    found = lines_of(
        spark,
        header(1.0, "scan_study", 1, 2),
        {"type": "finish_work", "timestamp": 1.0, "data": 7},
        {"type": "finish_work", "timestamp": 1.0, "data": {"iteration": "first", "success": True}},
        {"type": "finish_work", "timestamp": 1.0, "data": {"iteration": 1, "success": "maybe"}},
        {"type": "finish_work", "timestamp": 1.0, "data": {"iteration": 2, "success": True, "stats": {
            "events": [{"timestamp": "noon", "event_type": "ingest", "status": 1},
                       {"timestamp": 2.0, "event_type": "ingest", "status": 2}]}}},
        {"type": "killed", "timestamp": "late", "data": {"pid": 1}},
        "{broken",
        run(3))
    assert [(r.line, r.reason) for r in found.rejected().orderBy("line").collect()] == [
        (1, "data is no object"), (2, "iteration is no number"), (3, "success is neither true nor false"),
        (4, "event time is no number"), (5, "timestamp is no number"), (6, "no record")]
    assert [r.timestamp for r in logs.run_events(found).collect()] == [2.0]


def test_a_run_without_a_success_has_failed(spark):
    found = lines_of(spark, header(1.0, "scan_study", 1, 2), run(0, success=None), run(1, success=False), run(2, success=None))
    assert rollup.rollup(found).rollups.first().fail_ct == 3
    runs = spark.createDataFrame([("k", 0, None), ("k", 1, False), ("k", 2, None)], "k string, i int, success boolean")
    done = history.run_outcomes(runs, ["k"], ["i"], F.lit(2)).first()
    assert (done.num_successes, done.num_failures, done.iteration_end_reason) == (0, 2, history.FAILED_END)


def test_empty_files_are_rejected(spark, tmp_path):
    write(tmp_path / "a.log", [header(1.0, "scan_study", 1, 2)])
    (tmp_path / "nothing here.log").write_text("")
    got = rollup.rollup(logs.read_logs(spark, str(tmp_path))).rejected.collect()
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in got] == [("nothing here.log", "empty file")]


def test_stored_logs_give_the_same_reports(spark, folder):
    plain = logs.read_logs(spark, folder)
    kept = logs.stored(plain)
    assert logs.stored(kept) is kept
    both = [(rollup.rollup(x).rollups.drop("experiment"), rollup.rollup(x).rejected, rollup.log_span_stats(x),
             logs.run_events(x).drop("line"), x.records("killed", "waiting").drop("line"), rollup.headers(x)) for x in (plain, kept)]
    for a, b in zip(*both):
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_reports_parse_the_text_once(spark, folder):
    """Only making the store reads JSON; what reports read of it is pruned."""
    kept = logs.stored(logs.read_logs(spark, folder))
    for df in (rollup.rollup(kept).rollups, rollup.log_span_stats(kept), kept.records("killed")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan
    plan = rollup.rollup(kept).rollups._jdf.queryExecution().executedPlan().toString()
    assert "events" not in plan


def test_wide_rows_are_sorted_behind_a_shuffle_only(spark, folder):
    """Neither parsing nor wide aggregates sort what a scan task reads, as that grows with the files."""
    kept = logs.stored(logs.read_logs(spark, folder))
    assert not [p for p in os.listdir(kept.path) if p.startswith("kind=")]
    found = rollup.analyse(kept)
    for table in (rollup.headers(kept), metrics.stat_values(found.rollups, found.stats)):
        plan = table._jdf.queryExecution().sparkPlan().toString()
        assert "SortAggregate" in plan and "Exchange hashpartitioning(file" in plan
        below = plan[plan.index("Exchange hashpartitioning(file"):]
        assert "SortAggregate" not in below and "Sort [" not in below


def test_report_rows_are_dealt_by_their_number(spark, monkeypatch):
    done = rollup.analyse(logs.Logs(log_lines(spark, "/root/testdata/sf0.001")))
    values = settled(metrics.stat_values(done.rollups, done.stats), "values")
    plain = (values, rollup.summary_table(done.rollups, done.stats))
    monkeypatch.setattr("spanwell.operators.ordered.TASK_ROWS", 20)
    n_stats, n_values = done.stats.count(), values.where("kind in ('measure', 'trend')").count()
    many = (metrics.stat_values(done.rollups, done.stats), rollup.summary_table(done.rollups, done.stats))
    assert many[0].rdd.getNumPartitions() >= values.count() / 20 > spark.sparkContext.defaultParallelism
    for a, b in zip(plain, many):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    config = configs.parse_metrics(spark.createDataFrame([('{"workloads": []}',)], "value string"))
    trend = metrics.trend(done.rollups, values, config)
    for table, n in ((many[1], n_stats), (trend, n_values)):
        plan = table._jdf.queryExecution().sparkPlan().toString()
        assert f", {-(-n // 20)}), REPARTITION_BY_NUM" in plan
