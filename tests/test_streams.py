"""Pairing and reports that go on from their state."""

import datetime
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanwell.operators import moments, rollup, spans
from spanwell.operators.ordered import SEGMENT_ROWS_CONF
from spanwell.plans import QUERIES, SQL
from spanwell.streaming import pairing
from tests.oracle import compare, connect

EVENTS = "session string, worker_id string, task_id string, event_type string, status int, timestamp bigint, seq bigint"


def some_events(seed, n):
    rng = random.Random(seed)
    kinds = ["load", "total", "benchmark:setup", "benchmark:measure"]
    at, rows = 0, []
    for seq in range(n):
        at += rng.choice([0, 1, 5, 400])
        rows.append((f"s{rng.randint(0, 3)}", "w", str(rng.randint(0, 1)), rng.choice(kinds), rng.choice([1, 1, 2, 2, 3]), at, seq))
    return rows


def fed(spark, tmp_path, rows, cuts, **options):
    """The stream's folder after one run, that is one start from its state, for each stretch of the rows."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        part = rows[low:high]
        random.Random(low).shuffle(part)
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        pairing.follow_spans(spark, stream, out, **options).awaitTermination()
    return out


@pytest.mark.parametrize("phases", [True, False])
def test_stream_equals_batch(spark, tmp_path, phases):
    rows = some_events(5, 400)
    out = fed(spark, tmp_path, rows, [150, 151, 300], phases=phases)
    built = spans.build_spans(spark.createDataFrame(rows, EVENTS), phases=phases)
    columns = ["session", "worker_id", "task_id", "event_type", "seq", "started", "finished", "elapsed", "start_phase", "end_phase", "slipped"]
    found = pairing.paired(spark, out)
    got = sorted(map(str, found.where("reason is null").select(*columns).collect()))
    assert got == sorted(map(str, built.spans.select(*columns).collect())) and len(got) > 40
    columns = ["session", "task_id", "event_type", "seq", "status", "reason"]
    got = sorted(map(str, found.where("reason is not null").select(*columns).collect()))
    assert got == sorted(map(str, built.errors.select(*columns).collect())) and len(got) > 40

    want = {tuple(r[:3]): r for r in spans.span_stats(built.spans).collect()}
    merged = moments.finished(pairing.latest_moments(spark, out)).collect()
    assert {tuple(r[:3]) for r in merged} == set(want)
    for r in merged:
        same = want[tuple(r[:3])]
        assert (r.ct, r.total_elapsed_time, r.min_elapsed_time, r.max_elapsed_time) == tuple(same[3:7])
        assert math.isclose(r.avg_elapsed_time, same.avg_elapsed_time, rel_tol=1e-9)
        assert math.isclose(r.stddev_elapsed_time, same.stddev_elapsed_time, rel_tol=1e-9, abs_tol=1e-9)


def test_late_events_change_nothing(spark, tmp_path):
    rows = [("s", "w", "1", "load", 1, 10, 1), ("s", "w", "1", "load", 1, 5, 2), ("s", "w", "1", "load", 2, 30, 3)]
    found = pairing.paired(spark, fed(spark, tmp_path, rows, [1])).collect()
    assert sorted((r.reason or "", r.elapsed) for r in found) == [("", 20), ("late", None)]


def test_heavy_sessions_and_any_order_column(spark, tmp_path):
    """Sessions cut into ranges give the same; the order may be of any type that sorts."""
    rows = some_events(11, 300)
    dated = EVENTS.replace("seq bigint", "seq date")
    rows = [(*r[:6], datetime.date(2020, 1, 1) + datetime.timedelta(r[6])) for r in rows]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.conf.set(SEGMENT_ROWS_CONF, "20")
    try:
        for low, high in ((0, 140), (140, 300)):
            spark.createDataFrame(rows[low:high], dated).write.mode("append").parquet(source)
            pairing.follow_spans(spark, spark.readStream.schema(dated).parquet(source), out).awaitTermination()
    finally:
        spark.conf.unset(SEGMENT_ROWS_CONF)
    built = spans.build_spans(spark.createDataFrame(rows, dated))
    found = pairing.paired(spark, out)
    columns = ["session", "task_id", "event_type", "seq", "elapsed", "start_phase", "end_phase", "slipped"]
    got = sorted(map(str, found.where("reason is null").select(*columns).collect()))
    assert got == sorted(map(str, built.spans.select(*columns).collect())) and len(got) > 30
    columns = ["session", "task_id", "event_type", "seq", "status", "reason"]
    got = sorted(map(str, found.where("reason is not null").select(*columns).collect()))
    assert got == sorted(map(str, built.errors.select(*columns).collect()))


@pytest.mark.parametrize("phases", [True, False])
def test_batch_equals_session_state(spark, phases):
    """A batch after a state, late and unknown events included, against the events one by one."""
    order = ["timestamp", "seq"]
    rows = some_events(21, 260)
    late = [(*r[:5], r[5] - 50_000, r[6]) for r in rows[150:200:5]]
    parts = [rows[:150], rows[150:] + late]
    columns = pairing.paired_schema(spark.createDataFrame(rows, EVENTS).schema, ["session"], order).fieldNames()
    state, sessions = None, {}
    for part in parts:
        paired = pairing.pair_batch(spark.createDataFrame(part, EVENTS), state, ["session"], order, phases).cache()
        found = pairing._results(paired, columns, spans.SLIP_SHARE)
        got = sorted(map(str, found.select("session", "task_id", "event_type", "seq", "reason", "elapsed", "start_phase", "end_phase").collect()))
        state = pairing._state_after(paired, ["session"], order, phases)
        want = []
        for r in sorted(part, key=lambda r: (r[5], r[6])):
            unit = r[0] if phases else r[:4]
            took = sessions.setdefault(unit, pairing.SessionState(None, phases, spans.SLIP_SHARE)).take(
                (r[1], r[2], r[3]), r[4], r[5], [r[5], r[6]])
            if took is not None:
                made = [took.get(c) for c in ("reason", "elapsed", "start_phase", "end_phase")]
                want.append(str(Row(*["session", "task_id", "event_type", "seq", "reason", "elapsed", "start_phase", "end_phase"])(
                    r[0], r[2], r[3], r[6], *made)))
        assert got == sorted(want) and len(got) > 40
    assert sum("late" in w for w in want) > 3


def test_keyed_state_gives_the_same_rows(spark, tmp_path):
    """The streaming DataFrame, with a sink of its own."""
    rows = some_events(31, 120)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pairing.STATE_STORE)
    try:
        for low, high in ((0, 60), (60, 120)):
            spark.createDataFrame(rows[low:high], EVENTS).write.mode("append").parquet(f"{tmp_path}/keyed-in")
            stream = pairing.stream_spans(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/keyed-in"))
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/keyed-at").trigger(
                availableNow=True).start(f"{tmp_path}/keyed").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    keyed = spark.read.parquet(f"{tmp_path}/keyed")
    tabled = pairing.paired(spark, fed(spark, tmp_path, rows, [60])).select(*keyed.columns)
    assert sorted(map(str, keyed.collect())) == sorted(map(str, tabled.collect())) and keyed.count() > 20


def test_session_state_survives_as_text():
    one = pairing.SessionState(None, True, 0.1)
    other = pairing.SessionState(None, True, 0.1)
    for row in some_events(9, 300):
        if row[0] != "s1":
            continue
        key, status, at, place = (row[1], row[2], row[3]), row[4], row[5], [row[5], row[6]]
        other = pairing.SessionState(other.text(), True, 0.1)
        assert one.take(key, status, at, place) == other.take(key, status, at, place)


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_moments_merge_for_any_split(spark, parts):
    rng = random.Random(parts)
    rows = [("a", "b", "c", 1e4 + rng.random(), rng.randrange(parts)) for _ in range(500)] + [("a", None, "c", 2.5, 0), (None, None, "d", None, 0)]
    df = spark.createDataFrame(rows, "start_phase string, end_phase string, event_type string, elapsed double, part int")
    merged = moments.merge_moments(moments.merge_moments(moments.partial_moments(df, ["part"]), ["part"]).drop("part"))
    got = {r[:3]: r[3:] for r in map(tuple, moments.finished(merged).collect())}
    want = {r[:3]: r[3:] for r in map(tuple, spans.span_stats(df).collect())}
    assert set(got) == set(want)
    for key, figures in want.items():
        for a, b in zip(got[key], figures):
            assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", ["followed_span_stats", "kept_revisions"])
def test_log_state_deals_its_rows_by_their_number(spark, monkeypatch, name):
    """No task of the log state sorts more events than a fixed number, and the result stays that of the SQL."""
    made, sf = [], "/root/testdata/sf0.001"

    def noted(found, make=rollup.log_span_stats):
        made.append((found.runs().agg(F.sum("n_events")).first()[0], make(found)))
        return made[-1][1]

    monkeypatch.setattr("spanwell.plans.inputs.SPREAD_ROWS", 100, raising=False)
    monkeypatch.setattr("spanwell.operators.ordered.TASK_ROWS", 200, raising=False)
    monkeypatch.setattr(rollup, "log_span_stats", noted)
    assert compare(spark, connect(sf), sf, QUERIES[name], SQL[name]) is None
    (events, stats), = made
    assert events > 1_000 and stats.rdd.getNumPartitions() >= events / 200
