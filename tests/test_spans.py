"""Spans against hand-worked cases and a plain state machine."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanwell.operators import spans as S

SCHEMA = ("session string, seq bigint, worker_id string, task_id string, "
          "event_type string, status int, timestamp double")

WORKED = [
    (1, "D", "D", "benchmark:init", 1, 0.0),
    (2, "a", "1", "x", 1, 1.0),
    (3, "D", "D", "benchmark:init", 2, 10.0),
    (4, "a", "1", "x", 2, 10.5),
    (5, "a", "1", "x", 1, 11.0),
    (6, "D", "D", "benchmark:measure", 1, 12.0),
    (7, "a", "1", "x", 2, 13.0),
    (8, "b", "2", "y", 1, 14.0),
    (9, "D", "D", "benchmark:measure", 2, 20.0),
    (10, "b", "2", "y", 2, 22.0),
    (11, "b", "2", "y", 7, 23.0),
    (12, "c", "3", "z", 1, 24.0),
]


def events(spark, rows, session="s"):
    full = [(session, q, w, t, e, s, float(ts)) for q, w, t, e, s, ts in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_worked_case(spark):
    built = S.build_spans(events(spark, WORKED), order=["seq"])
    got = sorted(
        (r.start_phase or "", r.end_phase or "", r.event_type, r.elapsed, r.slipped)
        for r in built.spans.collect()
    )
    assert got == sorted([
        ("init", "init", "benchmark:init", 10.0, False),
        ("init", "init", "x", 9.5, True),
        ("", "measure", "x", 2.0, False),
        ("measure", "measure", "benchmark:measure", 8.0, False),
        ("measure", "", "y", 8.0, False),
    ])
    assert built.errors.count() == 0
    assert [(r.event_type, r.started) for r in built.open.collect()] == [("z", 24.0)]


def test_phase_columns(spark):
    rows = S.with_phase(events(spark, WORKED), ["session"], ["seq"]).orderBy("seq").collect()
    assert [r.phase for r in rows] == [
        "init", "init", "init", None, None, "measure", "measure", "measure", "measure",
        None, None, None]
    assert [r.phase_number for r in rows] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2]


def test_rule_breaks_are_reported_and_the_rest_goes_on(spark):
    rows = [
        (1, "a", "1", "x", 1, 0.0),
        (2, "a", "1", "x", 1, 1.0),
        (3, "a", "1", "x", 2, 3.0),
        (4, "a", "1", "x", 2, 4.0),
        (5, "a", "1", "y", 2, 4.0),
        (6, "D", "D", "benchmark:init", 5, 5.0),
        (7, "a", "1", "x", 9, 6.0),
    ]
    built = S.build_spans(events(spark, rows), order=["seq"])
    assert [r.elapsed for r in built.spans.collect()] == [2.0]
    assert sorted((r.seq, r.reason) for r in built.errors.collect()) == [
        (2, "already started"), (4, "finish without start"),
        (5, "finish without start"), (6, "unknown status")]


def test_zero_length_span_across_a_phase_end_is_no_slip(spark):
    rows = [
        (1, "D", "D", "benchmark:init", 1, 0.0),
        (2, "a", "1", "x", 1, 5.0),
        (3, "D", "D", "benchmark:init", 2, 5.0),
        (4, "a", "1", "x", 2, 5.0),
    ]
    got = S.build_spans(events(spark, rows), order=["seq"]).spans.where("event_type = 'x'").first()
    assert (got.start_phase, got.end_phase, got.slipped) == ("init", None, False)


def random_events(seed, n):
    """Valid start/finish alternation with overlapping phases and unknown statuses."""
    rng = random.Random(seed)
    opened, rows, now = {}, [], 0
    names = ["x", "y", "benchmark:init", "benchmark:measure"]
    for seq in range(n):
        now += rng.choice([0, 1, 1, 2, 5, 40])
        key = (rng.choice("ab"), rng.choice("12"), rng.choices(names, [4, 4, 1, 1])[0])
        if rng.random() < 0.05 and not key[2].startswith("benchmark:"):
            status = 3
        else:
            status = 2 if opened.get(key) else 1
            opened[key] = status == 1
        rows.append((seq, *key, status, float(now)))
    return rows


def state_machine(rows):
    phase, changed, number = None, None, 0
    begun, out = {}, defaultdict(list)
    for _, w, t, name, status, ts in rows:
        marks = name.startswith("benchmark:")
        if status == 1:
            if marks:
                phase, changed = name.split(":", 1)[1], ts
            begun[w, t, name] = (ts, phase, number)
        elif status == 2:
            ts0, phase0, number0 = begun.pop((w, t, name))
            end, took = phase, ts - ts0
            if end != phase0 and number == number0 + 1 and took > 0 and (ts - changed) / took < 0.1:
                end = phase0
            out[phase0, end, name].append(took)
            if marks:
                phase, changed, number = None, ts, number + 1
    return out


@pytest.mark.parametrize("limit", [10**6, 25])
def test_random_events_match_a_state_machine(spark, limit):
    everything, want = [], {}
    for seed in range(12):
        rows = random_events(seed, 150)
        session = "big" if seed == 0 else f"s{seed}"
        if seed == 0:
            rows = random_events(seed, 900)
        everything += [(session, *r[:1], *r[1:]) for r in rows]
        for key, took in state_machine(rows).items():
            want[(session, *key)] = took
    df = spark.createDataFrame(everything, SCHEMA).repartition(5)
    built = S.build_spans(df, order=["seq"], segment_rows=limit)
    got = S.span_stats(built.spans, ["session"]).collect()
    assert len(got) == len(want)
    for r in got:
        took = want[r.session, r.start_phase, r.end_phase, r.event_type]
        mean = sum(took) / len(took)
        assert r.ct == len(took)
        assert (r.min_elapsed_time, r.max_elapsed_time) == (min(took), max(took))
        assert math.isclose(r.total_elapsed_time, sum(took))
        assert math.isclose(r.avg_elapsed_time, mean)
        spread = math.sqrt(sum((x - mean) ** 2 for x in took) / len(took))
        assert math.isclose(r.stddev_elapsed_time, spread, abs_tol=1e-9)


def test_light_sessions_need_one_shuffle(spark):
    df = events(spark, WORKED)
    plan = S.build_spans(df, order=["seq"]).spans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_report_headline_and_document(spark):
    stats = S.span_stats(S.build_spans(events(spark, WORKED), order=["seq"]).spans, ["session"])
    report = [tuple(r) for r in S.span_report(stats, ["session"]).collect()]
    assert [r[1] for r in report] == sorted(r[1] for r in report)
    assert ("s", "None:measure:x",
            "2.000000,1,[2.000000,2.000000,2.000000],0.000000") in report
    assert [tuple(r) for r in S.headline(stats, ["session"]).collect()] == [("s", 8.0)]
    doc = S.stats_document(stats, ["session"]).select(
        F.get_json_object("document", "$.timing['init:init:x'].avg_elapsed_time")).first()[0]
    assert float(doc) == 9.5
