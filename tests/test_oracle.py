"""Every registered query against its SQL, also with keys cut into tiny segments."""

import pytest

from spanwell.operators.ordered import SEGMENT_ROWS_CONF
from spanwell.plans import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

# Queries that make an ordered pass and so have a segmented plan.
ORDERED = [
    "phase_state", "span_pairs", "phase_spans", "session_span_stats", "span_errors",
    "log_span_stats", "run_numbers", "failure_streaks", "run_outcomes", "run_continuation",
    "chunks", "chunk_sizes", "generated_words",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", ORDERED)
def test_segmented_query_equals_sql(spark, con, name):
    spark.conf.set(SEGMENT_ROWS_CONF, "10")
    try:
        assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None
    finally:
        spark.conf.unset(SEGMENT_ROWS_CONF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
