"""Documents of derived files stay bounded, also for one hot user."""

import json

from spanwell.plans import source_queries as sources
from spanwell.plans import SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_dumps_of_a_hot_user_are_bounded(spark):
    events = spark.range(1000).selectExpr("id AS event_id", "7L AS user_id", "'x' AS event_type")
    sizes = [len(json.loads(r.value)["events"]) for r in sources._event_dumps(events, 100).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100


def test_sweeps_are_bounded(spark):
    parts = spark.range(1000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size")
    sizes = [len(json.loads(r.value)["system_configs"]) for r in sources._sweep_configs(parts, 100).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200


def test_many_documents_of_a_folder_are_read(spark, monkeypatch):
    for name in ("_event_dumps", "_sweep_configs"):
        made = getattr(sources, name)
        monkeypatch.setattr(sources, name, lambda df, made=made: made(df, 50))
    for name in ("dump_files", "sweep_config_files"):
        assert compare(spark, connect(SF), SF, getattr(sources, name), SQL[name]) is None
