"""One-document dumps read by ranges of bytes, against Spark's reader and Python's."""

import json

import pytest
from pyspark.sql import functions as F

from spanwell.sources import large_dumps, traces

NASTY = ['}', ']', '"', '\\', '\\\\"', '{"events": [{', 'é\n', '', '\\"events\\": [']


def dump(n, tag):
    return {
        "config": {"events": [[1, {"a": "]"}]], "x": {"events": [{"timestamp": 1}]}, tag: NASTY[n % len(NASTY)]},
        "events": [
            {"timestamp": i / 2, "worker_id": NASTY[i % len(NASTY)], "task_id": tag, "event_type": "e" * (i % 90),
             "status": 1, "extras": {"deep": [{"k": NASTY[(i + 3) % len(NASTY)]}]}} for i in range(n)],
        "worker_ips": {"w": "10.0.0.1", "events": "["},
    }


@pytest.mark.parametrize("chunk", [61, 1000, 1 << 20])
def test_ranges_give_the_rows_of_whole_documents(spark, tmp_path, chunk):
    sizes = {"a.json": 40, "b.json": 0, "c.json": 23}
    for name, n in sizes.items():
        (tmp_path / name).write_text(json.dumps(dump(n, name), indent=1 if name == "c.json" else None, ensure_ascii=name == "a.json"))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"config": {}}')
    columns = ["file", "timestamp", "worker_id", "task_id", "event_type", "status"]
    got = large_dumps.read_events(spark, str(tmp_path), chunk=chunk)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    whole = traces.dump_events(traces.read_dumps(spark, [str(tmp_path / n) for n in sizes]))
    assert rows == sorted(tuple(r[c] for c in columns) for r in whole.collect()) and len(rows) == 63
    extras = {(r.file.split("/")[-1], r.timestamp): json.loads(r.extras) for r in got.collect()}
    assert extras == {(n, e["timestamp"]): e["extras"] for n, k in sizes.items() for e in dump(k, n)["events"]}
    in_order = got.where(F.col("file").endswith("a.json")).orderBy("pos").select("timestamp").collect()
    assert [r.timestamp for r in in_order] == [i / 2 for i in range(40)]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps(dump(500, "t")))
    found = large_dumps.read_events(spark, str(tmp_path), chunk=8192)
    spread = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 3 and sum(r["count"] for r in spread) == 500
