"""Listing by directories, and the sink that commits batches."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanwell.sources import committed, listing

RECORDS = "file string, value string"


def test_listing_finds_hidden_and_empty_files_of_all_depths(spark, tmp_path):
    sizes = {"a.log": 3, "_hidden.log": 0, "d/.dot": 5, "d/e/f/a.log": 1, "d/e/a b+é.log": 7, ".s/a.log": 2}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "empty").mkdir()
    found = {os.path.relpath(r.file, tmp_path): r.length for r in listing.walk(spark, str(tmp_path)).collect()}
    assert found == sizes
    assert {os.path.basename(r.file) for r in listing.walk(spark, str(tmp_path), prefix="a").collect()} == {"a.log", "a b+é.log"}
    assert listing.walk(spark, str(tmp_path), recurse=False).count() == 2
    assert listing.walk(spark, str(tmp_path / "empty")).collect() == []


def records(spark, n, tag):
    return spark.range(n).select(
        F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.format_string('{"tag":"%s","n":%d}', F.lit(tag), "id").alias("value")).repartition(4)


def values(spark, path):
    return sorted((r.batch, r.file, r.value) for r in committed.read_committed(spark, path).collect())


def test_repeated_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "log")
    committed.append_batch(records(spark, 20, "old"), path, 0)
    committed.append_batch(records(spark, 50, "é\n"), path, 1)
    committed.append_batch(records(spark, 30, "new"), path, 0)
    found = values(spark, path)
    assert len(found) == 80 and len(set(found)) == 80
    assert {json.loads(v)["tag"] for b, _, v in found if b == 0} == {"new"}
    assert committed.committed(spark, path).agg(F.sum("records")).first()[0] == 80


def test_failed_and_retried_tasks_leave_no_record_twice_or_by_half(tmp_path):
    writer = committed._Writer(str(tmp_path), 4, ["file", "value"])

    def rows(n, fails=False):
        for i in range(n):
            yield Row(file="f", value=str(i))
        if fails:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows(3, fails=True))
    first, again = writer.write(rows(3)), writer.write(rows(3))
    writer.commit([again, None, writer.write(rows(0))])
    named = [json.loads(line) for line in (tmp_path / "manifests" / "4.json").read_text().splitlines()]
    assert named == [{"batch": 4, "part": again.name, "records": 3}] and first.name != again.name
    other = committed._Writer(str(tmp_path), 5, ["file", "value"])
    other.abort([other.write(rows(2)), None])
    assert not os.path.exists(tmp_path / "manifests" / "5.json") and os.listdir(tmp_path / "parts" / "batch=5") == []
