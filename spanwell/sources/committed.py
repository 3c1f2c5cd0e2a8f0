"""A sink for log records that is appended to in numbered, committed batches.

``df.write.format("committed_lines")`` writes each row's JSON line (column ``value``) and its group
(column ``file``) to part files of its batch; a task's file gets its name only when it is complete,
and the batch counts from the moment its manifest is there. A task that failed leaves a file that
no manifest names, a task that was retried leaves two of which the manifest names one, and a batch that is
written again under its number replaces itself. Readers see the files that manifests name, so no record twice
and none by half.

Paths are those of a file system that all executors mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "committed_lines"


@dataclass
class Written(WriterCommitMessage):
    """The file of a task and its number of records."""

    name: str | None
    records: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, batch: int, names: list[str]):
        self.path, self.batch, self.names = path, batch, names
        self.parts = os.path.join(path, "parts", f"batch={batch}")

    def write(self, iterator: Iterator) -> Written:
        """One task's rows; the file is renamed into place once all of them are on disk."""
        os.makedirs(self.parts, exist_ok=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        partial, records = os.path.join(self.parts, f".{name}"), 0
        with open(partial, "w", encoding="utf-8") as out:
            for row in iterator:
                out.write(json.dumps({n: row[n] for n in self.names}, ensure_ascii=False) + "\n")
                records += 1
            out.flush()
            os.fsync(out.fileno())
        if not records:
            os.unlink(partial)
            return Written(None, 0)
        os.rename(partial, os.path.join(self.parts, name))
        return Written(name, records)

    def commit(self, messages: list[Written | None]) -> None:
        """Name the files of the tasks that counted, in a manifest that appears as a whole."""
        folder = os.path.join(self.path, "manifests")
        os.makedirs(folder, exist_ok=True)
        partial = os.path.join(folder, f".{self.batch}-{uuid.uuid4().hex}")
        with open(partial, "w", encoding="utf-8") as out:
            for message in messages:
                if message is not None and message.name:
                    out.write(json.dumps({"batch": self.batch, "part": message.name, "records": message.records}) + "\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(partial, os.path.join(folder, f"{self.batch}.json"))

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what the tasks of a failed batch have left; an earlier commit of its number stays."""
        for message in messages:
            if message is not None and message.name:
                path = os.path.join(self.parts, message.name)
                if os.path.exists(path):
                    os.unlink(path)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options["batch"]), schema.names)


def append_batch(lines: DataFrame, path: str, batch: int) -> None:
    """Append log records (``file``, ``value``) as a numbered batch; the same number again replaces it."""
    lines.sparkSession.dataSource.register(CommittedLines)
    lines.select("file", "value").write.format(FORMAT).option("path", path).option("batch", str(batch)).mode("append").save()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``batch, part, records`` of all files that count."""
    return spark.read.schema("batch bigint, part string, records bigint").json(f"{path}/manifests")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """``batch, file, value`` of all records of committed batches, each once and whole."""
    parts = spark.read.schema("file string, value string").json(f"{path}/parts").select(
        "file", "value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("of_part"))
    named = committed(spark, path).select("batch", "part")
    return parts.join(named, F.col("of_part") == F.col("part")).select("batch", "file", "value")
