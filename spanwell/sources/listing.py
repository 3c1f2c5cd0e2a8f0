"""A reader that lists files: its partitions are directories, its rows are files.

Spark's file readers list on the driver, hide names that begin with ``_`` or ``.``, and give no row
for an empty file. Here directories are the rows of a table: each round lists the directories of one
depth as a distributed scan, writes what it has found, and the directories in it are the next round's rows. The
driver holds no file name, only the number of rounds, and hidden and empty files are found.

Paths are those of a file system that all executors mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwell.session import settled

ENTRY = "file string, length bigint, is_folder boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of folders, a bounded number at a time; a folder that has gone has none."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names, sizes, folders = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(folders, pa.bool_())],
            ["file", "length", "is_folder"])

    rows: list[tuple] = []
    for given in batches:
        for folder in given.column("folder").to_pylist():
            try:
                found = os.scandir(folder)
            except (FileNotFoundError, NotADirectoryError):
                continue
            with found:
                for entry in found:
                    inner = entry.is_dir(follow_symlinks=False)
                    rows.append((entry.path, 0 if inner else entry.stat().st_size, inner))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
    if rows:
        yield batch(rows)


def walk(spark: SparkSession, path: str, prefix: str | None = None, recurse: bool = True) -> DataFrame:
    """``file, length`` of every file below a folder whose name begins with ``prefix``; links to folders are not followed."""
    folders = spark.createDataFrame([(os.path.join(path, ""),)], "folder string")
    levels: list[DataFrame] = []
    while True:
        found = settled(folders.mapInArrow(_entries, ENTRY), "listing")
        levels.append(found.where("not is_folder").select("file", "length"))
        inner = found.where("is_folder").select(F.col("file").alias("folder"))
        if not recurse or inner.isEmpty():
            break
        # spread by name: neighbours in one folder do not stay in the task that found them
        folders = inner.repartition(F.col("folder"))
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    if prefix:
        files = files.where(F.startswith(F.element_at(F.split("file", "/"), -1), F.lit(prefix)))
    return files
