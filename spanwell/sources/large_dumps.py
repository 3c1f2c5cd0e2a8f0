"""Events of dumps that are one large JSON document each, read by several tasks a file.

Spark's reader parses a document that spans lines in one task. Here a file is cut into ranges of
bytes. Whether a range begins inside a string, and how deep, depends on all before it, so a first
scan says for both cases how a range changes depth, a window over the few ranges of a file adds
that up, a second scan finds where the array of events opens and closes, and a third one hands out
the elements that begin in each range.

``pos`` is the place of an element's first byte, which keeps the order of a dump. Elements that are
no objects are passed over; of several arrays of events in a document the first counts; empty
files and documents without events have no rows. Files must not be compressed. Paths are those
of a file system that all executors mount.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwell.session import settled
from spanwell.sources import listing
from spanwell.sources.logs import EVENT, parse_once

_EVENTS_KEY = re.compile(rb'(?<!\\)"events"\s*:\s*\Z')
_QUOTE, _BACKSLASH = 0x22, 0x5C
_ROWS = 10_000


def _read(file: str, start: int, size: int) -> bytes:
    with open(file, "rb") as source:
        source.seek(start)
        return source.read(size)


def _backslashes_before(file: str, start: int) -> int:
    """The length of the run of backslashes that ends directly before a place."""
    run, step = 0, 4096
    while start > run:
        size = min(step, start - run)
        part = _read(file, start - run - size, size)
        kept = len(part.rstrip(b"\\"))
        run += size - kept
        if kept:
            break
    return run


def _quotes(data: np.ndarray, backslashes: int) -> np.ndarray:
    """Places of quotes that are not escaped."""
    quotes = np.flatnonzero(data == _QUOTE)
    plain = np.flatnonzero(data != _BACKSLASH)
    last = np.searchsorted(plain, quotes)  # plain bytes before each quote; it is one itself
    run = np.where(last > 0, quotes - 1 - plain[np.maximum(last - 1, 0)], quotes + backslashes)
    return quotes[run % 2 == 0]


def _brackets(data: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets outside strings, and 1 where they open, -1 where they close."""
    folded = data | 0x20  # square brackets fall on curly ones
    places = np.flatnonzero((folded == 0x7B) | (folded == 0x7D))
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    return places, np.where(folded[places] == 0x7B, 1, -1)


def _scan(file: str, start: int, data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Brackets of a range that begins inside a string or not, and its number of quotes."""
    values = np.frombuffer(data, dtype=np.uint8)
    quotes = _quotes(values, _backslashes_before(file, start))
    places, steps = _brackets(values, quotes, inside)
    return places, steps, len(quotes)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range its number of quotes and its change of depth, begun outside and inside a string."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data = _read(r["file"], r["start"], r["size"])
            values = np.frombuffer(data, dtype=np.uint8)
            quotes = _quotes(values, _backslashes_before(r["file"], r["start"]))
            outside, within = (int(_brackets(values, quotes, i)[1].sum()) for i in (0, 1))
            rows.append({**r, "quotes": len(quotes), "outside": outside, "within": within})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
            ("quotes", pa.int64()), ("outside", pa.int64()), ("within", pa.int64())]))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where arrays of events open and where any value of the document itself closes."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data = _read(r["file"], r["start"], r["size"])
            places, steps, _ = _scan(r["file"], r["start"], data, r["inside"])
            depth = r["depth"] + np.cumsum(steps)
            for place in places[(steps == 1) & (depth == 2)].tolist():
                at = r["start"] + place
                key = _read(r["file"], max(0, at - 256), min(at, 256))
                if data[place] == ord("[") and _EVENTS_KEY.search(key):
                    rows.append((r["file"], at, True))
            rows += [(r["file"], r["start"] + p, False) for p in places[(steps == -1) & (depth == 1)].tolist()]
        files, at, opens = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(at, pa.int64()), pa.array(opens, pa.bool_())], ["file", "at", "opens"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that begin in a range; the last one is read to its end beyond the range."""
    for batch in batches:
        for r in batch.to_pylist():
            more = 0
            while True:
                data = _read(r["file"], r["start"], r["size"] + more)
                places, steps, _ = _scan(r["file"], r["start"], data, r["inside"])
                depth = r["depth"] + np.cumsum(steps)
                in_array = (places + r["start"] > r["opened"]) & (places + r["start"] < r["closed"])
                starts = places[in_array & (steps == 1) & (depth == 3)]
                ends = places[in_array & (steps == -1) & (depth == 2)]
                starts = starts[starts < r["size"]]
                # the end of an element that began in an earlier range
                ends = ends[ends > starts[0]] if len(starts) else ends[:0]
                if len(ends) >= len(starts) or len(data) < r["size"] + more:
                    break
                more = max(1 << 16, 2 * more)
            pairs = [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if data[a] == ord("{")]
            for i in range(0, len(pairs), _ROWS):
                part = pairs[i: i + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * len(part), pa.string()), pa.array([r["start"] + a for a, _ in part], pa.int64()),
                     pa.array([data[a: b + 1].decode("utf-8", "replace") for a, b in part], pa.string())],
                    ["file", "pos", "element"])


def read_events(spark: SparkSession, path: str, prefix: str | None = None, chunk: int = 8 << 20) -> DataFrame:
    """``file, pos`` and the fields of each event of all dumps below a folder, in ranges of ``chunk`` bytes."""
    files = listing.walk(spark, path, prefix).where("length > 0")
    ranges = settled(
        files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk).cast("bigint"))).alias("start"))
        .select("file", "start", F.least(F.lit(chunk), F.col("length") - F.col("start")).cast("bigint").alias("size")),
        "dump-ranges")
    # a range is much work for a short row: one task each, up to a bound
    tasks = min(max(ranges.count(), 1), 10_000)
    changes = ranges.repartition(tasks, "file", "start").mapInArrow(
        _changes, "file string, start bigint, size bigint, quotes bigint, outside bigint, within bigint")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int")
    change = F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("outside"))
    known = settled(
        changes.withColumn("inside", inside).withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).select("file", "start", "size", "inside", "depth"),
        "dump-depths")
    tops = settled(known.repartition(tasks, "file", "start").mapInArrow(_tops, "file string, at bigint, opens boolean"), "dump-arrays")
    opened = tops.where("opens").groupBy("file").agg(F.min("at").alias("opened"))
    arrays = tops.where("not opens").join(opened, "file").where("at > opened").groupBy("file", "opened").agg(F.min("at").alias("closed"))
    held = known.join(arrays, "file").where("start < closed and start + size > opened")
    elements = held.repartition(tasks, "file", "start").mapInArrow(_elements, "file string, pos bigint, element string")
    return parse_once(elements, F.struct(F.from_json("element", EVENT.removeprefix("struct<").removesuffix(">")).alias("event")),
                      ["file", "pos"]).select("file", "pos", "event.*")
