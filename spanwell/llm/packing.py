"""Documents packed into sequences of token ids: concatenate and cut.

Two passes. The first encodes every text where it lies and writes its ids with the number of the task that
read it and the ids of that task before it; the tasks' totals, a row each, are summed up
in order of their numbers. A document's ids then begin at its task's sum plus its own, and windows of a fixed length cut
the one long row of ids. The second pass goes through the written ids in order: a window whose ids all lie in
the rows at hand is a sequence at once, and only what is left at the ends of a run of rows becomes a
boundary record. Boundary records of one window, at most one for each id, are put together by
a shuffle. Nothing else is shuffled, and a document of any length is cut as it comes.

All sequences but the last one are full. That one is filled with ``pad_id``, unless its length
is a power of two.

Defined cases: a null or empty text has just the end id; a document without an id has a null one;
repeated rows are documents of their own; an empty table gives no sequences; columns that are not
named are not read, and may have any name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwell.llm.token_files import by_size, shared_vocabulary, word_tokens
from spanwell.session import settled

LENGTH = 2048
#: Sequences that a task holds before it passes them on.
HELD = 256
#: Words that a worker remembers in each of two generations.
REMEMBERED = 400_000

PIECE = "struct<doc_id bigint, start bigint, length bigint, doc_tokens bigint, offset bigint>"
_RECORD = f"sequence_id bigint, whole boolean, offset bigint, ids binary, pieces array<{PIECE}>"
_PIECE_ARROW = pa.struct([(name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "offset")])


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id, ids, n`` of every document, and ``task, before``: who read it, and how many ids before it.

    The numbers hold only for this one reading, so they are written together with the ids.
    """
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens = word_tokens(shared)
            tokens.remembered = REMEMBERED
            for part in by_size(batch, "text"):
                ids = [found + end for found in tokens.encode_column(part.column("text"))]
                n = np.array([len(found) // 4 for found in ids], dtype=np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n),
                     pa.array(np.full(len(ids), task, dtype=np.int64)), pa.array(ends - n)],
                    ["doc_id", "ids", "n", "task", "before"],
                )
                before = int(ends[-1])

    asked = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))
    return settled(asked.mapInArrow(run, "doc_id bigint, ids binary, n bigint, task bigint, before bigint"), "token-ids")


def placed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``at``: how many ids stand before each document in all tasks."""
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(totals.select(
        F.col("task").alias("of_task"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("task_start")), "task-starts")
    # a row for each task of one stage, so some megabytes at most; the ids themselves must not move
    met = F.broadcast(starts) if starts.count() <= 4_000_000 else starts
    return tokens.join(met, F.col("task") == F.col("of_task")).select(
        "doc_id", "ids", "n", (F.col("task_start") + F.col("before")).alias("at"))


def cut(rows: Iterator[tuple[int | None, bytes, int]], length: int) -> Iterator[tuple[int, bool, int, bytes, list]]:
    """Windows of consecutive documents (``doc_id, ids, at``): number, whether it is whole, offset, ids, pieces."""
    window, first, next_at = 0, 0, None
    held: list[bytes] = []
    pieces: list[tuple] = []

    def close(end: int) -> tuple[int, bool, int, bytes, list]:
        return window, end - first == length, first - window * length, b"".join(held), pieces

    for name, ids, at in rows:
        n = len(ids) // 4
        if at != next_at:  # another run of rows
            if pieces:
                yield close(next_at)
            held, pieces, first, window = [], [], at, at // length
        start = 0
        while start < n:
            take = min(n - start, (window + 1) * length - (at + start))
            held.append(ids[4 * start: 4 * (start + take)])
            pieces.append((name, start, take, n, at + start - window * length))
            start += take
            if at + start == (window + 1) * length:
                yield close(at + start)
                held, pieces, first, window = [], [], at + start, window + 1
        next_at = at + n
    if pieces:
        yield close(next_at)


def sequences(
    docs: DataFrame, vocabulary: str, end_id: int, doc_id: Column, text: Column, length: int = LENGTH, pad_id: int = 0
) -> DataFrame:
    """``sequence_id, ids`` (32-bit little-endian, filled up) and ``pieces`` of every sequence.

    A piece says which document it is of, where it begins there, its length, all ids of the document, and its
    place in the sequence.
    """
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(_PIECE_ARROW)]
    names = [field.split(" ")[0] for field in ("sequence_id", "whole", "offset", "ids", "pieces")]
    fields = [f.name for f in _PIECE_ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, bytes, int]]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    yield from zip(*(part.column(c).to_pylist() for c in ("doc_id", "ids", "at")))

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = [list(column) for column in zip(*found)]
            columns[4] = [[dict(zip(fields, piece)) for piece in pieces] for pieces in columns[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

        found: list[tuple] = []
        for window in cut(rows(), length):
            found.append(window)
            if len(found) == HELD:
                yield out(found)
                found = []
        if found:
            yield out(found)

    records = settled(
        placed(tokenized(docs, vocabulary, end_id, doc_id, text)).select("doc_id", "ids", "at").mapInArrow(run, _RECORD), "windows")
    whole = records.where("whole").select("sequence_id", "ids", "pieces")
    parts = records.where("not whole").groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("parts"))
    nothing, more = F.lit(b""), F.col("parts")
    met = parts.select(
        "sequence_id",
        F.aggregate(more, nothing, lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
        F.flatten(F.transform(more, lambda part: part["pieces"])).alias("pieces"))
    n = F.octet_length("ids") / 4
    padded = F.rpad("ids", F.lit(4 * length), F.lit(struct.pack("<I", pad_id)))
    power = F.bit_count(n.cast("bigint")) == 1
    return whole.unionByName(met.select("sequence_id", F.when(power, F.col("ids")).otherwise(padded).alias("ids"), "pieces"))


def pieces(packed: DataFrame) -> DataFrame:
    """A row for each piece of the sequences, with its ``ids``."""
    each = packed.select("sequence_id", F.col("ids").alias("all_ids"), F.explode("pieces").alias("piece"))
    ids = F.substring(F.col("all_ids"), F.col("piece.offset").cast("int") * 4 + 1, F.col("piece.length").cast("int") * 4)
    return each.select("piece.doc_id", "piece.start", "piece.length", "piece.doc_tokens", "sequence_id", "piece.offset", ids.alias("ids"))
