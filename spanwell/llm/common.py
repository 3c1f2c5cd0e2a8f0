"""What the operators share: free names, Arrow batches, hot groups cut into blocks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwell.session import settled


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_bytes(batch: pa.RecordBatch, name: str, step: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, a few rows at a time in Python's memory."""
    texts = batch.column(name)
    for start in range(0, len(texts), step):
        yield from texts.slice(start, step).cast(pa.large_binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, of batches that are sorted by ``by``."""
    held: list[pa.RecordBatch] = []

    def last_start(batch: pa.RecordBatch) -> int:
        """Where the last group of the batch begins."""
        differs = np.zeros(len(batch), dtype=bool)
        for name in by:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            differs |= values != values[-1]
        found = np.flatnonzero(differs)
        return int(found[-1]) + 1 if len(found) else 0

    def same_group(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(n)[len(a) - 1].as_py() == b.column(n)[0].as_py() for n in by)

    for batch in batches:
        if not len(batch):
            continue
        if held and not same_group(held[-1], batch):
            yield pa.Table.from_batches(held)
            held = []
        cut = last_start(batch)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and how long they are."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def blocks(df: DataFrame, key: list[str], item: str, limit: int) -> DataFrame:
    """``df`` with ``near``, ``far`` and ``chunk``: the blocks in which a group's pairs meet.

    A group of at most ``limit`` rows is one block. A larger one is cut into
    chunks by a hash of ``item``, and every two chunks make a block, so that each
    pair of rows still meets in exactly one block and no task holds a whole hot
    group. In a block of two chunks only rows of different chunks are a pair.
    """
    spark_key = [column(k) for k in key]
    counts = df.groupBy(*spark_key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
    heavy = settled(
        counts.select(*(k.alias(f"heavy_{i}") for i, k in enumerate(spark_key)),
                      F.ceil(F.col("size") / limit).cast("int").alias("chunks")),
        "heavy-groups",
    )
    met = None
    for i, k in enumerate(spark_key):
        same = k.eqNullSafe(F.col(f"heavy_{i}"))
        met = same if met is None else met & same
    chunk = F.pmod(F.xxhash64(column(item)), F.col("chunks")).cast("int")
    pairs = F.when(
        F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("near"), F.lit(0).alias("far")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda other: F.struct(
                F.least(other, F.col("chunk")).alias("near"), F.greatest(other, F.col("chunk")).alias("far")
            ),
        )
    )
    cut = df.join(heavy, met, "left").select(
        *(column(c) for c in df.columns), "chunks", F.coalesce(chunk, F.lit(0)).alias("chunk")
    )
    return cut.select(
        *(column(c) for c in df.columns), "chunk", F.explode(pairs).alias("block")
    ).select(*(column(c) for c in df.columns), "chunk", "block.near", "block.far")


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked item and the smallest item that its links reach, itself left out."""
    ids, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[: len(left)], places[len(left):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the smallest node that each node of ``links`` reaches.

    Nodes are bigints; a null or a node linked with itself adds nothing. Large and
    small stars alternate until the edges no longer change: in every round each
    node's neighbours move to its smallest neighbour. All steps are aggregations
    with partial sums and joins of two written tables, which Spark splits where a
    node has many neighbours; nothing is collected. Smallest nodes themselves are
    not listed.
    """
    x, y = column(a).cast("bigint"), column(b).cast("bigint")
    edges = settled(
        links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settled(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "low")
        large = settled(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(),
            "large-stars",
        )
        low = settled(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        moved = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = settled(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "small-stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
