"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits. Their bits are grouped so that correlated bits share a part, and
each part gets its own threshold: with m parts and a radius r, thresholds that add up to
r - m + 1 suffice, as two fingerprints within r must agree in some part up to its threshold.
The number of parts and the thresholds are those of least estimated cost, found by dynamic
programming over counts of all fingerprints. A part with threshold t is probed by masks that
leave out t of its bits: two fingerprints share a masked value exactly if they agree elsewhere
in the part. Fingerprints that meet are compared in full.

Equal fingerprints count as one from the start. Fingerprints that meet in a bucket are
compared inside tasks, and only a star of links leaves a bucket, never all its pairs; buckets
beyond a limit are cut into blocks (``common.blocks``), so nothing is dropped.

Defined cases: null and empty texts have the fingerprint zero and link like any other; a row
without a doc_id keeps its fingerprint and gets the smallest doc_id it reaches, or null;
repeated rows are answered each for itself; an empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwell.llm.common import as_bytes, blocks, column, components, runs, stars, whole_groups
from spanwell.session import settled

BITS = 64
#: Rows of one bucket that are compared in one block.
BLOCK = 4096
#: Cost of a probe (shuffled and sorted) against that of comparing one pair.
PROBE_COST = 100.0


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """A hash of each of the text's shingles; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    last = (ends - 1)[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), dtype=np.uint64, count=n
    )


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """Bit by bit the majority over the hashes of a text's shingles."""
    n = len(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 65536):
        part = hashes[start: start + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (bigint, the fingerprint's two's complement) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, width) for x in as_bytes(batch, "text")]
            values = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    chosen = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, fp bigint")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(values), 65536):
                data = values[start: start + 65536].astype(">i8").view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(data, axis=1).astype(np.float32)
                both += (bits.T @ bits).astype(np.float64)
        rows, columns = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows * BITS + columns), pa.array(both[rows, columns])], ["pair", "n"]
        )

    summed = distinct.select("fp").mapInArrow(run, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in summed.collect():  # 64 * 65 / 2 rows
        both[row.pair] = row.n
    both = both.reshape(BITS, BITS)
    return distinct.count(), both + np.triu(both, 1).T


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about equal size, correlated bits together.

    Bits are numbered from the most significant. Each group begins with the free bit
    most correlated with the others and takes the bits most correlated with the group.
    """
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tied[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def agreeing_share(n: int, both: np.ndarray, part: list[int], threshold: int) -> float:
    """The estimated share of pairs that differ in at most ``threshold`` bits of a part.

    Whether two fingerprints differ in a bit follows from the counts; correlation widens
    the spread of the number of differing bits, as if the part had fewer bits.
    """
    share = np.diag(both)[part] / max(n, 1)
    joint = both[np.ix_(part, part)] / max(n, 1)
    differ = 2 * share * (1 - share)
    # two bits differ both: (1,1 against 0,0) or (1,0 against 0,1), each in two orders
    only_a, only_b = share[:, None] - joint, share[None, :] - joint
    together = 2 * (joint * (1 - share[:, None] - share[None, :] + joint) + only_a * only_b)
    cov = together - np.outer(differ, differ)
    np.fill_diagonal(cov, differ * (1 - differ))
    alone = np.trace(cov)
    factor = max(1.0, cov.sum() / alone) if alone > 1e-12 else float(len(part))
    size, p = len(part) / factor, float(np.clip(differ.mean(), 1e-6, 1 - 1e-6))
    total, k = 0.0, 0
    while k <= min(threshold / factor, size) + 1e-9:
        choose = math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1)
        total += math.exp(choose + k * math.log(p) + (size - k) * math.log(1 - p))
        k += 1
    return min(1.0, total)


def plan_probes(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost; parts with threshold -1 are not probed."""
    best_cost, best, n = math.inf, [], max(n, 1)
    for m in range(1, radius + 2):
        parts = correlated_parts(n, both, m)
        budget = radius - m + 1
        # costs[k]: of the parts so far with thresholds that add up to k, and these thresholds
        costs: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in parts:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for t in range(-1, budget + m):
                if t < 0:
                    price = 0.0
                else:
                    masks = math.comb(len(part), t)
                    pairs = n * n / 2 * agreeing_share(n, both, part, t)
                    price = masks * n * PROBE_COST + pairs * math.comb(len(part), t)
                for used, (cost, chosen) in costs.items():
                    new = (cost + price, (*chosen, t))
                    if used + t not in after or new < after[used + t]:
                        after[used + t] = new
            costs = after
        cost, chosen = costs[budget]
        if cost < best_cost:
            best_cost, best = cost, list(zip(parts, chosen))
    return best


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits to compare, one mask for each choice of left-out bits, as signed 64-bit numbers."""
    found = []
    for part, threshold in plan:
        if threshold < 0:
            continue
        for left_out in combinations(part, threshold):
            mask = sum(1 << (BITS - 1 - b) for b in part if b not in left_out)
            found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def near_in_blocks(slot: np.ndarray, value: np.ndarray, near: np.ndarray, far: np.ndarray,
                   chunk: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius among the rows of each block; the rows are sorted by block."""
    starts, sizes = runs(slot, value, near, far)
    block = np.repeat(np.arange(len(starts)), sizes)
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        fits = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= radius) & ((near[i] == far[i]) | (chunk[i] != chunk[j]))
        left.append(fp[i[fits]])
        right.append(fp[j[fits]])

    small = np.flatnonzero(np.repeat(sizes <= 64, sizes))
    step = 1
    while len(small):
        small = small[small + step < len(fp)]
        small = small[block[small] == block[small + step]]
        keep(small, small + step)
        step += 1
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for at in range(start, start + size, 512):
            rows = np.arange(at, min(at + 512, start + size))
            others = np.arange(at, start + size)
            apart = np.bitwise_count((fp[rows, None] ^ fp[None, others]).view(np.uint64)) <= radius
            i, j = np.nonzero(apart)
            ahead = rows[i] < others[j]
            keep(rows[i[ahead]], others[j[ahead]])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links that join whatever pairs within the radius join, over distinct ``fp``."""
    n, both = bit_counts(distinct)
    chosen = masks(plan_probes(n, both, radius))
    probes = distinct.select(
        "fp", F.posexplode(F.array(*(F.lit(m).cast("bigint") for m in chosen))).alias("slot", "mask")
    ).select("fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    by = ["slot", "value", "near", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, by):
            data = {c: table.column(c).to_numpy() for c in (*by, "chunk", "fp")}
            a, b = stars(*near_in_blocks(*(data[c] for c in by), data["chunk"], data["fp"], radius))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = blocks(probes, ["slot", "value"], "fp", block)
    return met.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4,
                    radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row of ``docs``."""
    found = settled(fingerprints(docs, doc_id, text, width), "fingerprints")
    distinct = settled(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    joined = components(links(distinct, radius))
    rooted = settled(
        distinct.join(joined, distinct.fp == joined.node, "left").select(
            "fp", "first_id", F.coalesce("component", "fp").alias("root")
        ),
        "rooted",
    )
    least = settled(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    labels = settled(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return found.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
