"""Near-duplicates by the Jaccard similarity of whole shingle sets.

The minima of a text's shingle hashes under many hash functions are its signature; bands of
``ROWS`` minima are its buckets. The number of bands and the least number of equal minima
follow from the wanted recall for a pair just at the threshold. Nothing is linked on
signatures: every link is a pair whose whole sets of shingles were compared.

Fingerprints come first: sets whose SimHash fingerprints (``simhash``, over the same shingles) are linked
within its radius are compared. Pairs at the threshold mostly differ in more bits than that radius, so
signatures find the rest.

Equal sets count as one from the start. Then each set is compared with the smallest one of
each of its buckets, where their signatures agree enough, which links most groups with a pair or two
for each set. Of buckets that still hold several components, the sets with an undecided partner of another
component go to the buckets' blocks (``common.blocks``); there all such pairs are compared,
and only links that join components leave, fewer than a block has sets. A pair that meets in several
bands is compared in the first one.

Defined cases: null and empty texts are equal, and near no other; a row without a doc_id gets the
smallest doc_id it reaches, or null; repeated rows are answered each for itself; texts of any length are
whole sets; an empty table gives an empty table. Other columns are not read, and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwell.llm.common import as_bytes, blocks, column, components, fresh, runs, whole_groups
from spanwell.llm.simhash import links as near_fingerprints
from spanwell.llm.simhash import majority, shingle_hashes
from spanwell.session import forget, settled

#: Minima in a band.
ROWS = 5
#: Rows of one bucket that are compared in one block.
BLOCK = 512
#: Bits that spare texts a shuffle: 8 MB in all, whatever the number of documents.
FILTER_BITS = 1 << 26
# Fixed value: the bits of one bitmap.
BITMAP = 1 << 15


def make_plan(threshold: float, recall: float) -> tuple[int, int]:
    """Bands, and how many minima at least must agree; each may cause half of the misses allowed."""
    missed = (1 - recall) / 2
    bands = math.ceil(math.log(missed) / math.log(1 - threshold**ROWS))
    n, tail, least = bands * ROWS, 0.0, bands * ROWS + 1
    while tail < 1 - missed:
        least -= 1
        tail += math.comb(n, least) * threshold**least * (1 - threshold) ** (n - least)
    return bands, least


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles in ascending order."""
    return np.unique(shingle_hashes(text, width))


def minima(shingles: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """The least value of a set's shingles (one at least) under each of ``n`` hash functions."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
    factor = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None] | np.uint32(1)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), 2048):
        np.minimum(least, ((short[None, start: start + 2048] ^ flip) * factor).min(axis=1), out=least)
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets that are not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketches(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """``node`` (a hash of the whole set), ``fp`` (the fingerprint), ``bands`` and ``signature`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, values, signatures = [], [], [], []
            for text in as_bytes(batch, "text"):
                hashes = shingle_hashes(text, width)
                found = np.unique(hashes)
                prints.append(majority(hashes))
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                least = minima(found, bands * ROWS) if len(found) else np.zeros(0, np.uint32)
                values.append([xxhash.xxh64_intdigest(least[at: at + ROWS].tobytes()) - (1 << 63) for at in range(0, len(least), ROWS)])
                signatures.append(least.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                 pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(values, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "text_key", "node", "fp", "bands", "signature"],
            )

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, fp bigint, bands array<bigint>, signature binary")


def _bit(doc_id: Column, text_key: Column) -> tuple[Column, Column]:
    """The bitmap, and the place in it, of a row's key."""
    at = F.pmod(F.xxhash64(doc_id, text_key), F.lit(FILTER_BITS))
    return F.floor(at / BITMAP).cast("bigint"), at % BITMAP


def _marks(keys: DataFrame) -> DataFrame:
    """``part, bits``: bitmaps that have the bits of all ``doc_id, text_key``; FILTER_BITS / BITMAP rows at most."""
    part, place = _bit(F.col("doc_id"), F.col("text_key"))
    placed = keys.select(part.alias("part"), place.alias("place")).repartition("part")
    return settled(placed.groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits")), "marks")


def _marked(docs: DataFrame, marks: DataFrame, doc_id: Column, text_key: Column, how: str) -> DataFrame:
    """Rows of ``docs`` with their bit set (``left_semi``) or not (``left_anti``).

    A row with an unset bit is surely none of the keys; one with a set bit is asked by an exact join. With many
    more keys than bits all rows go to that join.
    """
    part, place = _bit(doc_id, text_key)
    of, bits = fresh(docs, "part"), fresh(docs, "bits")
    byte = F.conv(F.hex(F.substr(column(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = (part == column(of)) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return docs.join(F.broadcast(marks.toDF(of, bits)), met, how)


def _whole_sets(nodes: DataFrame, distinct: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of some nodes, made again from one of their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = [shingle_set(text, width).tobytes() for text in as_bytes(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    asked = settled(distinct.select("node", "rep").join(nodes, "node").select(
        "node", F.col("rep.doc_id").alias("of_doc"), F.col("rep.text_key").alias("of_key")), "compared-nodes")
    met = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key"))
    marks = _marks(asked.select(F.col("of_doc").alias("doc_id"), F.col("of_key").alias("text_key")))
    near = _marked(docs, marks, F.col("doc_id"), F.col("text_key"), "left_semi")
    # they grow with the documents, so they are not broadcast, however few there are
    texts = near.join(asked.hint("merge"), met).select("node", "text")
    return settled(texts.mapInArrow(sets, "node bigint, shingles binary").dropDuplicates(["node"]), "shingle-sets")


def _fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of sets that join whatever equal and near fingerprints join; fewer than there are sets and links."""
    prints = settled(distinct.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    equal = distinct.join(prints, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = near_fingerprints(prints.select("fp")).toDF("fp", "fp_b")
    near = near.join(prints, "fp").select(F.col("head").alias("a"), F.col("fp_b").alias("fp"))
    return equal.unionByName(near.join(prints, "fp").select("a", F.col("head").alias("b")))


def _agreeing(pairs: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose signatures agree in ``least`` minima or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(len(batch), -1) for c in ("of_a", "of_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    first = pairs.join(distinct.select(F.col("node").alias("a"), F.col("signature").alias("of_a")), "a")
    both = first.join(distinct.select(F.col("node").alias("b"), F.col("signature").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _compared(pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose whole sets reach the threshold."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                small, large = sorted((len(x), len(y)))
                kept.append(small >= threshold * large and similarity(x, y) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    first = pairs.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = first.join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(near, "a bigint, b bigint")


_PLACE = ["band", "value", "near", "far"]


def _in_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, int, int, "Partners"]]:
    """Each block of members sorted by place: its table, start, size, and who may be near whom in it."""
    for table in whole_groups(batches, _PLACE):
        keys = [table.column(c).to_numpy() for c in _PLACE]
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype="<u2").reshape(table.num_rows, -1)
        chunk = table.column("chunk").to_numpy()
        for start, size in zip(*(x.tolist() for x in runs(*keys))):
            rows = slice(start, start + size)
            sides = chunk[rows] if keys[2][start] != keys[3][start] else None
            yield table, start, size, Partners(signature[rows], sides, int(keys[0][start]), least)


class Partners:
    """The pairs of a block that are compared in it."""

    def __init__(self, signature: np.ndarray, sides: np.ndarray | None, band: int, least: int):
        self.signature, self.sides, self.band, self.least = signature, sides, band, least

    def after(self, at: int, label: np.ndarray) -> np.ndarray:
        """Later rows of other labels that agree enough with one, and first meet it in this band."""
        others = at + 1 + np.flatnonzero(label[at + 1:] != label[at])
        if self.sides is not None:
            others = others[self.sides[others] != self.sides[at]]
        equal = self.signature[others] == self.signature[at]
        near = equal.sum(axis=1) >= self.least
        others, before = others[near], equal[near, : self.band * ROWS]
        return others[~before.reshape(len(others), self.band, ROWS).all(axis=2).any(axis=1)]


def _undecided(members: DataFrame, least: int, block: int) -> DataFrame:
    """The members of blocks that have a partner of another component there; each with its block."""
    columns = ["node", "label", "signature", "chunk", *_PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start, size, partners in _in_blocks(batches, least):
            label = table.column("label").to_numpy()[start: start + size]
            asked = np.zeros(size, dtype=bool)
            for at in range(size - 1):
                others = partners.after(at, label)
                if len(others):
                    asked[at] = True
                    asked[others] = True
            if asked.any():
                yield from table.slice(start, size).filter(pa.array(asked)).select(columns).combine_chunks().to_batches()

    met = blocks(members, ["band", "value"], "node", block)
    schema = "node bigint, label bigint, signature binary, chunk int, band int, value bigint, near int, far int"
    return met.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(run, schema)


def joins(sets: list[np.ndarray], label: np.ndarray, partners: Partners, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows at the threshold that join labels; at most one less than there are rows."""
    label, found = label.copy(), []
    sizes = np.array([len(s) for s in sets])
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(int(words.max()) + 1 if len(words) else 0, dtype=bool)
    for at in range(len(sets) - 1):
        others = partners.after(at, label)
        if not len(others):
            continue
        own = words[ends[at] - sizes[at]: ends[at]]
        marked[own] = True
        both = np.array([np.count_nonzero(marked[words[ends[i] - sizes[i]: ends[i]]]) for i in others])
        marked[own] = False
        for i in others[both >= threshold * (sizes[at] + sizes[others] - both)]:
            if label[i] != label[at]:
                found.append((at, int(i)))
                label[label == label[i]] = label[at]
    return found


def _joined(undecided: DataFrame, whole: DataFrame, least: int, threshold: float) -> DataFrame:
    """Links ``a``, ``b`` at the threshold that join the components of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start, size, partners in _in_blocks(batches, least):
            node, label = (table.column(c).to_numpy()[start: start + size] for c in ("node", "label"))
            sets = [np.frombuffer(v, dtype=np.uint64) for v in table.column("shingles").slice(start, size).to_pylist()]
            links = joins(sets, label, partners, threshold)
            if links:
                a, b = (node[list(x)] for x in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = undecided.join(whole, "node")
    return rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "node").mapInArrow(run, "a bigint, b bigint")


def _components(docs: DataFrame, width: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Tables of ``doc_id, text_key, node`` for every row and of ``node, root`` for every set."""
    bands, least = make_plan(threshold, recall)
    sketches = settled(_sketches(docs, width, bands), "sketches")
    distinct = settled(
        sketches.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_key")).alias("rep"),
            F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "distinct-sets",
    )
    rows = settled(sketches.select("doc_id", "text_key", "node"), "row-sets")
    forget(sketches)
    placed = distinct.select("node", F.posexplode("bands").alias("band", "value"))
    heads = settled(
        placed.groupBy("band", "value").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = settled(
        placed.join(heads.drop("n"), ["band", "value"]).select("node", "band", "value", "head"), "bucket-members")
    pairs = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    first = settled(_fingerprint_pairs(distinct).unionByName(_agreeing(pairs, distinct, least)).distinct(), "first-pairs")
    whole = _whole_sets(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), distinct, docs, width)
    links = settled(_compared(first, whole, threshold), "first-links")
    forget(whole, first)
    joined = components(links)
    labelled = settled(
        members.join(joined, "node", "left").select("node", "band", "value", F.coalesce("component", "node").alias("label")),
        "labelled-members",
    )
    mixed = settled(labelled.groupBy("band", "value").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("low < high and n > 2").select("band", "value"), "mixed-buckets")
    several = labelled.join(mixed, ["band", "value"]).join(distinct.select("node", "signature"), "node")
    several = settled(several.select("node", "band", "value", "label", "signature"), "mixed-members")
    forget(labelled, members, heads)
    undecided = settled(_undecided(several, least, block), "undecided")
    whole = _whole_sets(undecided.select("node").distinct(), distinct, docs, width)
    links = settled(links.unionByName(_joined(undecided, whole, least, threshold)), "links")
    forget(whole, undecided, several, mixed)
    roots = components(links)
    return rows, settled(
        distinct.select("node").join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("root")), "rooted")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")).withColumn(
        "text_key", F.xxhash64("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    threshold: float = 0.8, recall: float = 0.999, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``component_id`` of every row: components of the pairs at the threshold or above."""
    rows, rooted = _components(_keyed(docs, doc_id, text), width, threshold, recall, block)
    found = rows.join(rooted, "node")
    low = settled(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(low, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                threshold: float = 0.8, recall: float = 0.999, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that of the smallest doc_id, and rows without one.

    Of rows of one doc_id in a component that of the smallest text hash stays, and of rows equal in both the
    one of the smallest hash over all columns.
    """
    rows, rooted = _components(_keyed(docs, doc_id, text), width, threshold, recall, block)
    named = settled(
        rows.where("doc_id is not null").join(rooted, "node").groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")),
        "named-rows")
    kept = settled(named.groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("kept")).select("kept.*"), "kept-rows")
    # rows whose key neither goes nor is repeated stay where they are, the others ask the kept rows
    marks = _marks(named.join(kept.where("n = 1").hint("merge"), ["doc_id", "text_key"], "left_anti"))
    row_id, row_key = column(doc_id).cast("bigint"), F.xxhash64(column(text))
    known = docs.where(column(doc_id).isNotNull())
    alone = _marked(known, marks, row_id, row_key, "left_anti")
    asked = _marked(known, marks, row_id, row_key, "left_semi")
    id_, key, n = (fresh(docs, name) for name in ("kept_id", "kept_key", "kept_n"))
    kept = kept.toDF(id_, key, n)
    met = (row_id == column(id_)) & (row_key == column(key))
    # the kept rows grow with the documents, so they are not broadcast, however few there are
    once = asked.join(kept.where(column(n) == 1).hint("merge"), met, "left_semi")
    whole = F.struct(*(column(c) for c in docs.columns))
    repeated = asked.join(kept.where(column(n) > 1), met, "left_semi").groupBy(column(doc_id), F.xxhash64(column(text))).agg(
        F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*")
    return alone.unionByName(once).unionByName(repeated).unionByName(docs.where(column(doc_id).isNull()))
