"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, proofs.

Time-forward processing over node labels ``(tree, level, index)``. A round's table of digests is the
external priority queue: Spark's shuffle sorts it by label and spills where it must, and delivers
the children of ``FAN ** LEVELS`` neighbouring places, a block, to the ancestors that they
meet in. A block's sweep sends one digest on to the next round, so a tree of n leaves takes
log n to the base ``FAN ** LEVELS`` rounds, each over a table that many times smaller, and
the hot group's leaves are spread over as many blocks as they fill. The reversed sweep goes through the
same tables from the root down: a block receives the proof suffix of its top node and
delivers to each child the siblings inside the block in front of it. No task holds more than one
block at a time, and nothing is collected but numbers of leaves and trees. Tables between the rounds are written by
as many tasks as the counted leaves need, not as there are shuffle partitions.

Trees: every ``FAN`` consecutive nodes (the last run may have fewer, even one) become the SHA-256 of their
hex digests, until one is left. Leaves of a group stand in ascending order of ``order`` (nulls first),
groups in ascending order of their value (null first, UTF-8 bytewise).

Defined cases: a null field counts as ``-``, an empty text as ``0:``; a null group is a group, a null order value
comes first; rows of equal order stand in order of their digests, so repeated rows are leaves of their own
beside each other; an empty table gives an empty manifest; texts of any length are hashed whole;
columns that are not named are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.operators.ordered import Running, gathered, ordered
from spanwell.session import settled

FAN = 3
#: Levels of a block; it has ``FAN ** LEVELS`` places.
LEVELS = 5
PLACES = FAN**LEVELS

#: A proof, from the leaf up: for each level the place in its run, the number of siblings, their digests.
Level = tuple[int, list[bytes]]


# -- digests ---------------------------------------------------------------------------------

def leaf(values: Sequence[Column]) -> Column:
    """The hex digest of a row: each value's UTF-8 length, ``:`` and the value, or ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(digests: Sequence[bytes]) -> bytes:
    """The digest of a run of digests, hashed as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def forward(digests: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """All nodes of a block by level, children first.

    Messages leave in order of their parents' labels, so the queue is first in, first out.
    """
    found: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue = deque((0, digest) for digest in digests)
    while queue:
        level, run = queue[0][0], []
        while queue and queue[0][0] == level and len(run) < FAN:
            run.append(queue.popleft()[1])
        found[level] += run
        if level < levels:
            queue.append((level + 1, joined(run)))
    return found


def block_levels(n: int) -> int:
    """How many levels a block of a tree of ``n`` nodes spans."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def paths(nodes: list[list[bytes]]) -> list[bytes]:
    """For each child of a block the siblings of its ancestors inside the block, encoded from the child up.

    The sweep runs from the top down; a node's proof is its own siblings and its parent's proof.
    """
    above = [b""]
    for level in range(len(nodes) - 2, -1, -1):
        here, row = [], nodes[level]
        for place in range(len(row)):
            start = place - place % FAN
            run = row[start: start + FAN]
            others = run[: place - start] + run[place - start + 1:]
            here.append(bytes([place - start, len(others)]) + b"".join(others) + above[place // FAN])
        above = here
    return above


def levels_of(proof: bytes) -> list[Level]:
    """A proof decoded, from the leaf up."""
    found, at = [], 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1]
        at += 2
        found.append((place, [proof[at + 32 * i: at + 32 * (i + 1)] for i in range(n)]))
        at += 32 * n
    return found


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for place, others in levels_of(proof):
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def siblings(proof: bytes) -> list[str]:
    """A proof's digests as hex text: level by level, in each from left to right."""
    return [d.hex() for _, others in levels_of(proof) for d in others]


# -- sweeps ----------------------------------------------------------------------------------

_NODE = "tree bigint, n bigint, position bigint, digest binary"
_MESSAGE = "tree bigint, position bigint, digest binary, suffix binary, subroot binary, root binary"


def _in_order(block: pa.Table) -> pa.Table:
    return block.take(pa.array(np.argsort(block.column("position").to_numpy(), kind="stable")))


def _by_block(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("position") / PLACES)).groupBy("tree", "block")


def _up(block: pa.Table) -> pa.Table:
    block = _in_order(block)
    n = block.column("n")[0].as_py()
    top = forward(block.column("digest").to_pylist(), block_levels(n))[-1][0]
    return pa.table({
        "tree": block.column("tree").slice(0, 1), "n": pa.array([-(-n // PLACES)], pa.int64()),
        "position": block.column("block").slice(0, 1).cast(pa.int64()), "digest": pa.array([top], pa.binary()),
    })


def _rounds(leaves: DataFrame, total: int) -> list[DataFrame]:
    """The tables of digests from the ``total`` leaves to one node for each tree (``tree, n, position, digest``)."""
    rounds = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        nodes = rounds[-1].select("tree", "n", "position", "digest")
        rounds.append(settled(gathered(_by_block(nodes).applyInArrow(_up, _NODE), total), "digests"))
        largest = -(-largest // PLACES)
    return rounds


def _down(children: DataFrame, messages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A message for each child, and its columns ``keep``, from the messages to the tops of the blocks."""
    fields = [children.schema[name] for name in keep]
    schema = T.StructType([*T.StructType.fromDDL(_MESSAGE).fields, *fields])

    def deliver(block: pa.Table, received: pa.Table) -> pa.Table:
        block = _in_order(block)
        digests = block.column("digest").to_pylist()
        suffix = received.column("suffix")[0].as_py()
        found = paths(forward(digests, block_levels(block.column("n")[0].as_py())))
        columns = {
            "tree": block.column("tree"), "position": block.column("position"), "digest": block.column("digest"),
            "suffix": pa.array([path + suffix for path in found], pa.binary()),
        }
        for name in ("subroot", "root"):
            columns[name] = pa.array([received.column(name)[0].as_py()] * len(digests), pa.binary())
        return pa.table(columns | {name: block.column(name) for name in keep})

    tops = messages.select("tree", F.col("position").alias("block"), "suffix", "subroot", "root").groupBy("tree", "block")
    return _by_block(children).cogroup(tops).applyInArrow(deliver, schema)


def manifest(docs: DataFrame, leaf_digest: Column, group: Column, order: Column, **keep: Column) -> DataFrame:
    """``leaf``, ``subroot``, ``root`` (hex), ``proof`` (binary, see ``levels_of``) and ``keep`` of every row.

    ``keep`` are further columns of the result by name, carried through.
    """
    kept = list(keep)
    if taken := {"tree", "n", "position", "digest", "block", "grp", "at", "ord", "suffix", "subroot", "root"} & set(kept):
        raise ValueError(f"kept columns need other names than {sorted(taken)}")
    rows = settled(docs.select(
        group.alias("grp"), order.alias("ord"), F.unhex(leaf_digest).alias("digest"), *(c.alias(name) for name, c in keep.items())
    ), "leaves")
    total = rows.count()
    counts = settled(gathered(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), total), "group-sizes")
    one = F.lit(1).cast("bigint")
    trees = settled(gathered(ordered(counts, [], ["grp"], gather=True).running(
        tree=Running("sum", one, through_row=False), first=Running("sum", F.col("n"), through_row=False)
    ).done().select(F.col("grp").alias("of_grp"), "n", "tree", "first"), total), "trees")
    placed = ordered(rows, [], ["grp", "ord", "digest"], gather=True).running(at=Running("sum", one, through_row=False)).done()
    # a row for each group; the planner measures it, and splits a hot group's rows where it can't be broadcast
    leaves = settled(gathered(placed.join(trees, F.col("grp").eqNullSafe(F.col("of_grp"))).select(
        "tree", "n", (F.col("at") - F.col("first")).alias("position"), "digest", *kept), total), "placed-leaves")

    inner = _rounds(leaves, total)
    n_trees = trees.count()
    outer = _rounds(inner[-1].select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("n"), F.col("tree").alias("position"), "digest"), n_trees)
    nothing = F.lit(None).cast("binary")
    messages = outer[-1].select("tree", "position", "digest", F.lit(b"").alias("suffix"), nothing.alias("subroot"), F.col("digest").alias("root"))
    for children in reversed(outer[:-1]):
        messages = _down(children, messages, [])
    messages = settled(gathered(messages, n_trees), "group-proofs").select(
        F.col("position").alias("tree"), F.lit(0).cast("bigint").alias("position"), "digest", "suffix", F.col("digest").alias("subroot"), "root")
    for children in reversed(inner[1:-1]):
        messages = settled(gathered(_down(children, messages, []), total), "block-proofs")
    if len(inner) > 1:
        found = gathered(_down(leaves, messages, kept), total)
    else:  # no tree has more than one leaf
        own = leaves.select("tree", "digest", *kept)
        found = own.join(messages.select("tree", "suffix", "subroot", "root"), "tree")
    return found.select(
        F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"),
        F.col("suffix").alias("proof"), *kept)


# -- the query's digests and the same in SQL ---------------------------------------------------

def verified(proofs: DataFrame, seen: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep``, ``proof_sha256``, ``folded_root`` of the hex digest ``seen`` (null: the leaf), and ``verified``."""
    schema = T.StructType([
        *(proofs.schema[name] for name in keep),
        *T.StructType.fromDDL("proof_sha256 string, folded_root string, verified boolean").fields,
    ])

    def run(batches):
        for batch in batches:
            digests, roots = [], []
            for own, other, proof in zip(*(batch.column(c).to_pylist() for c in ("leaf", seen, "proof"))):
                digests.append(hashlib.sha256("".join(siblings(proof)).encode()).hexdigest())
                roots.append(fold(bytes.fromhex(other or own), proof).hex())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in keep), pa.array(digests, pa.string()), pa.array(roots, pa.string()),
                 pa.array([a == b for a, b in zip(roots, batch.column("root").to_pylist())], pa.bool_())],
                [*keep, "proof_sha256", "folded_root", "verified"],
            )

    return proofs.select(*dict.fromkeys([*keep, "leaf", seen, "proof", "root"])).mapInArrow(run, schema)


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: The low bit of a decimal's CRC-32, bit by bit; the table has no null doc_id.
_SQL_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, {_SQL_CRC} % 2 = 0 AS tampers,
         {_sql_leaf("replace(text, chr(10), '')")} AS changed
  FROM documents),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position
  FROM leaves),
inner_nodes AS (
  SELECT tree, 0 AS level, CAST(position AS BIGINT) AS position, CAST(n AS BIGINT) AS n, leaf AS digest FROM numbered
  UNION ALL
  SELECT tree, level + 1, position // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY position))
  FROM inner_nodes WHERE n > 1 GROUP BY tree, level, n, position // {FAN}),
subroots AS (SELECT tree, digest AS subroot, level AS height FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, CAST(tree AS BIGINT) AS position, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, position // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY position))
  FROM outer_nodes WHERE n > 1 GROUP BY level, n, position // {FAN}),
steps AS (
  SELECT a.tree, a.level, a.position,
         coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position < a.position), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position > a.position), '') AS after
  FROM inner_nodes a JOIN inner_nodes b ON a.tree = b.tree AND a.level = b.level AND a.position // {FAN} = b.position // {FAN}
  WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, a.level, a.position,
         coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position < a.position), ''),
         coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position > a.position), '')
  FROM outer_nodes a JOIN outer_nodes b ON a.level = b.level AND a.position // {FAN} = b.position // {FAN}
  WHERE a.n > 1 GROUP BY ALL),
folds AS (
  SELECT doc_id, tree, CAST(position AS BIGINT) AS position, CAST(0 AS BIGINT) AS level, height, tree AS own,
         CASE WHEN tampers THEN changed ELSE leaf END AS digest, '' AS others, leaf
  FROM numbered JOIN subroots USING (tree)
  UNION ALL
  SELECT f.doc_id, CASE WHEN f.level < f.height THEN f.tree END,
         CASE WHEN f.level < f.height THEN f.position // {FAN} WHEN f.level = f.height THEN f.own // {FAN} ELSE f.position // {FAN} END,
         f.level + 1, f.height, f.own, sha256(s.before || f.digest || s.after), f.others || s.before || s.after, f.leaf
  FROM folds f JOIN steps s
    ON (f.level < f.height AND s.tree = f.tree AND s.level = f.level AND s.position = f.position)
    OR (f.level >= f.height AND s.tree IS NULL AND s.level = f.level - f.height
        AND s.position = CASE WHEN f.level = f.height THEN f.own ELSE f.position END)),
ends AS (SELECT doc_id, own, leaf, max_by(digest, level) AS folded_root, max_by(others, level) AS others FROM folds GROUP BY ALL)
SELECT doc_id, leaf, subroot, digest AS root, sha256(others) AS proof_sha256, folded_root, folded_root = digest AS verified
FROM ends JOIN subroots ON own = tree JOIN outer_nodes ON n = 1
"""
