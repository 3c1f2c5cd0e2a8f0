"""Merkle manifest against a plain tree built in order."""

import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanwell.llm import merkle
from spanwell.llm.queries import QUERIES, SQL
from spanwell.operators import ordered
from spanwell.session import settled
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    values = [None if v is None else str(v) for v in row]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_proofs(digests):
    """Root, and each node's siblings and places level by level."""
    steps, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 3):
            run = nodes[at: at + 3]
            for place, (_, members) in enumerate(run):
                others = [d for i, (d, _) in enumerate(run) if i != place]
                for member in members:
                    steps[member].append((place, others))
            above.append((digest("".join(d for d, _ in run)), [m for _, members in run for m in members]))
        nodes = above
    return (nodes[0][0] if nodes else None), steps


def plain_manifest(rows):
    """``(doc_id, leaf, subroot, root, proof digest, folded root, verified)`` of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    for found in groups.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {name: plain_proofs([plain_leaf(r) for r in groups[name]]) for name in names}
    root, above = plain_proofs([trees[name][0] for name in names])
    out = []
    for name, upper in zip(names, above):
        subroot, steps = trees[name]
        for row, own in zip(groups[name], steps):
            seen = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                seen = (*row[:4], row[4].replace("\n", ""))
            at = plain_leaf(seen)
            for place, others in own + upper:
                at = digest("".join([*others[:place], at, *others[place:]]))
            proof = digest("".join(d for _, others in own + upper for d in others))
            out.append((row[0], plain_leaf(row), subroot, root, proof, at, at == root))
    return out


def query_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).repartition(3).withColumn("tree", F.lit(1)).withColumn("changed", F.lit(2)).write.parquet(
        f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()]


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 4], [243, 244, 1], [729, 10, 2187 + 5]])
def test_trees_of_all_heights(spark, tmp_path, sizes):
    rows = [(i * 7 % 10_007, f"s{j}", "en", i, f"a\nb {i}") for j, n in enumerate(sizes) for i in range(n)]
    assert by_text(query_rows(spark, rows, tmp_path)) == by_text(plain_manifest(rows))


def test_many_groups(spark, tmp_path):
    rows = [(i, f"é{i % 300}", None, None, "x\n" if i % 3 else None) for i in range(700)]
    assert by_text(query_rows(spark, rows, tmp_path)) == by_text(plain_manifest(rows))


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 3, "\n"), (4, None, "", 0, ""),
        (4, "", "de", -1, "one\ntwo"), (4, "", "de", -1, "one\ntwo"), (4, "", "de", 5, "-"), (-12, "ab", "en", 1, "1:a" * 400_000),
        (2**62, "aé", "en", 1, "漢\n"), (7, "a", "en", 1, "\n\n"),
    ]
    found = query_rows(spark, rows, tmp_path)
    assert by_text(found) == by_text(plain_manifest(rows))
    assert any(not r[-1] for r in found) and sum(r[-1] for r in found) >= 5


def test_small_tables_are_few_files(spark, tmp_path, monkeypatch):
    """Also where the planner does not merge partitions, a table is not a file for each shuffle partition."""
    written = {}

    def noted(df, name, *rest):
        table = settled(df, name, *rest)
        written.setdefault(name, []).append(len(list(Path(table.settled_at).glob("part-*"))))
        return table

    for module in (merkle, ordered):
        monkeypatch.setattr(module, "settled", noted)
    confs = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in confs}
    rows = [(i * 7 % 10_007, f"s{i % 30}" if i % 2 else "hot", "en", i, f"a\nb {i}") for i in range(3_000)]
    try:
        for name, value in confs.items():
            spark.conf.set(name, value)
        found = query_rows(spark, rows, tmp_path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert by_text(found) == by_text(plain_manifest(rows))
    assert len(written["digests"]) >= 2 and len(written["ranges"]) == 2
    assert max(map(max, written.values())) <= spark.sparkContext.defaultParallelism


def test_empty_table(spark, tmp_path):
    assert query_rows(spark, [], tmp_path) == []


def test_query_equals_sql(spark):
    name = "op11_merkle_manifest"
    assert compare(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


def test_proofs_are_kept_whole_and_notice_any_change(spark):
    rows = [(i, "s", "en", 1, str(i)) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    found = merkle.manifest(docs, merkle.leaf([F.col("text")]), F.col("source"), F.col("doc_id"), doc_id=F.col("doc_id")).collect()
    for r in found:
        assert merkle.fold(bytes.fromhex(r.leaf), r.proof).hex() == r.root
        levels = merkle.levels_of(bytes(r.proof))
        assert len(levels) == 6 and levels[0][0] == r.doc_id % 3
        assert merkle.fold(bytes.fromhex(r.subroot), r.proof).hex() != r.root


def test_names_in_use(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "x")], DOCS)
    with pytest.raises(ValueError):
        merkle.manifest(docs, merkle.leaf([F.col("text")]), F.col("source"), F.col("doc_id"), tree=F.col("doc_id"))
