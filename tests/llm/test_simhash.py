"""SimHash against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanwell.llm import simhash
from spanwell.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{row number: smallest reachable id} of (id, fingerprint) rows, pair by pair."""
    n = len(rows)
    low = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for a in range(n):
            for b in range(n):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 4 and low[b] < low[a]:
                    low[a], moved = low[b], True
    return low


def test_fingerprints():
    rng = random.Random(1)
    words = ["Ab", "é", "ÉCOLE", "x\x1cy", "\xa0", "tHe", "1"]
    cases = [None, "", " \n\t", "one", "a b c", "a b c d", *(
        rng.choice([" ", "\n", "\x0b "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150))]
    assert [simhash.fingerprint(None if c is None else c.encode()) for c in cases] == [plain_fingerprint(c) for c in cases]


@pytest.mark.parametrize("n_parts", [1, 2, 3, 4, 5])
def test_thresholds_that_add_up_find_every_near_pair(n_parts):
    rng = random.Random(n_parts)
    bits = list(range(64))
    rng.shuffle(bits)
    parts = [bits[i::n_parts] for i in range(n_parts)]
    thresholds = [0] * n_parts
    for _ in range(max(0, 3 - n_parts + 1)):  # radius 3
        thresholds[rng.randrange(n_parts)] += 1
    if n_parts == 5:
        thresholds[rng.randrange(5)] = -1
    chosen = simhash.masks(list(zip(parts, thresholds)))
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert any((x ^ y) & (m & (2**64 - 1)) == 0 for m in chosen)


def test_correlated_bits_share_a_part_and_plans_are_sound():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (2000, 64)).astype(float)
    for a, b in ((3, 50), (7, 20)):
        bits[:, b] = bits[:, a]
    both = bits.T @ bits
    parts = simhash.correlated_parts(2000, both, 4)
    assert sorted(sum(parts, [])) == list(range(64))
    for a, b in ((3, 50), (7, 20)):
        assert any(a in p and b in p for p in parts)
    for n in (0, 1, 2000, 10**6, 10**8):
        plan = simhash.plan_probes(n, both, 4)
        assert sum(t for _, t in plan) == 4 - len(plan) + 1


@pytest.mark.parametrize("block", [8, 4096])
def test_links_over_crowded_fingerprints(spark, block):
    """Fingerprints in a few crowds, where buckets are large and cut into blocks."""
    rng = random.Random(3)
    crowds = [rng.getrandbits(64) for _ in range(3)]
    values = set()
    while len(values) < 250:
        x = rng.choice(crowds)
        for b in rng.sample(range(24), rng.randint(0, 5)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    from spanwell.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(df, 4, block)).collect()}
    rows = list(zip(signed, values))
    assert {s: c for s, c in zip(signed, plain_components(rows)) if s != c} == got


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(9, None, "a"), (4, "", "b"), (7, " \n", "c"), (3, long, "d"), (12, long + " end", "e"), (12, long + " end", "e"),
            (None, long, "f"), (None, "alone in the world here", "g"), (5, "A b C d", "h"), (6, "a B c D", "i")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumn("component_id", F.lit("x"))
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in out.collect())
    near = 3 if (plain_fingerprint(long) ^ plain_fingerprint(long + " end")).bit_count() <= 4 else 12
    assert got == sorted([(9, 4), (4, 4), (7, 4), (3, 3), (12, near), (12, near), (-1, 3), (-1, -1), (5, 5), (6, 5)])
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    expected = sorted((i, f"{fp:016x}", low) for (i, fp), low in zip(rows, plain_components(rows)))
    assert sorted(map(tuple, QUERIES["op3_simhash_dedup"](spark, sf).collect())) == expected
