"""Nothing is left out of groups, grammars and removals."""

import numpy as np

from spanwell.llm import embedding_dedup as vectors
from spanwell.llm import line_dedup
from spanwell.llm import token_files as files
from tests.llm.test_mixing_and_lines import DOCS, line_rows


def test_recall_in_one_large_group():
    """Pairs at 0.951 in groups of 2048, of which a scan that ends by the first line loses a hundredth."""
    plan, found = vectors.make_plan(2048), 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(1024, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        both = np.concatenate([x, 0.951 * x + np.sqrt(1 - 0.951**2) * y])
        order = rng.permutation(2048)
        lines = plan.directions(64)[:, plan.tables * plan.lines_in_table:]
        for u, v in vectors._pairs_in_group(both[order], lines, plan):
            found += int((order[u] % 1024 == order[v] % 1024).sum())
    assert found >= 0.999 * 6 * 1024


def test_pairs_seen_sixteen_times_are_replaced():
    ids = np.arange(10_000, dtype=np.uint32)
    for at in range(16):
        ids[500 * at: 500 * at + 2] = 20_000, 20_001
    rules, lengths, symbols = files.compress(ids, 30_000)
    assert rules.tolist() == [[20_000, 20_001]] and len(symbols) == 10_000 - 16


def test_shared_lines_go_from_short_pages_too(spark):
    df = spark.createDataFrame(line_rows(), DOCS)
    out = {r.doc_id: r for r in line_dedup.remove_shared_lines(df, spare_copies=False).collect()}
    assert out[200].text == "" and out[200].n_removed == 2 and out[0].text.count("on all") == 1
