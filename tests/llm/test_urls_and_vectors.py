"""Url filters and embedding near-dedup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwell.llm import embedding_dedup as vectors
from spanwell.llm import url_filters as urls
from spanwell.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    end = min([i for i in range(cut, len(rest)) if rest[i] in "?#"], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]


def plain_rule(host, path):
    fits = []
    for rule, verdict in URL_RULES:
        site, slash, rest = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


CASES = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=/fr/#y", "http://example.net", "http://net/x", "http://notnet/x",
         "http://example.net/en", "https://www.example.com/de/a/b.html", "http://x.org/fr/", "http://x.org/fr", "ftp://É.ORG/fr/É",
         "http://a.com?u=http://b.net/", "http://a.b.c.net:80/x", "http://c.net/x", "://net/", "http://example.com.evil.org/fr/x", "http://a\nb.net/p\nq#z"]


def labelled(spark, n=600):
    rows = [(f"http://{'buy-pills-%d' % i if i % 3 == 0 else 'site%d' % i}.example.{'com' if i % 2 else 'org'}/p/{i}", int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "url string, label int")


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)], "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge(df, URL_RULES, labelled(spark)).collect()}
    for i, url in enumerate(CASES):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_what_labels_show(spark):
    fresh = spark.createDataFrame([(i, f"http://{'get-casino-%d' % i if i % 2 else 'page%d' % i}.example.com/p/{i}") for i in range(200)], "page_id int, url string")
    found = urls.judge(fresh, [], labelled(spark)).collect()
    assert np.mean([(r.verdict == "block") == bool(r.page_id % 2) for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize("keep, verdict", [("false", "allow"), ("label = 0", "allow"), ("label = 1", "block")])
def test_one_class_or_none(spark, keep, verdict):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string")
    assert [r.verdict for r in urls.judge(df, [], labelled(spark).where(keep)).collect()] == [verdict]


def test_url_defined_cases(spark):
    df = spark.createDataFrame([("http://a.net/x", "s", 1), ("http://a.net/x", "s", 1)], "url string, score string, label int").withColumn(
        "features", F.lit(0)).withColumn("row", F.lit("r")).withColumn("suffix_rate", F.lit(0))
    out = urls.judge(df, URL_RULES, labelled(spark))
    assert out.columns == ["url", "label", "features", "row", "suffix_rate", "host", "path", "rule", "score", "verdict"]
    assert [r.verdict for r in out.collect()] == ["block", "block"]
    assert urls.judge(df.limit(0), URL_RULES, labelled(spark)).collect() == []


def test_url_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op1_url_filter"](spark, SF)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = plain_parts(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, plain_rule(host, path)[0])


def plain_links(rows, threshold=0.95):
    """(n_links, component) of each (id, vector), pair by pair."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
                near[a][b] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
    low = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for a in range(n):
            for b in range(n):
                if near[a][b] and low[b] < low[a]:
                    low[a], moved = low[b], True
    return [(sum(near[a]), low[a]) for a in range(n)]


def crowd(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(int(i), (centres[i % 4] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("block", [20, 2048])
def test_vectors_equal_brute_force(spark, block):
    rows = crowd(1, 160, 24, 0.16) + crowd(2, 40, 8, 2.0)[:0]
    rows += [(1000 + i, v) for i, v in crowd(3, 60, 24, 2.0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), block=block).collect()}
    expected = dict(zip([i for i, _ in rows], plain_links(rows)))
    assert sum(n for n, _ in expected.values()) > 500
    assert got == expected


def test_recall_with_many_tables(spark):
    """Pairs just above the threshold among many vectors, with a plan for small groups."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.952 * x + np.sqrt(1 - 0.952**2) * y
    rows = [(2 * i + k, v[i].tolist()) for i in range(1500) for k, v in ((0, x), (1, z))]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    linked = out.where("n_links > 0 and component_id = vec_id - vec_id % 2").count()
    assert linked >= 0.99 * 3000


def test_counts_of_sorted_windows_equal_those_of_all_pairs():
    rng = np.random.default_rng(9)
    for n, lines, least in ((1, 16, 3), (64, 16, 0), (65, 16, 16), (200, 7, 4), (130, 16, 11), (3, 1, 1)):
        places = np.round(rng.normal(size=(lines, n)), 1)
        near = (np.abs(places[:, :, None] - places[:, None, :]) <= 0.55).sum(axis=0) >= least
        bits = vectors._collisions(places, 0.55, least).astype("<u8").view(np.uint8).reshape(n, -1)
        assert (np.unpackbits(bits, axis=1, bitorder="little")[:, :n].astype(bool) == near).all()


@pytest.mark.parametrize("group", [1024, 64])
def test_recall_of_planted_pairs_against_brute_force(spark, group):
    """Pairs with cosines of 0.95 to 0.97 among vectors of random direction: at least 0.999 of all links."""
    rng = np.random.default_rng(17)
    x, y = rng.normal(size=(2, 2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.95, 0.97, size=(2000, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])
    rows = [(i, v.tolist()) for i, v in enumerate(both)]
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), group=group)
    found = {r.vec_id: r.n_links for r in out.collect()}
    assert expected.sum() > 3900
    assert all(found[i] <= n + 1 for i, n in enumerate(expected))
    assert sum(found.values()) >= 0.999 * expected.sum()


def test_plans_keep_their_recall():
    for n in (1, 1000, 50_000, 10**9):
        plan = vectors.make_plan(n)
        assert plan.tables >= 1 and 0 <= plan.least <= plan.counting_lines


def test_vector_defined_cases(spark):
    a, nan, inf = [1.0, 2.0, 2.0], float("nan"), float("inf")
    rows = [(7, a), (5, a), (5, a), (3, [2.0, 4.0, 4.0]), (1, None), (2, []), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (8, [nan, 2.0, 2.0]),
            (9, [inf, 2.0, 2.0]), (10, [1.0, 2.0, 2.0, 0.0]), (None, a), (11, [-1.0, -2.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("x")).withColumn("vector", F.lit(1))
    out = vectors.near_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in out.collect())
    alone = [(i, 0, i, True) for i in (1, 2, 4, 6, 8, 9, 10, 11)]
    assert got == sorted([(7, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (-1, 0, -1, False), *alone])
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_vector_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()][:]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op6_embedding_dedup"](spark, SF).collect()}
    assert got == dict(zip([i for i, _ in rows], plain_links(rows)))
