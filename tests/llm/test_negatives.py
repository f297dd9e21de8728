"""Hard negatives against brute force: contracts, odd rows, clusters, copies, shards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietsignal.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id long, rank int, vector string"


def plain(rows, positives=5, negatives_=5, every=100, low=80, high=100):
    """All scores of all pairs, in whole numbers."""
    first = {}
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own = (y, [int(np.floor(256 * float(np.float32(x)))) for x in v])
            first[i] = min(first.get(i, own), own)
    score = lambda a, b: sum(x * y for x, y in zip(first[a][1], first[b][1], strict=False))
    out = []
    for a in (i for i in first if i % every == 0):
        ranked = sorted((-score(a, b), b) for b in first if b != a)
        for s, p in [x for x in ranked if first[x[1]][0] == first[a][0]][:positives]:
            inside = [(t, n) for t, n in ranked if first[n][0] != first[a][0] and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(inside[:negatives_])]
    return sorted(out)


def mined(spark, rows, every=100, **settings):
    frame = spark.createDataFrame([(i, y, v, 1, 2, "x") for i, y, v in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(negatives.usable(frame), F.col("id") % every == 0, **settings).collect()))


def clustered(seed, n, wide=8, groups=12):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, wide))
    return [(i, int(r.integers(4)), [float(x) for x in centers[i % groups] + 0.05 * r.normal(size=wide)]) for i in range(n)]


@pytest.mark.parametrize("leaf,least", [(8, 40), (64, 1 << 12)])
def test_clusters_against_brute_force(spark, monkeypatch, leaf, least):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "LEAST_ROWS", least)
    rows = clustered(1, 700)
    assert mined(spark, rows, 20) == plain(rows, every=20) and plain(rows, every=20)
    assert mined(spark, rows, 50, positives=3, negatives=9, low=50, high=90) == plain(rows, 3, 9, 50, 50, 90)


def test_copies_and_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    r = random.Random(3)
    rows = [(i, r.randrange(3), r.choice([[1.0, 0.0], [0.9, 0.0], [0.0, 1.0]])) for i in range(300)]
    assert mined(spark, rows, 30) == plain(rows, every=30)


def test_odd_rows(spark):
    """Nulls and numbers that are not finite take no part; short vectors are filled up; of a repeated id one row counts."""
    rows = clustered(2, 60) + [(None, 1, [1.0] * 8), (700, None, [1.0] * 8), (800, 1, None), (801, 1, [1.0, None]), (802, 1, [float("nan")] * 8), (803, 1, [float("inf")] * 8)]
    rows += [(0, 3, [9.0] * 8), (5, 0, [0.1] * 8), (900, 1, []), (901, 1, [0.5]), (902, 2, [0.4] * 12), (-100, 2, [-1.0] * 8), (1000, 77, [0.2] * 8)]
    assert mined(spark, rows, 20) == plain(rows, every=20)
    assert mined(spark, [], 20) == [] and mined(spark, [(0, 1, [1.0])], 20) == []


@pytest.mark.parametrize("size", [30.0, 1e5, 1e6])
def test_large_components_are_exact(spark, size):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(2)), [float(x) for x in size * r.normal(size=3)]) for i in range(200)]
    assert mined(spark, rows, 40) == plain(rows, every=40)


def test_searches_leave_out_nodes_outside_the_annulus(monkeypatch):
    """On clusters most leaves are never visited, and what is found stays the nearest in the annulus."""
    monkeypatch.setattr(negatives, "LEAF", 32)
    rows = clustered(4, 6000, 32, 60)
    x = np.floor(256 * np.array([v for *_, v in rows]))
    ids, labels, norm = np.arange(6000), np.array([y for _, y, _ in rows]), float((x * x).sum(1).max()) + 1
    tree = negatives.Tree(ids, labels, x, norm)
    assert sorted(tree.ids) == list(range(6000))
    leaves, visited = sum(c is None for c in tree.child), []
    for a in range(0, 6000, 300):
        search, s = negatives.Search(tree, x[a], norm), x @ x[a]
        top = float(np.sort(s)[-20])
        got = list(search.nearest_first(0.8 * top, top, labels[a], False, 5, a))
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if 0.8 * top <= v <= top and labels[i] != labels[a])[:5]
        assert got == [(-v, i) for v, i in want]
        visited.append(len(search.known))
    assert np.mean(visited) < leaves / 4
