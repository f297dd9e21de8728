"""Forests against plain versions: bounded samples, merges, growth that goes on, keys of any number."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietsignal.operators import forest
from quietsignal.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plain_sample(ids, trees, size):
    pick = lambda t, i: int(hashlib.md5(f"r:{t}:{i}".encode()).hexdigest()[:8], 16)
    return {t: sorted(ids, key=lambda i: (pick(t, i), i))[:size] for t in range(trees)}


def path(nodes, x, node=1):
    attr, split, n, leaf = nodes[node]
    return node.bit_length() - 1 + float(forest.path_norm(n)) if leaf else path(nodes, x, 2 * node + int(x[attr] >= split))


def plain_scores(trees, rows):
    trees = [{node: (attr, split, n, leaf) for _, node, attr, split, n, leaf in t} for t in trees]
    norm = float(forest.path_norm(np.mean([t[1][2] for t in trees])))
    return {i: 2 ** (-np.mean([path(t, x) for t in trees]) / norm) for i, x in rows.items()}


def test_samples_are_the_smallest_hashes_and_merge(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 7 else 1.0) for i in range(500)], "i long, v double, w double")
    got = {}
    for r in forest.samples(df, "i", ["v", "w"], 5, 20).collect():
        got.setdefault(r["tree"], set()).add(r["id"])
    assert got == {t: set(own) for t, own in plain_sample([i for i in range(500) if i != 7], 5, 20).items()}
    halves = [forest.samples(df.where(F.col("i") % 2 == k), "i", ["v", "w"], 5, 20) for k in (0, 1)]
    assert sorted(map(tuple, forest.merge(*halves, 20).collect())) == sorted(map(tuple, forest.samples(df, "i", ["v", "w"], 5, 20).collect()))
    assert forest.samples(df.where("false"), "i", ["v"], 5, 20).count() == 0


def test_incremental_query_against_a_plain_forest(spark):
    """Trees grown on half of the orders and then on the merged samples, row by row."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", F.dayofmonth("o_orderdate").alias("d")).collect()
    rows = {r["o_orderkey"]: (r["o_totalprice"] / 1000, float(r["d"])) for r in orders}
    first = plain_sample([i for i in rows if i % 2 == 0], 16, 250)
    every = plain_sample(list(rows), 16, 250)
    trees = []
    for t in range(16):
        x = lambda ids: np.array([rows[i] for i in sorted(ids)])
        old = {node: (attr, split) for _, node, attr, split, _, leaf in forest.grow(x(first[t]), t, 4, forest.hash_choice) if not leaf}
        out, level = [], [(1, x(every[t]), 0)]
        while level:
            node, own, depth = level.pop()
            if node in old:
                attr, split = old[node]
            else:
                pick, share = forest.hash_choice(t, node)
                attr = pick % 2
                low, high = (own[:, attr].min(), own[:, attr].max()) if len(own) else (0, 0)
                if depth == 6 or len(own) <= 1 or high - low <= forest.MIN_RANGE:
                    out.append((t, node, None, None, len(own), True))
                    continue
                split = low + (high - low) * share
            out.append((t, node, attr, split, len(own), False))
            level += [(2 * node, own[own[:, attr] < split], depth + 1), (2 * node + 1, own[own[:, attr] >= split], depth + 1)]
        trees.append(out)
    want = plain_scores(trees, rows)
    for r in QUERIES["iforest_incremental"](spark, SF).collect():
        assert r["score"] == pytest.approx(want[r["o_orderkey"]], abs=1e-4)


@pytest.mark.parametrize("query,keys", [("iforest_random", []), ("iforest_keyed", ["o_orderpriority"])])
def test_random_forests_score_by_their_nodes(spark, query, keys):
    """Scores follow row by row from the forest's nodes, and each tree is what ``grow`` makes of a sample of the right size."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("p"), F.dayofmonth("o_orderdate").cast("double").alias("d"))
    many, size = (25, 64) if keys else (50, 128)
    nodes = forest.fit_by_key(rows, keys, ["p", "d"], trees=many, subsample=size).collect()
    by = {}
    for r in nodes:
        by.setdefault(tuple(r[k] for k in keys), {}).setdefault(r["tree"], []).append((r["tree"], r["node"], r["attr"], r["split"], r["n"], r["leaf"]))
    want = {}
    for key, trees in by.items():
        own = {r["o_orderkey"]: (r["p"], r["d"]) for r in rows.collect() if tuple(r[k] for k in keys) == key}
        take = min(size, max(1, int(0.75 * len(own)))) if len(own) <= size else size
        assert len(trees) == many and all({n for _, node, _, _, n, _ in t if node == 1} == {take} for t in trees.values())
        want |= plain_scores(list(trees.values()), own)
    got = {r["o_orderkey"]: r["score"] for r in QUERIES[query](spark, SF).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)


@pytest.mark.parametrize("share", [7, 10**6])
def test_many_keys_without_the_driver(spark, monkeypatch, share):
    """Each key's rows are scored by its own forest, in several tasks if they are many; odd rows keep their places."""
    monkeypatch.setattr(forest, "SHARE_ROWS", share)
    rows = [(f"u{i % 60}" if i % 61 else None, i, float(i * 31 % 97), float("nan") if i == 100 else None if i == 200 else float(i * i % 53)) for i in range(1200)]
    df = spark.createDataFrame(rows, "`my key` string, i long, v double, w double").repartition(5)
    nodes = forest.fit_by_key(df, ["my key"], ["v", "w"], trees=5, subsample=16)
    out = forest.score(df, nodes, ["v", "w"], keys=["my key"])
    assert out.columns == [*df.columns, "score"]
    got = {r["i"]: r for r in out.collect()}
    assert len(got) == 1200 and {i for i, r in got.items() if r["score"] is None} == {100, 200} and all(got[i]["my key"] == k for k, i, *_ in rows)
    kept = {r["i"]: r["score"] for r in forest.score(df, nodes, ["v", "w"], "i % 2 = 0", ["my key"], "`my key` = 'u4'").collect()}
    assert len(kept) == 600 and {i for i, s in kept.items() if s is not None} == {i for k, i, *_ in rows if k == "u4" and i % 2 == 0} - {100, 200}
    assert all(s is None or s == got[i]["score"] for i, s in kept.items())
    assert forest.score(df.where("false"), nodes, ["v", "w"], keys=["my key"]).count() == 0
