"""The metric neighbour join against all pairs: keys, copies, ties, odd rows, and what it leaves out."""

import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quietsignal.operators import density, knn


def plain(rows, k, scale=None):
    """All pairs of rows of a key with vectors of one length, ties by id."""
    whole = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    rows = [(key, i, np.array(v)) for key, i, v in rows if i is not None and whole(v)]
    out = []
    for key, i, v in rows:
        d = sorted(((float(np.sqrt(((v - w) ** 2).sum())) if scale is None else int(np.floor(np.sqrt(((v - w) ** 2).sum()) * scale))), j) for other, j, w in rows if other == key and j != i and len(w) == len(v))
        out += [(key, i, j, s, n) for n, (s, j) in enumerate(d[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, schema="k string, i long, v array<double>", **settings):
    return sorted((tuple(r) for r in density.nearest(spark.createDataFrame(rows, schema), ["k"], "i", "v", k, **settings).collect()), key=str)


def close(a, b):
    assert [x[:3] + x[4:] for x in a] == [x[:3] + x[4:] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])


@pytest.mark.parametrize("block", [7, 40, 1000])
@pytest.mark.parametrize("scale", [None, 3])
def test_neighbours_by_blocks_are_those_of_all_pairs(spark, block, scale):
    r = np.random.default_rng(4)
    rows = [(key, i, (r.normal(size=3) + 6 * r.integers(0, 4)).tolist()) for key in ("a", None) for i in range(90)] + [("b", 5, [0.0, 0.0, 0.0])]
    close(found(spark, rows, 4, block=block, scale=scale), plain(rows, 4, scale))


def test_large_groups_of_copies_and_ties(spark):
    r = np.random.default_rng(1)
    rows = [("a", i, [float(x) for x in r.integers(0, 3, 2)]) for i in range(150)] + [("a", 200 + i, [1.0, 1.0]) for i in range(100)]
    close(found(spark, rows, 5, block=20), plain(rows, 5))


@pytest.mark.parametrize("block", [8, 1000])
def test_odd_rows(spark, block):
    rows = [("a", i, [float(i % 7), 1.0]) for i in range(30)] + [("a", 50, None), ("a", 51, [1.0, None]), ("a", 52, [float("nan"), 1.0]), ("a", 53, [float("inf"), 1.0]), ("a", None, [1.0, 1.0]), ("a", 54, [1.0]), ("a", 55, [2.0]), ("a", 56, []), ("b", 1 << 60, [1.0, 2.0]), ("b", (1 << 60) + 1, [1.0, 3.0])]
    close(found(spark, rows, 3, block=block), plain(rows, 3))
    assert found(spark, [], 3, block=block) == []


@pytest.mark.parametrize("name", ["_k", "my key", "source", "k0", "v", "a.b"])
def test_keys_keep_their_values_under_any_name(spark, name):
    for block in (4, 1000):
        df = spark.createDataFrame([(x, i, [float(i)]) for x in (1 << 60, None, 3) for i in range(9)], "x long, id long, vector array<double>").withColumnRenamed("x", name)
        out = density.nearest(df, [name], "id", "vector", 2, block=block)
        assert out.columns == [name, "source", "target", "dist", "rank"]
        assert {r[0] for r in out.collect()} == {1 << 60, None, 3} and out.count() == 54


def test_blocks_that_hold_nothing_near_are_not_visited(spark):
    """On clusters, rows are sent to few blocks, and a small share of all distances is worked out."""
    r = np.random.default_rng(2)
    centers = 10 * r.normal(size=(30, 8))
    rows = spark.createDataFrame([("a", i, (centers[i % 30] + 0.3 * r.normal(size=8)).tolist()) for i in range(3000)], "k string, i long, v array<double>")
    own, _, id_type, dist = knn.fields_of(rows, ["k"], "i", None)
    join = knn.Join(knn.usable(rows, ["k"], "i", "v"), own, id_type, dist, knn.Metric(5, None), 100)
    blocks = join.placed.groupBy("g1", "g2", "pivot", "part").count()
    met = join.visits.groupBy("g1", "g2", "pivot", "part").agg(F.count("*").alias("asks")).join(blocks, ["g1", "g2", "pivot", "part"]).agg(F.sum(F.col("asks") * F.col("count"))).first()[0] or 0
    at_home = blocks.agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert met + at_home < 3000 * 3000 / 4 and join.visits.count() < 3000 * blocks.count() / 4


def keyed(spark):
    r = np.random.default_rng(6)
    rows = [(key, i, (r.normal(size=2) * (1 + 2 * n)).tolist()) for n, key in enumerate("ab") for i in range(20)]
    return spark.createDataFrame(rows, "k string, i long, v array<double>")


def test_detectors_keep_keys_apart(spark):
    """Ids repeat over keys: each key has what it has alone."""
    df = keyed(spark)
    late = df.select("k", F.col("i").alias("id"), (F.col("i") >= 10).alias("late"))

    def all_of(rows, halves):
        near = density.nearest(rows, ["k"], "i", "v", 3, scale=1000)
        plain_ = density.nearest(rows, ["k"], "i", "v", 3)
        groups, thick = density.neighbour_groups(near, ["k"]), density.density(density.average_distance(near, ["k"]))
        return [sorted(map(tuple, x.collect())) for x in (density.lof(plain_), density.relative_density(groups, thick), density.neighbour_drift(plain_, halves))]

    both = all_of(df, late)
    for n, key in enumerate("ab"):
        alone = all_of(df.where(F.col("k") == key), late.where(F.col("k") == key))
        for whole, part in zip(both, alone, strict=True):
            assert len(part) == 20 and [x for x in whole if x[0] == key] == part
    assert density.classifier_drift(density.nearest(df, ["k"], "i", "v", 3), late).first()[0] >= 0.5


def test_copies_of_a_row_are_no_outliers(spark):
    rows = spark.createDataFrame([("a", i, [1.0]) for i in range(6)] + [("a", 10 + i, [5.0 + i]) for i in range(4)], "k string, i long, v array<double>")
    got = {r["source"]: r["lof"] for r in density.lof(density.nearest(rows, ["k"], "i", "v", 3)).collect()}
    assert all(got[i] == pytest.approx(1) for i in range(6)) and len(got) == 10


@pytest.mark.parametrize("block", [7, 4096])
def test_pair_sums_are_those_of_all_pairs(spark, block):
    """Keys, copies, repeated ids, nulls, NaN, infinities, other lengths."""
    r = np.random.default_rng(3)
    rows = [(key, i, (1e4 * (key == "b") + r.normal(size=3)).tolist()) for key in ("a", "b", None) for i in range(40)]
    rows += [("a", 100 + i, [1.0, 2.0, 3.0]) for i in range(3)] + [("a", 5, [9.0, 9.0, 9.0])] * 2 + [("b", None, [1.0, 1.0, 1.0]), ("b", 60, None), ("b", 61, [1.0, None, 1.0]), ("b", 62, [1.0])]
    rows += [("c", i, v) for i, v in enumerate([[1.0, 2.0], [float("nan"), 1.0], [float("inf"), 1.0], [float("inf"), 2.0]])] + [("d", 1, [1.0])] + [("e", 1, [1.0]), ("e", 2, [float("nan")]), ("f", 1, None), ("f", 2, [1.0])]
    df = spark.createDataFrame(rows, "k string, i long, v array<double>").repartition(3)
    want = density.pair_distances(df, ["k"], "i", "v").groupBy("k").agg(F.count("*").alias("pairs"), F.avg("dist").alias("mean_dist"), F.min("dist").alias("least"))
    got = density.pair_summary(df, ["k"], "i", "v", block)
    a, b = ({x["k"]: x for x in t.collect()} for t in (got, want))
    assert set(a) == set(b) and got.columns == want.columns
    for k in a:
        assert a[k]["pairs"] == b[k]["pairs"]
        for c in ("mean_dist", "least"):
            assert (a[k][c] is None) == (b[k][c] is None) and (a[k][c] is None or np.isclose(a[k][c], b[k][c], rtol=1e-9, equal_nan=True))


def test_pair_sums_take_keys_of_more_rows_than_pairs_are_made_for(spark):
    df = spark.range(20_500).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.array((F.col("id") % 2).cast("double")).alias("v"))
    assert tuple(density.pair_summary(df, ["k"], "i", "v").first()) == ("a", 20_500 * 20_499, pytest.approx(0.5, abs=1e-4), 0.0)


def test_rows_that_go_to_all_blocks_are_given_in_small_pieces(spark, monkeypatch):
    """Where no block can be left out, what a task holds does not grow with their number."""
    answers, streamed = [], knn.Join.streamed
    monkeypatch.setattr(knn.Join, "streamed", staticmethod(lambda both, group, answer, fields: (answers.append(answer), streamed(both, group, answer, fields))[1]))
    rows = spark.createDataFrame([("a", i, [float(i)]) for i in range(40)], "k string, i long, v array<double>")
    own, _, id_type, dist = knn.fields_of(rows, ["k"], "i", None)
    knn.Join(knn.usable(rows, ["k"], "i", "v"), own, id_type, dist, knn.Metric(2, None), 8)
    held = pd.DataFrame({"rows": 1, "v": [np.array([float(i)]) for i in range(1000)], "low": 0.0, "high": 1.0, "pivot": range(1, 1001), "parts": 1})
    frame = pd.DataFrame({"g1": 1, "g2": 1, "h1": range(100), "h2": 0, "v": [np.array([0.5])] * 100, "share": 0, "pivot": 1, "part": 0, "reach": np.inf})
    pieces = [len(x) for x in answers[1](held, frame)]
    assert sum(pieces) == 100 * 999 and max(pieces) <= knn.STEP


def test_what_a_task_holds_does_not_grow_with_the_blocks_of_a_key(spark, monkeypatch):
    """Eight times the pivots, each of several blocks: rows are sent on in turns, so about the same is held, and each row still goes everywhere."""
    answers, streamed = [], knn.Join.streamed
    monkeypatch.setattr(knn.Join, "streamed", staticmethod(lambda both, group, answer, fields: (answers.append(answer), streamed(both, group, answer, fields))[1]))
    rows = spark.createDataFrame([("a", i, [float(i)]) for i in range(40)], "k string, i long, v array<double>")
    own, _, id_type, dist = knn.fields_of(rows, ["k"], "i", None)
    knn.Join(knn.usable(rows, ["k"], "i", "v"), own, id_type, dist, knn.Metric(2, None), 8)
    frame = pd.DataFrame({"g1": 1, "g2": 1, "h1": range(knn.STEP), "h2": 0, "v": [np.array([0.5])] * knn.STEP, "share": 0, "pivot": 1, "part": 2, "reach": np.inf})
    of = lambda pivots: pd.DataFrame({"rows": 1, "v": [np.array([float(i)]) for i in range(pivots)], "low": 0.0, "high": 1.0, "pivot": range(1, pivots + 1), "parts": 3})
    whole = pd.concat(answers[1](of(64), frame))
    assert len(whole) == len(whole[["h1", "pivot", "part"]].drop_duplicates()) == knn.STEP * 191 and not ((whole["pivot"] == 1) & (whole["part"] == 2)).any()
    peaks = []
    for held in (of(128), of(1024)):
        tracemalloc.start()
        assert all(len(x) <= knn.STEP for x in itertools.islice(answers[1](held, frame), 5))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + 10, peaks


def test_vectors_are_sent_packed_and_answers_are_within_reach(spark):
    """Floats stay four bytes, and a block answers only what a row still looks for, not its first k + 1 whatever they are."""
    r = np.random.default_rng(8)
    rows = spark.createDataFrame([("a", i, r.normal(size=6).tolist()) for i in range(120)], "k string, i long, v array<float>")
    own, _, id_type, dist = knn.fields_of(rows, ["k"], "i", None)
    join = knn.Join(knn.usable(rows, ["k"], "i", "v"), own, id_type, dist, knn.Metric(3, None), 20)
    assert {len(x["v"]) for x in join.visits.select("v").collect()} == {24}
    reach = join.home.select("h1", "reach")
    far = join.answers.join(reach, "h1").where(F.array_max("dist") > F.col("reach") * (1 + 1e-8)).count()
    assert far == 0 and join.answers.where(F.size("dist") == 0).count() == 0


def test_search_of_many_ties_is_bounded_in_memory():
    """Where all distances tie, candidates are worked out in pieces."""
    x = np.eye(3000, 64) + np.eye(3000, 64, -64)
    held = knn.Held(x, np.full(3000, 4), np.arange(12_000)[::-1])
    tracemalloc.start()
    row, dist, ids = knn.Metric(3, 1).nearest(np.full((2000, 64), 0.5), held, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row.tolist() == np.repeat(np.arange(2000), 4).tolist() and ids.tolist() == [0, 1, 2, 3] * 2000 and set(dist.tolist()) == {4} and peak < 250e6
