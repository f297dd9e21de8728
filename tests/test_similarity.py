"""Mixed similarity, normality and predictions of several attributes against plain versions."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quietsignal.functions import normal
from quietsignal.operators import explore, series, similarity

SCHEMA = "id long, a double, b double, c string, d string"


def mixed_rows(n=160):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, float("nan"), float("inf"), *[rng.uniform(-5, 5) for _ in range(9)]]), float(rng.randrange(4)), rng.choice(["x", "y", None]), rng.choice("pqr")) for i in range(n)]
    return rows + [(n, 1.0, 1.0, "x", "p"), (n, 1.0, 1.0, "x", "p"), (None, 1.0, 1.0, "x", "p"), (n + 1, 1.0, 1.0, "x", "p")]


def plain_pairs(rows, numeric, categorical, most, scale=1000):
    rows = [(r[0], [v if v is not None and math.isfinite(v) else None for v in r[1:3]], r[3:]) for r in rows if r[0] is not None]
    spans = []
    for i in range(2):
        known = [r[1][i] for r in rows if r[1][i] is not None]
        spans.append(max(known) - min(known) if known else 0)
    out = []
    for i, r in enumerate(rows):
        for s in rows[:i]:
            if r[0] == s[0]:
                continue
            total = 0.0
            for x, y, span, w in zip(r[1], s[1], spans, numeric, strict=True):
                total += w * (0.0 if x is None and y is None else 1.0 if x is None or y is None else abs(x - y) / span if span else 0.0)
            for x, y, w in zip(r[2], s[2], categorical, strict=True):
                total += w * (x != y)
            dist = math.floor(total / (sum(numeric) + sum(categorical)) * scale)
            if dist <= most:
                out.append((min(r[0], s[0]), max(r[0], s[0]), dist))
    return sorted(out)


@pytest.mark.parametrize(("weights", "most"), [((2.0, 1.0, 1.0, 1.0), 30), ((2.0, 1.0, 1.0, 1.0), 250), ((0.5, 3.0, 1.0, 2.0), 120), ((1.0, 1.0, 1.0, 1.0), 1000), ((0.0, 0.0, 1.0, 1.0), 0)])
@pytest.mark.parametrize("block", [7, 2000])
def test_mixed_pairs_are_those_of_a_plain_loop(spark, weights, most, block):
    a, b, c, d = weights
    df = spark.createDataFrame(mixed_rows(), SCHEMA).repartition(3)
    got = similarity.mixed_pairs(df, "id", {"a": a, "b": b}, {"c": c, "d": d}, most, block=block)
    assert sorted(map(tuple, got.collect())) == plain_pairs(mixed_rows(), [a, b], [c, d], most)


def test_mixed_pairs_of_one_hot_band_are_dealt_over_many_keys(spark):
    df = spark.range(600).select("id", F.lit(1.0).alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"))
    got = similarity.mixed_pairs(df, "id", {"a": 1.0}, {"c": 1.0}, 100, block=50)
    assert got.agg(F.count("*"), F.max("dist")).first() == (200 * 199 // 2 + 400 * 399 // 2, 0)


def test_mixed_pairs_of_an_empty_table_and_other_columns(spark):
    df = spark.createDataFrame(mixed_rows(20), SCHEMA).withColumn("source", F.lit(1)).withColumn("__c", F.lit(2))
    args = ("id", {"a": 1.0}, {"c": 1.0}, 100)
    assert similarity.mixed_pairs(df.limit(0), *args).collect() == []
    assert similarity.mixed_pairs(df, *args).columns == ["source", "target", "dist"]
    assert similarity.mixed_pairs(df, "id", {}, {"c": 1.0}, 0).count() > 0
    with pytest.raises(ValueError):
        similarity.mixed_pairs(df, "id", {"a": 0.0}, {}, 100)


def test_normal_quantiles_and_tails(spark):
    ps = [1e-300, 1e-20, 1e-6, 0.001, 0.05, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.quantile(F.col("p")).alias("z")).withColumn("q", normal.upper_tail(F.col("z"))).collect()
    for r in got:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15)
        assert r["q"] == pytest.approx(1 - r["p"], rel=1e-6, abs=1e-6)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(normal.quantile(F.col("p"))).collect()] == [None] * 3


#: The worked example of the test's authors: weights in pounds of eleven men, W = 0.79 (0.7888), p = 0.0067.
WEIGHTS = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]


def plain_w(values):
    x, n = sorted(values), len(values)
    m = [NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm, u = sum(v * v for v in m), n**-0.5
    a1 = m[-1] / mm**0.5 + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a2 = m[-2] / mm**0.5 + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    ends = 1 if n <= 5 else 2
    top = [a1] if n <= 5 else [a2, a1]
    if n == 3:
        a = [-(0.5**0.5), 0.0, 0.5**0.5]
    else:
        f = ((mm - 2 * sum(v * v for v in m[n - ends :])) / (1 - 2 * sum(v * v for v in top))) ** 0.5
        a = [-v for v in reversed(top)] + [v / f for v in m[ends : n - ends]] + top
    mean = sum(x) / n
    return sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_shapiro_wilk_of_the_published_example(spark):
    df = spark.createDataFrame([("men", v) for v in WEIGHTS], "k string, v double")
    row = explore.shapiro_wilk(df, ["k"], "v").first()
    assert row["n"] == 11 and row["w"] == pytest.approx(0.7888, abs=5e-5) and row["p"] == pytest.approx(0.0067, abs=1e-4)


@pytest.mark.parametrize(("bins", "run"), [(64, 4096), (3, 2), (1, 1)])
def test_shapiro_wilk_is_that_of_a_plain_loop(spark, bins, run):
    rng = random.Random(5)
    groups = {n: [round(rng.gauss(0, 2), 1 + n % 3) for _ in range(n)] for n in (3, 4, 5, 6, 7, 11, 12, 40, 300)}
    groups[50] = [1.0] * 30 + [rng.random() for _ in range(20)]
    rows = [(k, v) for k, values in groups.items() for v in [*values, None, float("nan")]] + [(1, 1.0), (2, 1.0), (2, 2.0), (9, 4.0), (9, 4.0), (9, 4.0), (None, 1.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = {r["k"]: r for r in explore.shapiro_wilk(df, ["k"], "v", bins, run).collect()}
    assert set(got) == {*groups, 1, 2, 9, None}
    for k, values in {**groups, None: [1.0, 2.0, 4.0]}.items():
        assert got[k]["n"] == len(values) and got[k]["w"] == pytest.approx(plain_w(values), rel=1e-9) and 0 <= got[k]["p"] <= 1
    assert all(got[k]["w"] is None and got[k]["p"] is None for k in (1, 2, 9))
    assert got[50]["p"] < 1e-6 < 0.001 < got[300]["p"]


def test_shapiro_wilk_without_keys_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(v,) for v in WEIGHTS], "v double")
    assert explore.shapiro_wilk(df, [], "v").first()["w"] == pytest.approx(plain_w(WEIGHTS), rel=1e-9)
    assert explore.shapiro_wilk(df.limit(0), [], "v").collect() == []


def test_predictions_of_several_attributes_are_those_of_each(spark):
    rng = random.Random(9)
    rows = [("a", i, rng.random(), None if i == 20 else rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double")
    got = series.one_step_ahead_all(df, ["k"], {"x": 3.0, "y": 1.0}, "i", "i", 4).orderBy("i").collect()
    x, y = (series.one_step_ahead(df, ["k"], c, "i", "i", 4).orderBy("i").collect() for c in "xy")
    for i, r in enumerate(got):
        assert r["prediction_x"] == x[i]["prediction"] and r["prediction_y"] == y[i]["prediction"] and r["score_x"] == x[i]["score"]
        assert r["score"] == pytest.approx(x[i]["score"] if i == 20 else (3 * x[i]["score"] + y[i]["score"]) / 4)
    assert got[20]["score_y"] is None


def test_smoothing_weights_are_the_recursion():
    window = [3.0, 1.0, 4.0, 1.0, 5.0]
    level = window[0]
    for v in window[1:]:
        level = 0.3 * v + 0.7 * level
    assert sum(w * v for w, v in zip(series.smoothing_weights(5, 0.3), reversed(window), strict=True)) == pytest.approx(level)


@pytest.mark.parametrize(("weights", "most", "cell"), [((2.0, 1.0, 1.0), 260, 5), ((1.0, 1.0, 1.0), 1000, 50_000), ((0.0, 1.0, 1.0), 0, 5), ((1.0, 0.0, 2.0), 300, 5)])
def test_mixed_degrees_count_mixed_pairs(spark, weights, most, cell):
    a, c, d = weights
    df = spark.createDataFrame(mixed_rows(), SCHEMA).repartition(3)
    args = ("id", {"a": a}, {"c": c, "d": d}, most)
    want = similarity.mixed_pairs(df, *args).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").count()
    got = similarity.mixed_degrees(df, *args, cell=cell)
    assert got.columns == ["id", "n"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_mixed_degrees_hold_where_distances_round(spark):
    """Differences that are just at the limit, values without a range, and an empty table."""
    args = ("id", {"a": 2.0}, {"c": 1.0}, 100)
    for rows in ([(i, i * 0.1, "xy"[i % 2]) for i in range(301)], [(i, 7.0, "xy"[i % 2]) for i in range(20)], [(i, [0.0, -0.0, 1e-300, 1e300, None][i % 5], "x") for i in range(20)], []):
        df = spark.createDataFrame(rows, "id long, a double, c string")
        want = similarity.mixed_pairs(df, *args).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").count()
        assert sorted(map(tuple, similarity.mixed_degrees(df, *args).collect())) == sorted(map(tuple, want.collect()))
    assert similarity.mixed_degrees(df, "id", {"a": 2.0}, {"c": 1.0}, -1).collect() == []
    with pytest.raises(ValueError):
        similarity.mixed_degrees(df, "id", {}, {"c": 1.0}, 0)


def test_mixed_degrees_of_many_copies_make_no_pairs(spark):
    df = spark.range(200_000).select("id", F.lit(1.0).alias("a"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("c"))
    got = similarity.mixed_degrees(df, "id", {"a": 1.0}, {"c": 1.0}, 100)
    assert got.groupBy("n").count().orderBy("n").collect() == [(49_999, 50_000), (149_999, 150_000)]
