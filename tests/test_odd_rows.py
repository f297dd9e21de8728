"""Nulls, NaN, infinities, repeats, single rows and null keys through every core operator: no crash, no row lost, other keys untouched."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quietsignal.functions.score import tag
from quietsignal.operators import alerts, density, drift, explore, forecast, forest, models, projection, record, series
from quietsignal.operators.record import Settings

SCHEMA = "k string, i long, v double, w double, s string, e int, e2 int, score double, tag string"
KEY, AT = ["k"], ("i", "i")
STATES = ["x", "y", "z"]


def clean_rows():
    r = random.Random(8)
    return [(k, 100 * n + i, r.gauss(10, 2) + 30 * (i == 20), r.gauss(5, 1), r.choice(STATES), int(r.random() < 0.3), int(r.random() < 0.3), r.random(), r.choice("ONI")) for n, k in enumerate("ab") for i in range(40)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = [("odd", 900 + i, [1.0, None, 2.0, nan, 50.0, inf, -inf, 2.0][i % 8], [1.0, 2.0, None, 3.0, nan][i % 5], ["x", None, "q"][i % 3], [0, 1, None][i % 3], [1, None][i % 2], [0.5, None, nan][i % 3], ["O", None, "A"][i % 3]) for i in range(30)]
    return [*rows, rows[0], rows[4], ("one", 990, 1.0, 1.0, "x", 1, 0, 0.5, "O"), ("none", 991, None, None, None, None, None, None, None), *[(None, 993 + i, float(i), 1.0, "y", 0, 1, 0.1, "N") for i in range(3)]]


S = Settings(KEY, ["v", "w"])
ONE = Settings(KEY, ["v"])
BINS = Settings(KEY, ["v", "w"], extra={"widths": {"v": 5.0, "w": 1.0}})
BIN = Settings(KEY, ["v"], extra={"widths": {"v": 5.0}})


def vectors(df):
    return df.dropDuplicates(["i"]).select("k", "i", F.array("v", "w").alias("x"))


PER_ROW = {
    **{name: (lambda d, name=name: record.detect(d, name, S)) for name in ("zscore", "robustZscore", "extremeValue", "interPercentile", "mahalanobis")},
    **{name: (lambda d, name=name: record.detect(d, name, BINS)) for name in ("jointProbability", "marginalProbability", "metaProbability", "entropyIncrease")},
    **{name: (lambda d, name=name: record.detect(d, name, BIN)) for name in ("attributeProbability", "cumulativeProbability")},
    "in_range": lambda d: record.in_range(d, d.where("i % 7 = 0").select("k", F.col("v").alias("v_lo"), (F.col("v") + 2).alias("v_hi")), ONE, 2.0),
    "out_of_range": lambda d: record.out_of_range(d, d.groupBy("k").agg(F.lit(5.0).alias("v_lo"), F.lit(12.0).alias("v_hi")), ONE, 2.0),
    "markov": lambda d: series.markov(d, series.transition_model(d, KEY, "s", *AT, STATES), KEY, "s", *AT, 4, "conditionalProbability", 1.0),
    "markov_entropy": lambda d: series.markov(d, series.transition_model(d, KEY, "s", *AT, STATES), KEY, "s", *AT, 4, "entropyReduction", 1.0, cumulative=True),
    "one_step_ahead": lambda d: series.one_step_ahead(d, KEY, "v", *AT, 4),
    "replacing": lambda d: forecast.replacing(d, KEY, "v", *AT, 4, 0.9),
    "discord": lambda d: series.discord(d, KEY, "v", *AT, 5),
    "neighborhood": lambda d: series.local_neighborhood(d, KEY, "v", *AT, 5, nearest=2),
    "forest": lambda d: forest.score(d, forest.fit_by_key(d, KEY, ["v", "w"], trees=5, subsample=16), ["v", "w"], keys=KEY),
    "components": lambda d: projection.reconstruction_error(d, projection.fit_components(d, KEY, ["v", "w"], 1), KEY, ["v", "w"], 1),
    "one_step_all": lambda d: series.one_step_ahead_all(d, KEY, {"v": 2.0, "w": 1.0}, *AT, 4),
    "residue": lambda d: projection.spectral_residue(d, KEY, "v", *AT, 8),
    "ddm": lambda d: drift.ddm(d, KEY, "e", *AT, 5, 2.0), "eddm": lambda d: drift.eddm(d, KEY, "e", *AT, 5, 0.9), "fhddm": lambda d: drift.fhddm(d, KEY, "e", *AT, 6, 0.1),
    "paired": lambda d: drift.paired_learners(d, KEY, "e", "e2", *AT, 0.1), "ecdd": lambda d: drift.ecdd(d, KEY, "e", *AT, 0.2, 2.0),
    "clusters": lambda d: alerts.cluster_alerts(d, KEY, "i", "i", max_gap=3), "average_clusters": lambda d: alerts.cluster_alerts(d, KEY, "i", "i", average_gap=3),
    "score_shift": lambda d: alerts.score_level_shift(d, KEY, *AT, 10, 3, 0.5), "tag": lambda d: d.withColumn("t", tag(F.col("score"), 0.5)),
    "keyed_threshold": lambda d: record.keyed_threshold(d, alerts.pseudo_relevance(d, KEY, "i", 3, False, 2, 0.7), KEY),
}
PER_KEY = {
    "moments": lambda d: models.moments(d, KEY, ["v", "w"]), "medians": lambda d: models.medians(d, KEY, ["v", "w"]), "covariance": lambda d: models.covariance(d, KEY, ["v", "w"]),
    "ngrams": lambda d: series.ngram_frequencies(d, KEY, "s", *AT, 2), "changes": lambda d: series.change_points(d, KEY, "v", *AT, 8, "KS", 0.5), "autocorrelation": lambda d: series.autocorrelation(d, KEY, "v", *AT, [1, 3]),
    "neighbours": lambda d: density.nearest(vectors(d), KEY, "i", "x", 3), "many_blocks": lambda d: density.nearest(vectors(d), KEY, "i", "x", 3, block=8), "lof": lambda d: density.lof(density.nearest(vectors(d), KEY, "i", "x", 3)),
    "thresholds": lambda d: alerts.best_split(alerts.learn_threshold(d, KEY, F.col("e") == 1, [0.3, 0.6]), KEY), "relevance": lambda d: alerts.pseudo_relevance(d, KEY, "i", 10, True, 3, 0.5), "tail": lambda d: alerts.score_tail(d, KEY, [0.9]),
    "pareto": lambda d: alerts.tail_fit(d, KEY, 0.7, 0.99), "counter": lambda d: alerts.count_tags(d, KEY), "normality": lambda d: explore.normality(d, KEY, "v"), "shapiro": lambda d: explore.shapiro_wilk(d, KEY, "v"), "temporal": lambda d: series.temporal_aggregate(d.withColumn("ts", F.timestamp_seconds("i")), KEY, "ts", "v", "hour"),
}


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b) or abs(a - b) <= 1e-9 * max(1, abs(a))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return a == b


def of_keys(df, keys="ab"):
    return sorted((tuple(r) for r in df.collect() if r["k"] is not None and r["k"] in keys), key=str)


@pytest.fixture(scope="module")
def frames(spark):
    return (spark.createDataFrame(clean_rows(), SCHEMA), spark.createDataFrame(clean_rows() + odd_rows(), SCHEMA).repartition(3))


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_rows_are_kept_and_other_keys_untouched(frames, name):
    clean, odd = frames
    out = PER_ROW[name](odd)
    rows = out.collect()
    assert len(rows) == len(clean_rows()) + len(odd_rows())
    alone, among = of_keys(PER_ROW[name](clean)), sorted((tuple(r) for r in rows if r["k"] in ("a", "b")), key=str)
    assert len(alone) == len(among) == 80 and all(same(a, b) for a, b in zip(alone, among, strict=True))


@pytest.mark.parametrize("name", sorted(PER_KEY))
def test_tables_by_key_take_odd_rows(frames, name):
    clean, odd = frames
    alone, among = of_keys(PER_KEY[name](clean)), of_keys(PER_KEY[name](odd))
    assert len(alone) == len(among) and all(same(a, b) for a, b in zip(alone, among, strict=True))


def test_a_nan_leaves_only_its_own_row_without_a_score(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, float("nan"), 2.0, 50.0])], "k string, i long, v double")
    got = {r["i"]: (r["score"], r["tag"]) for r in record.detect(df, "zscore", Settings(KEY, ["v"], threshold=1.0)).collect()}
    assert got[1] == (None, "I") and got[3][1] == "O" and got[0][1] == got[2][1] == "N"


def test_a_null_error_keeps_a_monitor_going(spark):
    errors = [0, 1, 0, None, 1, 1, 0, 1]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(errors)], "k string, i long, e int")
    z = [r["z"] for r in drift.ecdd(df, KEY, "e", *AT, 0.2, 2.0).orderBy("i").collect()]
    without = [r["z"] for r in drift.ecdd(df.where("e IS NOT NULL"), KEY, "e", *AT, 0.2, 2.0).orderBy("i").collect()]
    assert z[:3] + z[4:] == pytest.approx(without) and z[3] == z[2]


@pytest.mark.parametrize("name", ["zscore_multi_weighted", "mahalanobis_2d"])
def test_rows_of_few_keys_are_not_dealt_by_key(spark, name):
    """A model of few keys goes to the rows, however large Spark takes it to be."""
    from quietsignal.plans.catalogue import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_windows_of_the_table_function_come_row_by_row(spark):
    """A frame and a batch for each window took three times as long."""
    from quietsignal.plans import sql

    sql.register(spark)
    assert sql.NeighborhoodScore.evalType == PythonEvalType.SQL_TABLE_UDF
