"""Quantiles by key: exact by narrowing, sketches within their error, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietsignal.operators import alerts, models

SHARES = {"least": 0.0, "q1": 0.01, "q25": 0.25, "med": 0.5, "q99": 0.99, "most": 1.0}


def tables(spark):
    r = np.random.default_rng(7)
    sets = {"wide": r.normal(size=3000), "copies": np.repeat([1.0, 2.0, 5.0], [900, 1200, 3]), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "flat": np.full(50, 3.0), None: r.integers(0, 9, 400).astype(float)}
    rows = [(k, float(x)) for k, xs in sets.items() for x in xs] + [("wide", None), ("wide", float("nan")), ("wide", float("inf")), ("empty", None)]
    return sets, spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("how", ["narrowed", "whole"])
@pytest.mark.parametrize("sketch", [10_000, 20])
def test_exact_quantiles(spark, monkeypatch, how, sketch):
    monkeypatch.setattr(models, "SKETCH", sketch)
    sets, df = tables(spark)
    got = {r["k"]: r for r in models.percentiles(df, ["k"], ["v"], SHARES, how).collect()}
    assert set(got) == {*sets, "empty"} and all(got["empty"][f"v_{n}"] is None for n in SHARES)
    for k, xs in sets.items():
        for n, p in SHARES.items():
            assert got[k][f"v_{n}"] == pytest.approx(float(np.quantile(xs, p)))


def test_no_task_holds_all_values_of_a_key(spark):
    """The plan has sketches and counts, and no map of a key's values."""
    _, df = tables(spark)
    plan = models.percentiles(df, ["k"], ["v"], {"med": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and " percentile(" not in plan


def test_sketches_keep_their_error(spark):
    sets, df = tables(spark)
    got = {r["k"]: r for r in models.percentiles(df, ["k"], ["v"], SHARES, "sketch").collect()}
    for k, xs in sets.items():
        for n, p in SHARES.items():
            rank = [(np.sum(xs < got[k][f"v_{n}"])), np.sum(xs <= got[k][f"v_{n}"])]
            assert rank[0] - 1 - len(xs) / models.SKETCH <= p * len(xs) <= rank[1] + 1 + len(xs) / models.SKETCH
    with pytest.raises(ValueError):
        models.percentiles(df, ["k"], ["v"], SHARES, "other")


@pytest.mark.parametrize("how", ["narrowed", "whole", "sketch"])
def test_medians_and_tails(spark, how):
    sets, df = tables(spark)
    got = {r["k"]: r for r in models.medians(df, ["k"], ["v"], how).collect()}
    room = 0 if how != "sketch" else 0.02
    for k, xs in sets.items():
        if how != "sketch" or len(xs) > 50:
            assert got[k]["v_med"] == pytest.approx(np.median(xs), abs=1e-9 + room) and got[k]["v_mad"] == pytest.approx(np.median(np.abs(xs - np.median(xs))), abs=1e-9 + room)
    whole = alerts.score_tail(df.withColumnRenamed("v", "score"), [], [0.5], how).first()
    assert whole["p50"] == pytest.approx(float(np.median(np.concatenate(list(sets.values())))), abs=1e-9 + room)


def test_an_empty_table(spark):
    _, df = tables(spark)
    assert models.medians(df.where("false"), ["k"], ["v"]).count() == 0 and models.percentiles(df.where(F.lit(False)), [], ["v"], SHARES).count() == 0
