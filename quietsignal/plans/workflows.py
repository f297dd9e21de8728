"""Chains of detectors that are used together, as one call each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietsignal.functions.score import tag
from quietsignal.operators import alerts, record
from quietsignal.operators.record import Settings


def clean_and_refit(df: DataFrame, strategy: str, s: Settings, loose: float) -> DataFrame:
    """Detect with a loose threshold, drop those outliers, fit again on the rest, and detect on all rows."""
    first = record.detect(df, strategy, replace(s, threshold=loose))
    return record.detect(df, strategy, s, reference=record.clean(first))


def chain_roll_up(df: DataFrame, hierarchy: DataFrame, levels: int, how: str = "average") -> DataFrame:
    """The tagged streams of ``levels`` successive parents, one above the other."""
    out = None
    for _ in range(levels):
        df = alerts.roll_up(df, hierarchy, how)
        out = df if out is None else out.unionByName(df)
    return out


def feedback_threshold(scored: DataFrame, keys: list[str], positive: Column, splits: list[float], criterion: str = "entropy") -> DataFrame:
    """Scores with users' verdicts to the best threshold by key."""
    return alerts.best_split(alerts.learn_threshold(scored, keys, positive, splits, criterion), keys)


def retag_by_tail(scored: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Tag again by the ``share`` percentile of each key's scores."""
    name = f"p{round(100 * share)}"
    limits = alerts.score_tail(scored, keys, [share]).withColumnRenamed(name, "threshold")
    return record.keyed_threshold(scored.drop("tag"), limits, keys)


def discretise_and_predict(train: DataFrame, test: DataFrame, keys: list[str], attr: str, width: float, seq: str, tie: str, states: list[str], **markov_settings) -> DataFrame:
    """Fixed-width levels of ``attr``, a transition model of the training levels, Markov scores of the test levels."""
    from quietsignal.operators import models, series

    level = models.bin_of(F.col(attr), width).cast("string")
    model = series.transition_model(train.withColumn("level", level), keys, "level", seq, tie, states)
    return series.markov(test.withColumn("level", level), model, keys, "level", seq, tie, **markov_settings)


def reference_discord(df: DataFrame, reference: Column, keys: list[str], attr: str, seq: str, tie: str, window: int, threshold: float) -> DataFrame:
    """Rows where ``reference`` holds are the normal series; the others are scored against them."""
    from quietsignal.operators import series

    out = series.discord(df.where(~reference), keys, attr, seq, tie, window, df.where(reference))
    return out.withColumn("tag", tag(F.col("score"), threshold))


def median_detect(df: DataFrame, s: Settings) -> DataFrame:
    """Medians, then median absolute deviations, then robust scores and tags."""
    return record.detect(df, "robustZscore", s)
