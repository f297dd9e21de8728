"""One-step-ahead prediction that puts its prediction in the place of an outlier, so one does not spoil the next."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField

from quietsignal.functions.score import number
from quietsignal.operators.fold import ordered_fold
from quietsignal.operators.series import T95


def predict(window: list[float], how: str, weights: list[float] | None, smoothing: float) -> float:
    if how == "average":
        return float(np.mean(window))
    if how == "weightedAverage":
        own = np.array(weights or range(len(window), 0, -1), float)[: len(window)]
        return float(np.dot(own, window[::-1]) / own.sum())
    if how == "exponentialSmoothing":
        level = window[0]
        for x in window[1:]:
            level = smoothing * x + (1 - smoothing) * level
        return float(level)
    raise ValueError(f"unknown prediction {how!r}")


def replacing(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, window: int, threshold: float, how: str = "average", weights: list[float] | None = None, smoothing: float = 0.5, least: int = 5, exp_const: float = 1.0) -> DataFrame:
    """``prediction`` and ``score`` as in ``series.one_step_ahead``, with outliers' values replaced in the window.

    Feedback makes this a recursion: a key's rows pass in order, and the window and three sums stay.  A null value has a
    prediction and no score, and its prediction takes its place in the window.
    """
    from collections import deque

    def step(state: tuple, part: pd.DataFrame) -> tuple[tuple, list[list]]:
        values, n, total, squares = state
        predictions, scores = [], []
        for x in part["__x"].to_numpy(float):
            p, score, gone = None, 0.0, x != x
            if len(values) == window:
                p = predict(list(values), how, weights, smoothing)
                if n >= least and not gone:
                    sd = math.sqrt(max(0.0, squares / n - (total / n) ** 2))
                    width = (T95[n - 2] if n - 2 < len(T95) else 1.96) * sd * math.sqrt(1 + 1 / n)
                    score = 1 - math.exp(-exp_const * abs(p - x) / width) if width > 0 else 0.0
                if score <= threshold and not gone:
                    n, total, squares = n + 1, total + p - x, squares + (p - x) ** 2
            if p is not None or not gone:
                values.append(p if gone or score > threshold else x)
            predictions.append(p)
            scores.append(None if gone else score)
        return (values, n, total, squares), [predictions, scores]

    added = [StructField("prediction", DoubleType()), StructField("score", DoubleType())]
    begin = lambda _: (deque(maxlen=window), 0, 0.0, 0.0)
    return ordered_fold(df.withColumn("__x", number(attr)), keys, [seq, tie], ["__x"], begin, step, added).drop("__x")
