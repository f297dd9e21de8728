"""Detectors that rebuild a row from fewer dimensions: principal components, an autoencoder, a smoothed spectrum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietsignal.functions.score import exp_scale, sequence, tag
from quietsignal.operators import models


def fit_components(df: DataFrame, keys: list[str], attrs: list[str], count: int) -> DataFrame:
    """keys, means, components (``count`` eigenvectors of the covariance, flattened), by one aggregation and a small matrix a key."""

    @F.pandas_udf("array<double>")
    def leading(cells: pd.Series) -> pd.Series:
        def one(x):
            k = round(len(x) ** 0.5)
            m = np.array(x, float).reshape(k, k)
            if not np.isfinite(m).all():
                return None
            vectors = np.linalg.eigh(m)[1][:, ::-1][:, :count].T
            return vectors.ravel().tolist()

        return cells.map(one)

    return models.covariance(df, keys, attrs).withColumn("components", leading("cov")).drop("cov", "n")


def reconstruction_error(df: DataFrame, model: DataFrame, keys: list[str], attrs: list[str], count: int, exp_const: float = 0.0, threshold: float | None = None) -> DataFrame:
    """Length of what the leading components leave of a row; a key without a model is tagged I."""
    base = df if keys else df.withColumn(models.ALL, F.lit("all"))
    out = models.attach(base, model, keys or [models.ALL])
    d = [F.col(a).cast("double") - F.get("means", F.lit(i)) for i, a in enumerate(attrs)]
    n = len(attrs)
    scores = [sum((F.get("components", F.lit(c * n + i)) * d[i] for i in range(n)), F.lit(0.0)) for c in range(count)]
    rest = [d[i] - sum((F.get("components", F.lit(c * n + i)) * scores[c] for c in range(count)), F.lit(0.0)) for i in range(n)]
    error = F.sqrt(sum((r * r for r in rest), F.lit(0.0)))
    out = out.withColumn("score", exp_scale(exp_const, error) if exp_const > 0 else error)
    return out.withColumn("tag", tag(F.col("score"), threshold)).drop("means", "components", *([] if keys else [models.ALL]))


@dataclass
class Autoencoder:
    """One hidden layer, tanh, trained by Adam on standardised rows; deterministic for a seed."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, hidden: int, rounds: int = 300, rate: float = 0.02, seed: int = 5) -> Autoencoder:
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1
        z, n = (x - mean) / scale, x.shape[1]
        w = [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, n)), np.zeros(n)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, rounds + 1):
            h = np.tanh(z @ w[0] + w[1])
            e = 2 * (h @ w[2] + w[3] - z) / len(z)
            back = (e @ w[2].T) * (1 - h * h)
            for i, g in enumerate((z.T @ back, back.sum(0), h.T @ e, e.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return cls(mean, scale, w)

    def error(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        return np.sqrt(((h @ self.weights[2] + self.weights[3] - z) ** 2).mean(1))


def fit_autoencoder(df: DataFrame, attrs: list[str], hidden: int, sample: int = 10_000, **settings) -> Autoencoder:
    """Train on at most ``sample`` rows, those with the smallest hash of their values."""
    rows = df.select(*[F.col(a).cast("double") for a in attrs]).dropna().orderBy(F.xxhash64(*attrs), *attrs).limit(sample).toPandas()
    return Autoencoder.fit(rows.to_numpy(float), hidden, **settings)


def regeneration_error(df: DataFrame, attrs: list[str], model: Autoencoder) -> DataFrame:
    """Root mean square error of the rebuilt row; a null attribute gives a null score."""

    @F.pandas_udf("double")
    def error(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.error(x.to_numpy(float))).where(x.notna().all(axis=1).to_numpy())

    return df.withColumn("score", error(F.struct(*[F.col(a).cast("double").alias(a) for a in attrs])))


def spectral_residue(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, block: int, smooth: int = 5, local: int = 3, exp_const: float = 0.0) -> DataFrame:
    """Saliency by spectral residue in blocks of ``block`` rows that do not overlap; a block not full scores 0.

    The log amplitude less its moving average goes back with the old phase; the score is the amplitude less its
    local moving average.  Blocks, not keys, are the groups, so no task holds a whole series.
    """
    def average(x: np.ndarray, w: int) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (w // 2, w - 1 - w // 2)), mode="edge")
        return np.lib.stride_tricks.sliding_window_view(wide, w, axis=1).mean(2)

    @F.pandas_udf("array<double>")
    def saliency(blocks: pd.Series) -> pd.Series:
        full = [i for i, b in enumerate(blocks) if len(b) == block]
        out = [[0.0] * len(b) for b in blocks]
        if full:
            f = np.fft.fft(np.stack([blocks.iloc[i] for i in full]).astype(float), axis=1)
            log = np.log(np.maximum(np.abs(f), 1e-12))
            s = np.abs(np.fft.ifft(np.exp(log - average(log, smooth) + 1j * np.angle(f)), axis=1))
            score = np.abs(s - average(s, local))
            for i, row in zip(full, 1 - np.exp(-exp_const * score) if exp_const > 0 else score, strict=True):
                out[i] = row.tolist()
        return pd.Series(out)

    fields = df.columns
    at = F.floor((F.row_number().over(sequence(keys, [seq, tie])) - 1) / block).cast("long")
    first = [seq] if tie == seq else [seq, tie]
    rows = F.array_sort(F.collect_list(F.struct(*first, F.struct(*fields).alias("__row"))))
    grouped = df.withColumn("__block", at).groupBy(*keys, "__block").agg(rows.alias("__rows"))
    scored = grouped.withColumn("__scores", saliency(F.transform("__rows", lambda r: r["__row"][attr].cast("double"))))
    each = scored.select(F.explode(F.arrays_zip("__rows", "__scores")).alias("z"))
    return each.select(*[F.col(f"z.__rows.__row.{c}").alias(c) for c in fields], F.col("z.__scores").alias("score"))


__all__ = ["Autoencoder", "fit_autoencoder", "fit_components", "reconstruction_error", "regeneration_error", "spectral_residue"]
