"""Quality classifier: Bradley-Terry pairwise ranking.

A document's worth is a linear function of text statistics.  It is learned from all preference pairs (a document
marked good, one marked bad) of all labelled rows, by logistic loss on the difference of their features, as in the
Bradley-Terry model; a document is then accepted when its worth reaches the quantile of the training worths that
leaves the share of bad documents below it.  The score is the logistic function of the distance to that threshold.

The loss of all pairs takes no square of time: it depends on the features through worths only, and what one
document loses to all of the other class is a smooth function of its worth, read from a fine grid of their worths.
Each step of the fit is two sums over the rows; the driver holds grids and matrices of fixed size.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsignal.llm.common import apart, crc_of_id, released, table

#: Step of the grid of worths (its points stand for the rows between them to a millionth of a probability), points of
#: the coarse grid that the curvature is taken from, bins in the search for a quantile, and most tasks of a sum.
STEP, COARSE, BINS, MOST_TASKS = 1 / 128, 1024, 4096, 32
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; rates are compressed by log1p.  Null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    rates = [*counts[PUNCTUATION], upper, digits, counts[10], counts[128:].sum(), counts[PUNCTUATION].sum()]
    same = sum(map(operator.eq, words, words[1:]))
    shape = [
        np.log1p(len(words)), len(set(words)) / m, len(set(words)) / m * np.log1p(len(words)), len(raw) / m / 10, same / m, len(set(lines)) / len(lines),
        upper / max(1.0, upper + lower), sum(w.isalpha() for w in words) / m, sum(len(w) <= 3 for w in words) / m, max(map(len, words), default=0) ** 0.5 / 10,
    ]
    return np.concatenate([np.log1p(1000 * np.array(rates) / n), shape])


WIDTH = len(features(""))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: Sums ``work(x, y)``, a flat array, over all training rows: x their features, y 1 for good and 0 for bad.
Sums = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def softplus(d: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, d)


def logistic(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def slope_of_logistic(d: np.ndarray) -> np.ndarray:
    return logistic(d) * logistic(-d)


def on_grid(at: np.ndarray, low: float, step: float, n: int, columns: np.ndarray | None = None) -> np.ndarray:
    """Rows (or sums of their ``columns``) by grid point; a row counts for the two points around it by its nearness."""
    place = (at - low) / step
    i = np.clip(place.astype(int), 0, n - 2)
    part = place - i
    both = lambda x: np.bincount(i, (1 - part) * x, n) + np.bincount(i + 1, part * x, n)
    return both(1.0) if columns is None else np.stack([both(x) for x in columns.T], 1)


def against(kernel: Callable[[np.ndarray], np.ndarray], mass: np.ndarray, step: float) -> np.ndarray:
    """Sum over the grid's points j of mass[j] * kernel(t[j] - t[i]), for each point i."""
    n = len(mass)
    long = 1 << (3 * n).bit_length()
    values = kernel(-step * np.arange(1 - n, n))
    return np.fft.irfft(np.fft.rfft(mass, long) * np.fft.rfft(values, long), long)[n - 1 : 2 * n - 1]


def at_ranks(every: Sums, worths: Callable[[np.ndarray], np.ndarray], ranks: list[int], reach: float) -> list[float]:
    """The worths of these ranks (0: the smallest) among all rows, to 12 digits; all are within ``reach`` of 0."""
    ranges = [(-reach, reach)] * len(ranks)
    for _ in range(5):

        def work(x: np.ndarray, y: np.ndarray, ranges=tuple(ranges)) -> np.ndarray:
            u, out = worths(x), []
            for low, high in ranges:
                own = u[(u >= low) & (u <= high)]
                place = np.minimum((own - low) * (BINS / (high - low)), BINS - 1).astype(int)
                out += [[np.sum(u < low)], np.bincount(place, minlength=BINS)]
            return np.concatenate(out).astype(float)

        found = every(work).reshape(len(ranks), BINS + 1)
        for k, (rank, counts) in enumerate(zip(ranks, found, strict=True)):
            (low, high), c = ranges[k], int(np.searchsorted(np.cumsum(counts)[1:], rank, "right"))
            wide = (high - low) / BINS
            if wide > 1e-13:  # a bin more on either side, for rows that rounding moves
                ranges[k] = (max(low, low + (c - 1) * wide), min(high, low + (c + 2) * wide))
    return [(low + high) / 2 for low, high in ranges]


def bradley_terry(every: Sums, ridge: float = 1e-3) -> Model:
    """Fit by Newton's method on all preference pairs.

    With no good or no bad rows nothing can be preferred: all worths are 0 and the one class decides.
    """
    first = every(lambda x, y: np.concatenate([[np.sum(y == 1), np.sum(y == 0)], x.sum(0)]))
    good, bad = first[:2]
    if not good or not bad:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), -1.0 if good or not bad else 1.0)
    mean = first[2:] / (good + bad)
    scale = np.sqrt(every(lambda x, y: ((x - mean) ** 2).sum(0)) / (good + bad))
    scale[scale < 1e-9] = 1

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -8, 8)

    def reach(w: np.ndarray) -> float:
        return STEP * (math.ceil(8 * np.abs(w).sum() / STEP) + 1)

    def spread(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The grid, the shares of good and of bad rows at its points, and the loss."""
        low = -reach(w)
        n = round(-2 * low / STEP) + 1
        found = every(lambda x, y: np.concatenate([on_grid(scaled(x[y == k]) @ w, low, STEP, n) for k in (1, 0)]))
        g, b = found[:n] / good, found[n:] / bad
        return low + STEP * np.arange(n), g, b, float(g @ against(softplus, b, STEP) + ridge * w @ w / 2)

    w = np.zeros(WIDTH)
    grid, g, b, now = spread(w)
    far = math.sqrt(2 * now / ridge) + 1  # weights beyond lose more than none do; this bounds the grid
    for _ in range(30):
        some = np.flatnonzero(g + b)
        low, high = grid[some[0]], grid[some[-1]]
        wide = max(STEP, (high - low) / (COARSE - 1))
        # What a good row of a worth loses to all bad ones, a bad row of a worth to all good ones, and the curvatures.
        lost = {1: (against(logistic, b, STEP), against(slope_of_logistic, b, STEP)), 0: (against(lambda d: logistic(-d), g, STEP), against(slope_of_logistic, g, STEP))}
        lost = {k: [x[some[0] : some[-1] + 1] for x in v] for k, v in lost.items()}
        inside = grid[some[0] : some[-1] + 1]

        def work(x: np.ndarray, y: np.ndarray, w=w, lost=lost, inside=inside, low=low, wide=wide) -> np.ndarray:
            out = []
            for k in (1, 0):
                z = scaled(x[y == k])
                u = z @ w
                p, q = (np.interp(u, inside, v) for v in lost[k])
                out += [p @ z, ((z * q[:, None]).T @ z).ravel(), on_grid(u, low, wide, COARSE, z).ravel()]
            return np.concatenate(out)

        won, beaten = every(work).reshape(2, -1) / np.array([[good], [bad]])
        cut = np.cumsum([WIDTH, WIDTH * WIDTH])
        (p, own, x), (q, other, y) = (np.split(v, cut) for v in (won, beaten))
        points = wide * np.arange(COARSE)
        cross = x.reshape(COARSE, WIDTH).T @ slope_of_logistic(points[:, None] - points) @ y.reshape(COARSE, WIDTH)
        # The curvature is at least the ridge in every direction.
        size, turn = np.linalg.eigh((own + other).reshape(WIDTH, WIDTH) - cross - cross.T + ridge * np.eye(WIDTH))
        step, rate = turn @ (turn.T @ (q - p + ridge * w) / np.maximum(size, ridge)), 1.0
        while np.linalg.norm(w - rate * step) > far:
            rate /= 2
        least, found = rate / 10_000, spread(w - rate * step)
        while rate > least and found[3] > now + 1e-7:
            rate /= 2
            found = spread(w - rate * step)
        w = w - rate * step
        grid, g, b, now = found
        if np.abs(rate * step).max() < 1e-7:
            break
    ranks = [int(bad) - 1, int(bad)]  # the quantile lies between the last worth below it and the next
    return Model(mean, scale, w, sum(at_ranks(every, lambda x: scaled(x) @ w, ranks, reach(w))) / 2)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["y", "x"])


def over(rows: DataFrame) -> Sums:
    """Sums over rows (y, x: the bytes of their features; persisted) in at most MOST_TASKS tasks."""
    few = rows.coalesce(min(MOST_TASKS, max(1, rows.sparkSession.sparkContext.defaultParallelism)))

    def every(work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, WIDTH)
                part = work(x, batch.column(0).to_numpy())
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["total"])

        total = work(np.zeros((0, WIDTH)), np.zeros(0, np.int32))
        for r in few.mapInArrow(released(task), "total binary").collect():
            total = total + np.frombuffer(zlib.decompress(r["total"]))
        return total

    return every


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Learn from all labelled rows with ``usable``.

    Rows without quality or doc_id are left out; of repeated labels the better counts; of repeated ids the smallest text.
    """
    own = labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).where("y IN (0, 1)")
    # Of the texts only those that a filter of the labelled ids lets through are shuffled.
    some = apart(docs.select("doc_id", "text"), own.select("doc_id"))[1]
    rows = some.join(own, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    kept = rows.select("y", "text").mapInArrow(released(_features), "y int, x binary").persist(StorageLevel.DISK_ONLY)
    try:
        return bradley_terry(over(kept))
    finally:
        kept.unpersist(blocking=True)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts are scored by the statistics of an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, WIDTH)
            yield pa.record_batch([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns.

    Null and empty texts are judged by the statistics of an empty text; rows stay whole, repeated ones and those
    with a null id too.  An empty table stays empty.
    """
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(schema.names.index("text"))]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(released(work), schema)


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_of_id("doc_id") % 3 == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
