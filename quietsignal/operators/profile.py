"""The nearest window of each window of a series: a matrix profile in blocks.

1. A series is cut into blocks of window starts, and every block is searched against itself first.
2. Then two blocks meet at a time, each pair once for both.  Squared distances run along the diagonals of the pair: that of
   two windows is that of the two before them, less one difference and plus another, so a cell costs the same for any
   window, and memory is in proportion to a block's length, not its square.
3. Windows a and b of w values differ by at least w ((mean a - mean b)^2 + (sd a - sd b)^2).  A piece of a pair in which no
   window can find a nearer one by that bound than it has is left out.

Distances found are worked out again from the values, so running sums leave no rounding behind.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietsignal.functions.score import number
from quietsignal.operators import models

#: Window starts in a block, and in a piece of a pair of blocks.
BLOCK, PIECE = 8192, 2048


class Part(NamedTuple):
    """Values from a window start on, its number in the series, and how near the nearest is so far (squared sums)."""

    values: np.ndarray
    first: int
    best: np.ndarray
    sound: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, window: int) -> Part:
        rows = rows.sort_values("__at")
        x = rows["__v"].to_numpy(float)
        n = max(0, len(x) - window + 1)
        gone = np.isnan(x)
        x = np.where(gone, 0.0, x)
        wide = np.lib.stride_tricks.sliding_window_view(x, window) if n else np.zeros((0, window))
        sound = ~np.lib.stride_tricks.sliding_window_view(gone, window).any(1) if n else np.zeros(0, bool)
        best = rows["__best"].to_numpy(float)[:n] if "__best" in rows else np.full(n, np.inf)
        return cls(x, int(rows["__at"].iloc[0]) if len(rows) else 0, np.where(np.isnan(best), np.inf, best).copy(), sound, wide.mean(1), wide.std(1))


def least_difference(a: Part, i: slice, b: Part, j: slice, window: int) -> np.ndarray:
    """For each window of ``i`` a bound below its squared sums with all of ``j``."""
    own = b.sound[j]
    if not own.any():
        return np.full(len(a.mean[i]), np.inf)
    total = np.zeros(len(a.mean[i]))
    for x, y in ((a.mean[i], b.mean[j][own]), (a.sd[i], b.sd[j][own])):
        total += np.maximum(np.maximum(y.min() - x, x - y.max()), 0) ** 2
    return window * total * (1 - 1e-9) - 1e-9


def search(a: Part, b: Part, window: int, apart: bool, same: bool, both: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """For the windows of ``a`` and of ``b`` the place of their nearest in the other (-1: none nearer), and the cells worked out.

    ``best`` of both parts is lowered on the way.  ``apart``: windows that overlap do not count; ``same``: the parts are one.
    """
    near = np.full(len(a.best), -1), np.full(len(b.best), -1)
    cells = 0
    pieces = lambda n: [slice(k, min(k + PIECE, n)) for k in range(0, n, PIECE)]
    # Of one part the pieces meet themselves first, so that every window has some distance to be bounded by.
    order = sorted(((i, j) for i in pieces(len(a.best)) for j in pieces(len(b.best)) if not same or j.start >= i.start), key=lambda p: abs(p[0].start - p[1].start) if same else 0)
    for i, j in order:
        wanted = (least_difference(a, i, b, j, window) < a.best[i]) & a.sound[i]
        if not wanted.any() and not (both and ((least_difference(b, j, a, i, window) < b.best[j]) & b.sound[j]).any()):
            continue
        cells += (i.stop - i.start) * (j.stop - j.start)
        walk(a, i, b, j, window, apart, both, near)
    return *near, cells


def walk(a: Part, i: slice, b: Part, j: slice, window: int, apart: bool, both: bool, near: tuple[np.ndarray, np.ndarray]) -> None:
    x, y = a.values, b.values
    wide, bad = j.stop - j.start, ~b.sound[j]
    columns = y[j.start : j.stop + window - 1]
    # The first column: distances of each window of ``i`` to the first of ``j``.
    first = ((np.lib.stride_tricks.sliding_window_view(x[i.start : i.stop + window - 1], window) - columns[:window]) ** 2).sum(1)
    row = ((np.lib.stride_tricks.sliding_window_view(columns, window) - x[i.start : i.start + window]) ** 2).sum(1)
    here = b.first + np.arange(j.start, j.stop)
    for u in range(i.start, i.stop):
        if u > i.start:
            moved = row[:-1] - (x[u - 1] - columns[: wide - 1]) ** 2 + (x[u + window - 1] - columns[window : window + wide - 1]) ** 2
            row = np.concatenate([first[u - i.start : u - i.start + 1], moved])
        if not a.sound[u]:
            continue
        seen = np.where(bad, np.inf, row)
        if apart:
            seen[np.abs(here - (a.first + u)) < window] = np.inf
        k = int(seen.argmin())
        if seen[k] < a.best[u]:
            a.best[u], near[0][u] = max(seen[k], 0.0), j.start + k
        if both:
            nearer = seen < b.best[j]
            if nearer.any():
                at = j.start + np.flatnonzero(nearer)
                b.best[at], near[1][at] = np.maximum(seen[nearer], 0.0), u


def exact(a: Part, b: Part, near: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows that found one, and their squared sums from the values."""
    at = np.flatnonzero(near >= 0)
    if not len(at):
        return at, np.zeros(0)
    p, q = (np.lib.stride_tricks.sliding_window_view(v, window) for v in (a.values, b.values))
    return a.first + at, ((p[at] - q[near[at]]) ** 2).sum(1)


def nearest_windows(rows: DataFrame, own: list[str], attr: str, window: int, given: DataFrame | None = None) -> DataFrame:
    """own, __at, __d: for each window start of ``rows`` (own, __at, attr) the distance to the nearest window, if there is one."""
    size = max(BLOCK, 2 * window)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in own)
    schema, apart = f"{fields}, __at int, __best double", given is None

    def blocks(of: DataFrame) -> DataFrame:
        """Rows by block; the first of a block also end the windows of the block before."""
        block = F.floor(F.col("__at") / size).cast("int")
        two = F.when((block > 0) & (F.col("__at") % size < window - 1), F.array(block - 1, block)).otherwise(F.array(block))
        return of.select(*own, "__at", number(attr).alias("__v"), F.explode(two).alias("__b"))

    def counted(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy(*own).agg(F.ceil(F.greatest(F.count("*") - window + 1, F.lit(0)) / size).cast("int").alias(name))

    def named(part: pd.DataFrame, at: np.ndarray, best: np.ndarray) -> pd.DataFrame:
        if not len(at):
            return part.iloc[:0].assign(__best=0.0)[[*own, "__at", "__best"]]
        return pd.DataFrame({**{k: [part[k].iloc[0]] * len(at) for k in own}, "__at": at.astype("int32"), "__best": best})

    def at_home(part: pd.DataFrame) -> pd.DataFrame:
        a = Part.of(part, window)
        near, other, _ = search(a, a, window, True, True, True)
        found = [exact(a, a, near, window), exact(a, a, other, window)]
        return named(part, *(np.concatenate(c) for c in zip(*found, strict=True)))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        a, b = Part.of(part[part["__ask"]], window), Part.of(part[~part["__ask"]], window)
        near, other, _ = search(a, b, window, apart, False, apart)
        found = [exact(a, b, near, window), *([exact(b, a, other, window)] if apart else [])]
        return named(part, *(np.concatenate(c) for c in zip(*found, strict=True)))

    asks, gives = blocks(rows), blocks(rows if apart else given)
    sizes = models.attach(counted(rows, "__n"), counted(rows if apart else given, "__m"), own)
    sent = [*own, "__i", "__j", "__ask", "__at", "__v", "__best"]
    home = None
    if apart:
        home = models.spread(asks, [*own, "__b"]).groupBy(*own, "__b").applyInPandas(at_home, schema).groupBy(*own, "__at").agg(F.min("__best").alias("__best"))
        asks = models.attach(asks, home, [*own, "__at"])
        gives = asks
    else:
        asks, gives = (x.withColumn("__best", F.lit(None).cast("double")) for x in (asks, gives))
    first = (F.col("__b") + 1) if apart else F.lit(0)
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last))
    asking = models.attach(asks, sizes, own).where(F.col("__b") < F.col("__n")).withColumn("__i", F.col("__b")).withColumn("__j", F.explode(F.when(first < F.col("__m"), F.sequence(first, F.col("__m") - 1)))).withColumn("__ask", F.lit(True))
    last = (F.col("__b") - 1) if apart else F.col("__n") - 1
    giving = models.attach(gives, sizes, own).where(F.col("__b") < F.col("__m")).withColumn("__j", F.col("__b")).withColumn("__i", F.explode(upto(last))).withColumn("__ask", F.lit(False))
    found = models.spread(asking.select(*sent).unionByName(giving.select(*sent)), [*own, "__i", "__j"]).groupBy(*own, "__i", "__j").applyInPandas(meet, schema)
    both = found if home is None else home.unionByName(found)
    return both.groupBy(*own, "__at").agg(F.sqrt(F.min("__best") / window).alias("__d"))
