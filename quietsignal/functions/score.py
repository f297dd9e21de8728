"""Column expressions that all detectors share: scaling, combination, tags, and spreading along a sequence."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

OUTLIER, NORMAL, UNKNOWN, AMBIGUOUS = "O", "N", "I", "A"


def number(c: Column | str) -> Column:
    """A column as a double; NaN and infinities are nulls, so that one leaves its own row without a score and no other."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def exp_scale(constant: float, score: Column) -> Column:
    """1 - exp(-constant * score): 0 stays 0 and large scores come near 1."""
    return F.lit(1.0) - F.exp(F.lit(-float(constant)) * score)


def logistic_scale(steepness: float, x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(-float(steepness)) * x))))


def combine(scores: list[Column], how: str = "average", weights: list[float] | None = None) -> Column:
    """One score from those of several attributes; null ones are unavailable and left out; none available gives null.

    ``how``: average, weightedAverage (weights over the available ones), median, max or min.
    """
    if how == "weightedAverage":
        if not weights or len(weights) != len(scores):
            raise ValueError("weightedAverage needs a weight for each score")
        total = reduce(add, [F.coalesce(s * w, F.lit(0.0)) for s, w in zip(scores, weights, strict=True)])
        return F.try_divide(total, reduce(add, [F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in zip(scores, weights, strict=True)]))
    own = F.array_compact(F.array(*scores))
    if how == "average":
        return F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.size(own))
    if how == "median":
        ranked = F.array_sort(own)
        n = F.size(ranked)
        return (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2
    if how in ("max", "min"):
        return F.array_max(own) if how == "max" else F.array_min(own)
    raise ValueError(f"unknown combination {how!r}")


def tag(score: Column, threshold: Column | float | None, polarity: str = "high", low: Column | float | None = None) -> Column:
    """O or N by ``threshold``; I without a score (or with NaN); A without a threshold.

    ``polarity``: high (score above threshold), low (below), or both / all (above threshold or below ``low``).
    """
    limit = F.lit(None).cast("double") if threshold is None else threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if polarity == "high":
        out = score > limit
    elif polarity == "low":
        out = score < limit
    elif polarity in ("both", "all"):
        floor = F.lit(None).cast("double") if low is None else low if isinstance(low, Column) else F.lit(float(low))
        limit = F.when(floor.isNotNull(), limit)
        out = (score > limit) | (score < floor)
    else:
        raise ValueError(f"unknown polarity {polarity!r}")
    return F.when(score.isNull() | F.isnan(score), UNKNOWN).when(limit.isNull(), AMBIGUOUS).when(out, OUTLIER).otherwise(NORMAL)


def sequence(keys: list[str], order: list[str]) -> WindowSpec:
    """Rows of a key in order; without keys all rows share the key ``all``."""
    return Window.partitionBy(*([F.col(k) for k in keys] or [F.lit("all")])).orderBy(*order)


def spread_back(flag: Column, window: WindowSpec, width: int) -> Column:
    """True where ``flag`` holds on this row or one of the ``width`` - 1 after it."""
    return F.coalesce(F.max(flag.cast("int")).over(window.rowsBetween(0, width - 1)) == 1, F.lit(False))


def round_to(column: Column, digits: int = 4) -> Column:
    return F.round(column.cast("double"), digits)
