"""Exploration of series: moments and normality, Shapiro-Wilk, correlation, partial autocorrelation, additive decomposition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.normal import polynomial, quantile, upper_tail
from quietsignal.functions.score import number, sequence
from quietsignal.operators import models


def normality(df: DataFrame, keys: list[str], attr: str) -> DataFrame:
    """keys, n, skewness, kurtosis (excess) and the Jarque-Bera statistic n / 6 (s^2 + k^2 / 4)."""
    df, own = models.keyed(df, keys)
    out = df.groupBy(*own).agg(F.count(attr).alias("n"), F.skewness(attr).alias("skewness"), F.kurtosis(attr).alias("kurtosis"))
    return out.withColumn("jarque_bera", F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4))


def _expected(i: Column, n: Column) -> Column:
    """What the ``i``-th smallest of ``n`` normal numbers is expected to be, about."""
    return quantile((i - 0.375) / (n + 0.25))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _end_weights(n: Column, squares: Column, e1: Column, e2: Column) -> tuple[Column, Column]:
    """The weights of the largest and the second largest value (null below six, where only the largest is corrected)."""
    u = 1 / F.sqrt(n.cast("double"))
    # The published polynomials of the normality test's two end weights (AS R94).
    first = F.try_divide(e1, F.sqrt(squares)) + polynomial([0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], u)
    second = F.try_divide(e2, F.sqrt(squares)) + polynomial([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
    return F.when(n == 3, F.lit(0.5**0.5)).otherwise(first), F.when(n > 5, second)


def _tail_of_w(w: Column, n: Column) -> Column:
    """The published probability of a statistic this small or smaller for normal numbers, 3 to 5,000 of them."""
    x = F.ln(n.cast("double"))
    k = n.cast("double")
    miss = F.ln(1 - w)
    # Mean and deviation of the transformed statistic, by n up to 11 and by ln n above (AS R94).
    small = (-F.ln(0.459 * k - 2.273 - miss) - polynomial([0.5440, -0.39978, 0.025054, -0.0006714], k)) / F.exp(polynomial([1.3822, -0.77857, 0.062767, -0.0020322], k))
    large = (miss - polynomial([-1.5861, -0.31082, -0.083751, 0.0038915], x)) / F.exp(polynomial([-0.4803, -0.082676, 0.0030302], x))
    three = F.greatest(F.lit(0.0), 1.909859 * (F.asin(F.sqrt(w)) - 1.047198))
    return F.when(w >= 1, 1.0).when(n == 3, three).when(n <= 11, F.when(0.459 * k - 2.273 <= miss, 1e-19).otherwise(upper_tail(small))).otherwise(upper_tail(large))


def shapiro_wilk(df: DataFrame, keys: list[str], attr: str, bins: int = 64, run: int = 4096) -> DataFrame:
    """keys, n, w, p: the Shapiro-Wilk statistic of normality, and its probability for 3 to 5,000 values (null above).

    Nulls, NaN and infinities are left out.  Below three values or without a spread, w and p are null.  Null keys are a key.

    The weights belong to ranks, and ranks are found without sorting a key in one task: equal values become one row with a
    count, a key's span is cut into ``bins``, a row's first rank is what lies in the bins before and before it in its own,
    and many equal values add their weights ``run`` ranks at a time.  A bin's distinct values are sorted by one task.
    """
    df, own = models.keyed(df, keys)
    each = df.select(*own, number(F.col(attr)).alias("__x")).where("__x IS NOT NULL").groupBy(*own, "__x").agg(F.count("*").alias("__c"))
    ends = each.groupBy(*own).agg(F.sum("__c").alias("n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), (F.sum(F.col("__x") * F.col("__c")) / F.sum("__c")).alias("__mean"))
    each = models.attach(each, ends, own).withColumn("__b", F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__x") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * bins)).otherwise(0).cast("int"))
    sizes = each.groupBy(*own, "__b").agg(F.sum("__c").alias("__size"))
    sizes = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(*own).orderBy("__b")) - F.col("__size")).drop("__size")
    each = models.attach(each, sizes, [*own, "__b"])
    inside = F.sum("__c").over(Window.partitionBy(*own, "__b").orderBy("__x")) - F.col("__c")
    each = each.withColumn("__first", F.col("__before") + inside + 1).withColumn("__last", F.col("__first") + F.col("__c") - 1)
    each = each.withColumn("__from", F.explode(F.sequence("__first", "__last", F.lit(run).cast("long"))))
    ranks = F.sequence("__from", F.least("__last", F.col("__from") + run - 1))
    # The ends have weights of their own, so their ranks are left out of the sums by a weight of 0.
    inner = F.when(F.col("n") > 5, 2).otherwise(1)
    sums = F.aggregate(
        ranks, F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("mm")),
        lambda s, i: F.struct((s["m"] + F.when((i > inner) & (i <= F.col("n") - inner), _expected(i, F.col("n"))).otherwise(0.0)).alias("m"), (s["mm"] + F.pow(_expected(i, F.col("n")), 2)).alias("mm")),
    )
    x = F.col("__x") - F.col("__mean")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank <= F.least("__last", F.col("__from") + run - 1)), x))

    each = each.withColumn("__s", sums)
    n = F.col("n")
    found = each.groupBy(*own, "n").agg(
        F.sum(F.col("__s.mm")).alias("__mm"), F.sum(x * F.col("__s.m")).alias("__mx"), F.sum(F.when(F.col("__from") == F.col("__first"), x * x * F.col("__c"))).alias("__ss"),
        *[at(r).alias(name) for name, r in (("__x1", F.lit(1)), ("__x2", F.lit(2)), ("__y2", n - 1), ("__y1", n))],
    )

    def statistic(e: Column, a: Column) -> Column:
        def squares(v: Column) -> Column:
            return v["x1"] * v["x1"] + F.coalesce(v["x2"] * v["x2"], F.lit(0.0))

        rest = F.sqrt(F.try_divide(F.col("__mm") - 2 * squares(e), 1 - 2 * squares(a)))
        middle = F.when(n == 3, 0.0).otherwise(F.try_divide(F.col("__mx"), rest))
        total = middle + a["x1"] * (F.col("__y1") - F.col("__x1")) + F.coalesce(a["x2"] * (F.col("__y2") - F.col("__x2")), F.lit(0.0))
        return F.when((n >= 3) & (F.col("__ss") > 0), F.least(F.lit(1.0), F.try_divide(F.pow(total, 2), F.col("__ss"))))

    def two(first: Column, second: Column) -> Column:
        return F.struct(first.alias("x1"), second.alias("x2"))

    ends = two(_expected(n, n), F.when(n > 5, _expected(n - 1, n)))
    both = _let(ends, lambda e: _let(two(*_end_weights(n, F.col("__mm"), e["x1"], e["x2"])), lambda a: _let(statistic(e, a), lambda w: F.struct(w.alias("w"), F.when(w.isNotNull() & (n <= 5000), _tail_of_w(w, n)).alias("p")))))
    return found.withColumn("__both", both).select(*own, "n", "__both.w", "__both.p")


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, corr: Pearson correlation; null where a side is constant."""
    df, own = models.keyed(df, keys)
    return df.groupBy(*own).agg(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("corr"))


def partial_autocorrelation(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lag, pacf from autocorrelations of the lags 1, 2, ... by Durbin-Levinson recursion; a few numbers a key."""
    import numpy as np
    import pandas as pd

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lag")
        r = part["corr"].to_numpy(float)
        phi, out = np.zeros(0), []
        for k in range(len(r)):
            below = 1 - phi @ r[:k]
            last = (r[k] - phi @ r[:k][::-1]) / below if abs(below) > 1e-12 else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return part.assign(pacf=out).drop(columns="corr")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in correlations.schema.fields if f.name != "corr")
    return correlations.groupBy(*(keys or [models.ALL])).applyInPandas(work, f"{fields}, pacf double")


def decompose(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, period: int) -> DataFrame:
    """Additive parts: ``trend`` (centred moving average), ``seasonal`` (mean of the rest by place in the period) and ``rest``."""
    w = sequence(keys, [seq, tie])
    h = period // 2
    x = F.col(attr).cast("double")
    if period % 2:
        trend = F.avg(x).over(w.rowsBetween(-h, h))
    else:
        trend = (F.avg(x).over(w.rowsBetween(-h, h - 1)) + F.avg(x).over(w.rowsBetween(-h + 1, h))) / 2
    full = F.count(x).over(w.rowsBetween(-h, h)) == 2 * h + 1
    out = df.withColumn("trend", F.when(full, trend)).withColumn("__p", F.pmod(F.row_number().over(w) - 1, F.lit(period)))
    place = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit("all")]), F.col("__p"))
    out = out.withColumn("seasonal", F.avg(x - F.col("trend")).over(place))
    return out.withColumn("rest", x - F.col("trend") - F.col("seasonal")).drop("__p")
