"""Sequence detectors over the ordered rows of a key, by window functions and array functions.

``keys`` name the series, ``seq`` orders it and ``tie`` breaks ties.  Rows without a full window score 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.score import exp_scale, number, sequence, spread_back
from quietsignal.operators import models


def transition_model(df: DataFrame, keys: list[str], state: str, seq: str, tie: str, states: list[str], laplace: float = 1.0) -> DataFrame:
    """keys, prev, cur, prob: transition probabilities with ``laplace`` added to every count; all pairs of states.

    Without keys there is one global model.
    """
    series = sequence(keys, [seq, tie])
    df, own = models.keyed(df, keys)
    steps = df.withColumn("prev", F.lag(state).over(series)).where("prev IS NOT NULL").groupBy(*own, "prev", F.col(state).alias("cur")).agg(F.count("*").alias("n"))
    known = F.array(*[F.lit(s) for s in states])
    grid = df.select(*own).distinct().withColumn("prev", F.explode(known)).withColumn("cur", F.explode(known))
    full = models.attach(grid, steps, [*own, "prev", "cur"]).withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(float(laplace)))
    return full.withColumn("prob", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*own, "prev")))).drop("n")


#: What conditional probability counts for an impossible transition, and for one of a state that the model lacks.
LEAST_PROBABILITY = 1e-6


def transition_metrics(model: DataFrame, keys: list[str]) -> DataFrame:
    """For each transition what every strategy needs: p, miss, not_best, h_other, h_all (0 log 0 is 0), and neg_log with
    the probability at least ``LEAST_PROBABILITY``."""
    own = keys or [models.ALL]
    row = Window.partitionBy(*own, "prev")
    h = F.when(F.col("prob") > 0, -F.col("prob") * F.ln(F.col("prob"))).otherwise(0.0)
    return (
        model.withColumn("miss", 1 - F.col("prob"))
        .withColumn("not_best", F.when(F.row_number().over(row.orderBy(F.col("prob").desc(), "cur")) == 1, 0.0).otherwise(1.0))
        .withColumn("h", h)
        .withColumn("h_all", F.sum(h).over(row))
        .withColumn("h_other", F.col("h_all") - F.col("h"))
        .withColumn("neg_log", -F.ln(F.greatest("prob", F.lit(LEAST_PROBABILITY))))
    )


def markov(df: DataFrame, model: DataFrame, keys: list[str], state: str, seq: str, tie: str, window: int, strategy: str, threshold: float, exp_const: float = 0.0, cumulative: bool = False, model_keys: list[str] | None = None) -> DataFrame:
    """Score by the transitions of the last ``window`` states (all so far if ``cumulative``).

    ``strategy``: missProbability, missRate, entropyReduction or conditionalProbability.  Before the window is full
    the score is 0 and the tag N.  A key without a model scores -1 and is tagged I.  An outlier also marks the
    ``window`` - 1 rows before it.

    A transition that the model lacks has probability 0: it is a full miss, not the best, leaves out none of its state's
    entropy, and counts LEAST_PROBABILITY where a logarithm is taken.  A null state makes no transition, and leaves
    the windows that hold it without a score (tag I); ``cumulative`` sums pass over it.
    """
    own = keys if model_keys is None else model_keys
    w = sequence(keys, [seq, tie])
    facts = transition_metrics(model, own)
    base = df.withColumn("prev", F.lag(state).over(w)).withColumn("cur", F.col(state)).withColumn("__i", F.row_number().over(w))
    if not own:
        base = base.withColumn(models.ALL, F.lit("all"))
    group = own or [models.ALL]
    out = models.attach(base, facts.drop("prob", "h", "h_all"), [*group, "prev", "cur"])
    out = models.attach(out, facts.groupBy(*group, "prev").agg(F.first("h_all").alias("h_all")), [*group, "prev"])
    step = F.col("prev").isNotNull() & F.col("cur").isNotNull()
    unknown = {"miss": F.lit(1.0), "not_best": F.lit(1.0), "neg_log": F.lit(-math.log(LEAST_PROBABILITY)), "h_other": F.coalesce("h_all", F.lit(0.0)), "h_all": F.lit(0.0)}
    for c, instead in unknown.items():
        out = out.withColumn(c, F.when(step, F.coalesce(c, instead)))
    has = model.select(*(own or [models.ALL])).distinct().withColumn("__has", F.lit(True))
    out = models.attach(out, has, group)
    frame = w.rowsBetween(Window.unboundedPreceding, 0) if cumulative else w.rowsBetween(-(window - 2), 0)
    pick = {"missProbability": "miss", "missRate": "not_best", "conditionalProbability": "neg_log"}
    raw = F.try_divide(F.sum("h_other").over(frame), F.sum("h_all").over(frame)) if strategy == "entropyReduction" else F.avg(pick[strategy]).over(frame)
    raw = exp_scale(exp_const, raw) if exp_const > 0 else raw
    full = F.col("__i") >= (2 if cumulative else window)
    gaps = F.lit(0) if cumulative else F.count_if(F.col("cur").isNull()).over(w.rowsBetween(-(window - 1), 0))
    score = F.when(F.col("__has").isNull(), -1.0).when(full & (gaps > 0), None).when(full, F.coalesce(raw, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("score", score)
    flag = spread_back(full & (F.col("score") > threshold), w, window)
    out = out.withColumn("tag", F.when(F.col("__has").isNull() | F.col("score").isNull(), "I").when(flag, "O").otherwise("N"))
    return out.drop("prev", "cur", "__i", "miss", "not_best", "h_all", "h_other", "neg_log", "__has", *([] if own else [models.ALL]))


def quantile_symbols(df: DataFrame, keys: list[str], attr: str, bins: int) -> DataFrame:
    """``symbol``: number of inner quantile edges below the value; edges by key."""
    df, own = models.keyed(df, keys)
    edges = df.groupBy(*own).agg(F.percentile(F.col(attr).cast("double"), F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    out = models.attach(df, edges, own).withColumn("symbol", F.size(F.filter("edges", lambda e: e < F.col(attr))))
    return out.drop("edges", *([] if keys else [models.ALL]))


def ngram_frequencies(df: DataFrame, keys: list[str], symbol: str, seq: str, tie: str, n: int) -> DataFrame:
    """keys, gram, freq: counts of n-grams divided by the key's largest."""
    w = sequence(keys, [seq, tie])
    gram = F.concat_ws("_", *[F.lag(symbol, n - 1 - j).over(w).cast("string") for j in range(n)])
    df, own = models.keyed(df, keys)
    counts = df.withColumn("gram", F.when(F.row_number().over(w) >= n, gram)).where("gram IS NOT NULL").groupBy(*own, "gram").agg(F.count("*").alias("c"))
    top = counts.groupBy(*own).agg(F.max("c").alias("m"))
    return models.attach(counts, top, own).withColumn("freq", F.col("c") / F.col("m").cast("double")).drop("c", "m")


def ngram_distance(df: DataFrame, reference: DataFrame, keys: list[str], symbol: str, seq: str, tie: str, n: int, window: int) -> DataFrame:
    """Squared distance between the n-gram frequencies of the last ``window`` rows and the reference; each row then
    has the largest of the windows that cover it.

    With f the window's frequencies and g the reference's, the sum of (f - g)^2 is the sum of g^2 over all
    n-grams plus that of f^2 - 2 f g over those in the window.
    """
    w = sequence(keys, [seq, tie])
    df, own = models.keyed(df, keys)
    gram = F.when(F.row_number().over(w) >= n, F.concat_ws("_", *[F.lag(symbol, n - 1 - j).over(w).cast("string") for j in range(n)]))
    base = df.withColumn("gram", gram).withColumn("__i", F.row_number().over(w))
    with_g = models.attach(base, reference, [*own, "gram"])
    norm = reference.groupBy(*own).agg(F.sum(F.col("freq") * F.col("freq")).alias("g2"))
    with_g = models.attach(with_g, norm, own)
    seen = F.collect_list(F.struct(F.coalesce("gram", F.lit("")).alias("gram"), F.coalesce("freq", F.lit(0.0)).alias("g"))).over(w.rowsBetween(-(window - n), 0))
    out = with_g.withColumn("seen", F.when(F.col("__i") >= window, seen))
    # Sorted, equal grams stand together: one pass adds up c^2 and c g over their counts c, and keeps the largest c.
    begin = F.struct(F.lit(None).cast("string").alias("gram"), *[F.lit(0.0).alias(c) for c in ("g", "c", "cc", "cg", "most")])

    def closed(a: Column) -> tuple[Column, Column, Column]:
        return a["cc"] + a["c"] * a["c"], a["cg"] + a["c"] * a["g"], F.greatest(a["most"], a["c"])

    def step(a: Column, x: Column) -> Column:
        again = a["gram"].eqNullSafe(x["gram"])
        cc, cg, most = closed(a)
        pick = lambda same, other: F.when(again, same).otherwise(other)
        return F.struct(x["gram"].alias("gram"), x["g"].alias("g"), pick(a["c"] + 1, F.lit(1.0)).alias("c"), pick(a["cc"], cc).alias("cc"), pick(a["cg"], cg).alias("cg"), pick(a["most"], most).alias("most"))

    def total(a: Column) -> Column:
        cc, cg, most = closed(a)
        return F.try_divide(cc, most * most) - F.try_divide(2 * cg, most)

    part = F.when(F.col("seen").isNotNull(), F.aggregate(F.array_sort("seen"), begin, step, total))
    out = out.withColumn("distance", F.coalesce(F.col("g2") + part, F.lit(0.0)))
    out = out.withColumn("score", F.max("distance").over(w.rowsBetween(0, window - 1)))
    return out.drop("gram", "freq", "g2", "seen", "__i", "distance", *([] if keys else [models.ALL]))


T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.16, 2.145, 2.131, 2.12, 2.11, 2.101, 2.093, 2.086, 2.08, 2.074, 2.069, 2.064, 2.06, 2.056, 2.052, 2.048, 2.045, 2.042]
#: Two-sided 95 % points of Student's distribution for 1 to 30 degrees of freedom; 1.96 beyond.


def student_95(n: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in T95]), (n - 2).cast("int")), F.lit(1.96))


def one_step_ahead(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, window: int, least: int = 5, exp_const: float = 1.0, weights: list[float] | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Predict each value from the ``window`` rows before it and score the miss in prediction intervals.

    The deviation is that of the key's earlier residuals, of which there must be ``least``; then the score is
    |prediction - value| / (t sd sqrt(1 + 1 / n)), scaled.  ``weights`` (newest first) weight the average.
    Observed values stay in the window; ``forecast.replacing`` puts predictions in the place of outliers.
    ``initial`` (keys, n, sum, sumsq: ``residual_stats`` of an earlier run) counts as residuals seen before.
    """
    w = sequence(keys, [seq, tie])
    x = F.col(attr).cast("double")
    if weights:
        prediction = sum((F.lag(x, i + 1).over(w) * (v / sum(weights)) for i, v in enumerate(weights)), F.lit(0.0))
        window = len(weights)
    else:
        prediction = F.avg(x).over(w.rowsBetween(-window, -1))
    out = df.withColumn("prediction", F.when(F.row_number().over(w) > window, prediction)).withColumn("__r", F.col("prediction") - x)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if initial is None:
        out = out.withColumn("__n", F.count("__r").over(before)).withColumn("__sd", F.stddev_pop("__r").over(before))
    else:
        saved = initial.select(*keys, F.col("n").alias("__n0"), F.col("sum").alias("__s0"), F.col("sumsq").alias("__q0"))
        out = models.attach(out, saved, keys)
        # The saved residuals are value less prediction, these are the other way round.
        n = F.coalesce("__n0", F.lit(0)) + F.count("__r").over(before)
        total = F.coalesce(F.sum("__r").over(before), F.lit(0.0)) - F.coalesce("__s0", F.lit(0.0))
        squares = F.coalesce(F.sum(F.col("__r") * F.col("__r")).over(before), F.lit(0.0)) + F.coalesce("__q0", F.lit(0.0))
        mean = F.try_divide(total, n)
        out = out.withColumn("__n", n).withColumn("__sd", F.sqrt(F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0)))).drop("__n0", "__s0", "__q0")
    width = student_95(F.col("__n")) * F.col("__sd") * F.sqrt(1 + F.try_divide(F.lit(1.0), F.col("__n")))
    score = F.when(F.col("__n") >= least, F.coalesce(exp_scale(exp_const, F.try_divide(F.abs("__r"), width)), F.lit(0.0))).otherwise(0.0)
    return out.withColumn("score", score).drop("__r", "__n", "__sd")


def smoothing_weights(window: int, smoothing: float) -> list[float]:
    """Weights, newest first, by which exponential smoothing over a window of fixed size is a weighted average."""
    return [smoothing * (1 - smoothing) ** i for i in range(window - 1)] + [(1 - smoothing) ** (window - 1)]


def one_step_ahead_all(df: DataFrame, keys: list[str], attrs: dict[str, float], seq: str, tie: str, window: int, least: int = 5, exp_const: float = 1.0, weights: list[float] | None = None, initial: dict[str, DataFrame] | None = None) -> DataFrame:
    """``one_step_ahead`` of several attributes: ``prediction_{attr}`` and ``score_{attr}`` of each, and ``score``, their
    average by the weights in ``attrs``.

    A null or NaN leaves only its own attribute without a score, and the average is of the others; without any it is null.
    All attributes share one sort.  ``initial`` holds the residuals of an earlier run by attribute (``residual_stats`` of
    the table with ``prediction_{attr}`` as ``prediction``).
    """
    out = df
    for a in attrs:
        own = one_step_ahead(out.withColumn("__a", number(F.col(f"`{a}`"))), keys, "__a", seq, tie, window, least, exp_const, weights, (initial or {}).get(a))
        out = own.withColumnsRenamed({"prediction": f"prediction_{a}", "score": f"score_{a}"}).withColumn(f"score_{a}", F.when(F.col("__a").isNotNull(), F.col(f"`score_{a}`"))).drop("__a")
    scores = {a: F.col(f"`score_{a}`") for a in attrs}
    total = sum((F.coalesce(s * float(attrs[a]), F.lit(0.0)) for a, s in scores.items()), F.lit(0.0))
    known = sum((F.when(s.isNotNull(), float(attrs[a])).otherwise(0.0) for a, s in scores.items()), F.lit(0.0))
    return out.withColumn("score", F.try_divide(total, known))


def residual_stats(df: DataFrame, keys: list[str], attr: str) -> DataFrame:
    """keys, n, sum, sumsq, mean, sd of value less ``prediction``: state for the next run."""
    df, own = models.keyed(df, keys)
    r = F.col(attr).cast("double") - F.col("prediction")
    return df.groupBy(*own).agg(F.count(r).alias("n"), F.sum(r).alias("sum"), F.sum(r * r).alias("sumsq"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"))


def discord(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, window: int, reference: DataFrame | None = None) -> DataFrame:
    """Distance of each sub-sequence to the nearest one that does not overlap it, or to the nearest of ``reference``.

    sqrt(min of sum of squares / window) for each window start; a row has the largest of the windows that cover it, or 0
    without any.  A null or NaN leaves its own row without a score and the windows that hold it out, and no others.
    A series of any length is cut into blocks of ``profile.BLOCK`` window starts that meet in pairs: see ``profile``.
    """
    from quietsignal.operators import profile

    df, own = models.keyed(df, keys)
    rows = df.withColumn("__at", F.row_number().over(Window.partitionBy(*own).orderBy(seq, tie)) - 1)
    given = None
    if reference is not None:
        given = models.keyed(reference, keys)[0].withColumn("__at", F.row_number().over(Window.partitionBy(*own).orderBy(seq, tie)) - 1)
    least = profile.nearest_windows(rows, own, attr, window, given)
    cover = Window.partitionBy(*own).orderBy("__at").rowsBetween(-(window - 1), 0)
    known = number(attr).isNotNull()
    out = models.attach(rows, least, [*own, "__at"]).withColumn("score", F.when(known, F.coalesce(F.max("__d").over(cover), F.lit(0.0)))).drop("__at", "__d")
    return out if keys else out.drop(models.ALL)


def local_neighborhood(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, window: int, nearest: int | None = None, distance: float | None = None) -> DataFrame:
    """At the centre of an odd window: the mean distance to the ``nearest`` closest values, or the number of other
    values within ``distance`` (few are suspicious).  Rows near the ends score 0."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    h = window // 2
    w = sequence(keys, [seq, tie])
    x = F.col(attr).cast("double")
    around = F.collect_list(x).over(w.rowsBetween(-h, h))
    gaps = F.slice(F.array_sort(F.transform(F.col("__a"), lambda y: F.abs(y - x))), 2, window - 1)
    if nearest is not None:
        value = F.aggregate(F.slice(gaps, 1, nearest), F.lit(0.0), lambda a, y: a + y) / nearest
    else:
        value = F.size(F.filter(gaps, lambda y: y <= float(distance))).cast("double")
    return df.withColumn("__a", around).withColumn("score", F.when(F.size("__a") == window, value).otherwise(0.0)).drop("__a")


def change_points(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, window: int, statistic: str, critical: float, since: DataFrame | None = None) -> DataFrame:
    """keys, seq (first row of the window's right half), stat where two halves of a window differ by ``critical`` or more.

    ``statistic``: KS (largest gap of the distribution functions), CVM (Cramer-von Mises) or AD (Anderson-Darling).
    ``since`` (keys, checkpoint) leaves out earlier rows.  Windows that hold a null or NaN are left out.
    """
    if since is not None:
        df = models.attach(df, since.select(*keys, "checkpoint"), keys).where(F.col("checkpoint").isNull() | (F.col(seq) >= F.col("checkpoint"))).drop("checkpoint")
    w = sequence(keys, [seq, tie])
    h = window // 2
    x = number(attr)
    out = df.withColumn("a", F.collect_list(x).over(w.rowsBetween(-h, -1))).withColumn("b", F.collect_list(x).over(w.rowsBetween(0, h - 1)))
    out = out.where((F.size("a") == h) & (F.size("b") == h)).withColumn("stat", _two_sample(statistic, h)("a", "b"))
    return out.where(F.col("stat") >= critical).select(*keys, seq, "stat")


def _two_sample(statistic: str, h: int):
    """A statistic of two halves of ``h`` values: many windows are sorted side by side, w log w each."""
    if statistic not in ("KS", "CVM", "AD"):
        raise ValueError(f"unknown statistic {statistic!r}")
    n = 2 * h

    @F.pandas_udf("double")
    def compute(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        both = np.concatenate([np.stack(a.to_numpy()), np.stack(b.to_numpy())], axis=1)
        order = both.argsort(axis=1, kind="stable")
        z = np.take_along_axis(both, order, 1)
        # Equal values count together: what holds at the last of them holds for all.
        last = np.where(np.append(z[:, 1:] != z[:, :-1], np.ones((len(z), 1), bool), axis=1), np.arange(n), n)
        last = np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]
        left = np.take_along_axis((order < h).cumsum(axis=1), last, 1)
        gap = (2 * left - (last + 1)) / h
        if statistic == "KS":
            return pd.Series(np.abs(gap).max(1))
        if statistic == "CVM":
            return pd.Series(h * h / (n * n) * (gap * gap).sum(1))
        i = np.arange(1, n)
        return pd.Series((((left[:, :-1] * n - i * h) ** 2) / (i * (n - i))).sum(1) / (h * h))

    return compute


def checkpoints(df: DataFrame, keys: list[str], seq: str, tie: str, window: int) -> DataFrame:
    """keys, checkpoint: the first row that the next run's windows need."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit("all"))).orderBy(F.col(seq).desc(), F.col(tie).desc())
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= window - 1).groupBy(*keys).agg(F.min(seq).alias("checkpoint"))


def critical_value(statistic: str, half: int, share: float = 0.95, draws: int = 2000, seed: int = 3) -> float:
    """Monte-Carlo critical value of a two-sample statistic under no change; on the driver, in numpy."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(draws):
        order = rng.permutation(2 * half)
        inside = np.cumsum(order < half) / half
        gap = inside - (np.arange(1, 2 * half + 1) / half - inside)
        i = np.arange(1, 2 * half)
        out.append({"KS": np.abs(gap).max(), "CVM": 0.25 * (gap**2).sum(), "AD": (((inside[:-1] * half * 2 * half - i * half) ** 2) / (i * (2 * half - i))).sum() / half**2}[statistic])
    return float(np.quantile(out, share))


def autocorrelation(df: DataFrame, keys: list[str], attr: str, seq: str, tie: str, lags: list[int]) -> DataFrame:
    """keys, lag, corr: sum of (v - m)(v_lag - m) over that of (v - m)^2, one pass for all lags."""
    w = sequence(keys, [seq, tie])
    df, own = models.keyed(df, keys)
    x = F.col(attr).cast("double")
    means = df.groupBy(*own).agg(F.avg(x).alias("m"))
    base = models.attach(df, means, own).withColumn("d", x - F.col("m"))
    for k in lags:
        base = base.withColumn(f"p{k}", F.col("d") * F.lag("d", k).over(w))
    sums = base.groupBy(*own).agg(F.sum(F.col("d") * F.col("d")).alias("v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in lags])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"p{k}"), F.col("v")).alias("corr")) for k in lags]))
    return sums.select(*own, stacked.alias("x")).select(*own, "x.lag", "x.corr")


def cycle_length(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag with the highest correlation by key."""
    own = keys or [models.ALL]
    return correlations.groupBy(*own).agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("cycle"))


def inter_event(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """``interval``: seconds since the key's row before."""
    w = sequence(keys, [ts, tie])
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    return df.withColumn("interval", seconds - F.lag(seconds).over(w))


def temporal_aggregate(df: DataFrame, keys: list[str], ts: str, attr: str, unit: str, how: str = "avg") -> DataFrame:
    """keys, bucket (start of the ``unit``), value."""
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    return df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias("bucket")).agg(agg(F.col(attr)).alias("value"))


def sequence_match(a: Column, b: Column, how: str = "count", normalise: bool = False, distance: bool = False) -> Column:
    """How alike two arrays are: equal places (``count``), those with runs rewarded (``adjacency``: each equal place
    counts its run so far), or the longest run of equal places (``longest``)."""
    hits = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0))
    n = F.size(hits)
    if how == "count":
        value, most = F.aggregate(hits, F.lit(0), lambda s, x: s + x), n
    else:
        begin = F.struct(F.lit(0).alias("run"), F.lit(0).alias("sum"), F.lit(0).alias("best"))

        def step(s: Column, x: Column) -> Column:
            run = F.when(x == 1, s["run"] + 1).otherwise(0)
            return F.struct(run.alias("run"), (s["sum"] + run).alias("sum"), F.greatest(s["best"], run).alias("best"))

        value = F.aggregate(hits, begin, step, lambda s: s["sum"] if how == "adjacency" else s["best"])
        most = n * (n + 1) / 2 if how == "adjacency" else n
    value = value.cast("double")
    if normalise or distance:
        value = F.try_divide(value, most)
    return 1 - value if distance else value


def collected(df: DataFrame, keys: list[str], field: str, seq: str, tie: str) -> DataFrame:
    """keys, sequence: the key's values in order."""
    df, own = models.keyed(df, keys)
    return df.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, tie, field))), lambda s: s[field]).alias("sequence"))
