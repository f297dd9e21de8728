"""Record detectors: a score for each row from a model of its key.

Every function takes rows and a model table (see ``models``), joins them by key and appends ``score``; a missing
model, a null value or a deviation of 0 leaves the score null.  ``detect`` adds the tag.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.score import combine, exp_scale, logistic_scale, number, tag
from quietsignal.operators import models


@dataclass(frozen=True)
class Settings:
    """keys and attributes of a detector, how their scores combine, and the threshold."""

    keys: list[str]
    attrs: list[str]
    how: str = "average"
    weights: list[float] | None = None
    exp_const: float = 0.0
    threshold: float | None = None
    polarity: str = "high"
    low: float | None = None
    #: The keys have few values: rows stay where they are and the model goes to them, as few tasks would get all rows.
    few: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.attrs:
            raise ValueError("a detector needs an attribute")

    def total(self, scores: list[Column]) -> Column:
        one = combine(scores, self.how, self.weights) if len(scores) > 1 or self.how == "weightedAverage" else scores[0]
        return exp_scale(self.exp_const, one) if self.exp_const > 0 else one


def _joined(df: DataFrame, model: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    if keys:
        return models.attach(df, F.broadcast(model) if few else model, keys)
    return models.attach(df.withColumn(models.ALL, F.lit("all")), model, [models.ALL]).drop(models.ALL)


def _scored(df: DataFrame, model: DataFrame, s: Settings, one) -> DataFrame:
    added = [c for c in model.columns if c not in s.keys and c != models.ALL]
    return _joined(df, model, s.keys, s.few).withColumn("score", s.total([one(a) for a in s.attrs])).drop(*added)


def _num(a: str) -> Column:
    return number(a)


def zscore(df: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Distance to the mean in deviations."""
    return _scored(df, model, s, lambda a: F.try_divide(F.abs(_num(a) - F.col(f"{a}_mean")), F.col(f"{a}_sd")))


def robust_zscore(df: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Distance to the median in median absolute deviations."""
    return _scored(df, model, s, lambda a: F.try_divide(F.abs(_num(a) - F.col(f"{a}_med")), F.col(f"{a}_mad")))


def extreme_value(df: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Gumbel distribution function of the z-score."""
    return _scored(df, model, s, lambda a: F.exp(-F.exp(-F.try_divide(F.abs(_num(a) - F.col(f"{a}_mean")), F.col(f"{a}_sd")))))


def inter_percentile(df: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Distance to the range between two percentiles (``{attr}_q25``, ``{attr}_q75``) in its widths; 0 inside."""

    def one(a: str) -> Column:
        v, lo, hi = _num(a), F.col(f"{a}_q25"), F.col(f"{a}_q75")
        return F.try_divide(F.greatest(lo - v, v - hi, F.lit(0.0)), hi - lo)

    return _scored(df, model, s, one)


def probability_score(p: Column, strategy: str = "inverse") -> Column:
    """``inverse``: 1 - p; otherwise -ln p, and 20 where p is 0."""
    return 1 - p if strategy == "inverse" else F.when(p > 0, -F.ln(p)).when(p.isNotNull(), 20.0)


def _with_bins(df: DataFrame, model: DataFrame, keys: list[str], bins: dict[str, Column]) -> DataFrame:
    """Rows with the model's counts of their bins (0 for a bin never seen) and their key's total."""
    df, own = models.keyed(df, keys)
    for name, b in bins.items():
        df = df.withColumn(name, b)
    total = model.groupBy(*own).agg(F.sum("n").alias("total"))
    cells = model.select(*own, *bins, F.col("n"), *[c for c in model.columns if c.startswith("m_")])
    out = models.attach(models.attach(df, cells, [*own, *bins]), total, own)
    out = out.withColumn("n", F.when(F.col("total").isNotNull(), F.coalesce("n", F.lit(0))))
    return out.drop(models.ALL) if not keys else out


def bin_probability(df: DataFrame, model: DataFrame, keys: list[str], bins: dict[str, Column], strategy: str = "inverse") -> DataFrame:
    """Score by the share of the key's rows in the same (joint) bin."""
    out = _with_bins(df, model, keys, bins)
    return out.withColumn("score", probability_score(F.try_divide(F.col("n").cast("double"), F.col("total")), strategy)).drop("n", "total", *bins)


def cumulative_model(model: DataFrame, keys: list[str], bin_name: str) -> DataFrame:
    """Adds ``m_upto``: rows in this bin and lower ones."""
    own = keys or [models.ALL]
    return model.withColumn("m_upto", F.sum("n").over(Window.partitionBy(*own).orderBy(bin_name)))


def cumulative_probability(df: DataFrame, model: DataFrame, keys: list[str], bin_name: str, bin_: Column) -> DataFrame:
    """The greater of the distribution function at the row's bin and 1 less it."""
    out = _with_bins(df, cumulative_model(model, keys, bin_name), keys, {bin_name: bin_})
    f = F.try_divide(F.col("m_upto").cast("double"), F.col("total"))
    return out.withColumn("score", F.greatest(f, 1 - f)).drop("n", "total", "m_upto", bin_name)


def meta_model(model: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``m_rarer``: rows in bins with fewer rows than this one."""
    own = keys or [models.ALL]
    order = Window.partitionBy(*own).orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    return model.withColumn("m_rarer", F.coalesce(F.sum("n").over(order), F.lit(0)))


def meta_probability(df: DataFrame, model: DataFrame, keys: list[str], bins: dict[str, Column], strategy: str = "inverse") -> DataFrame:
    """Score by the probability that a row falls into a rarer bin than this row's; a bin never seen has 0."""
    out = _with_bins(df, meta_model(model, keys), keys, bins)
    q = F.try_divide(F.coalesce(F.col("m_rarer"), F.lit(0)).cast("double"), F.col("total"))
    return out.withColumn("score", probability_score(q, strategy)).drop("n", "total", "m_rarer", *bins)


def marginal_probability(df: DataFrame, model: DataFrame, keys: list[str], bins: dict[str, Column], weights: list[float], only_if_missing: bool = False) -> DataFrame:
    """Weighted sum over attributes of 1 - p, p from the joint model's marginals.

    With ``only_if_missing`` rows whose attribute values have all been seen score 0.
    """
    df, own = models.keyed(df, keys)
    for name, b in bins.items():
        df = df.withColumn(name, b)
    out = models.attach(df, model.groupBy(*own).agg(F.sum("n").alias("total")), own)
    for name in bins:
        out = models.attach(out, model.groupBy(*own, name).agg(F.sum("n").alias(f"n_{name}")), [*own, name])
    p = [F.try_divide(F.coalesce(F.col(f"n_{b}"), F.lit(0)).cast("double"), F.col("total")) for b in bins]
    score = sum((w * (1 - x) for w, x in zip(weights, p, strict=True)), F.lit(0.0))
    if only_if_missing:
        unseen = F.array_min(F.array(*p)) == 0
        score = F.when(unseen, score).otherwise(F.lit(0.0))
    out = out.withColumn("score", score).drop("total", *[f"n_{b}" for b in bins], *bins)
    return out.drop(models.ALL) if not keys else out


def entropy_increase(df: DataFrame, model: DataFrame, keys: list[str], bins: dict[str, Column]) -> DataFrame:
    """Relative increase of the bin distribution's entropy when the row is added; 0 if it does not rise.

    With S the sum of c log2 c over bins and n rows the entropy is log2 n - S / n, so one term changes.
    """
    own = keys or [models.ALL]
    spread = model.groupBy(*own).agg(F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("m_s"))
    out = _with_bins(df, model, keys, bins)
    out = models.attach(out, spread, own) if keys else models.attach(out.withColumn(models.ALL, F.lit("all")), spread, own).drop(models.ALL)
    c, n = F.col("n").cast("double"), F.col("total").cast("double")
    before = F.log2(n) - F.col("m_s") / n
    gain = (c + 1) * F.log2(c + 1) - F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1.0)))).otherwise(0.0)
    after = F.log2(n + 1) - (F.col("m_s") + gain) / (n + 1)
    return out.withColumn("score", F.greatest(F.coalesce(F.try_divide(after - before, before), F.lit(0.0)), F.lit(0.0))).drop("n", "total", "m_s", *bins)


def inverse_covariance(model: DataFrame) -> DataFrame:
    """A covariance model with ``inv``, the (pseudo-)inverse; one small matrix for each key, inverted in Arrow batches."""
    @F.pandas_udf("array<double>")
    def invert(cells: pd.Series) -> pd.Series:
        def one(x):
            k = round(len(x) ** 0.5)
            m = np.array(x, float).reshape(k, k)
            return np.linalg.pinv(m).ravel().tolist() if np.isfinite(m).all() else None

        return cells.map(one)

    return model.withColumn("inv", invert("cov"))


def mahalanobis(df: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """Squared Mahalanobis distance; ``model`` from ``inverse_covariance``.  Two attributes need no Python at all."""
    out = _joined(df, model, s.keys, s.few)
    k = len(s.attrs)
    d = [_num(a) - F.get("means", F.lit(i)) for i, a in enumerate(s.attrs)]
    cells = model.columns
    if "inv" in cells:
        inv = [[F.get("inv", F.lit(i * k + j)) for j in range(k)] for i in range(k)]
    elif k == 2:
        a, b, c = (F.get("cov", F.lit(i)) for i in (0, 1, 3))
        det = a * c - b * b
        inv = [[F.try_divide(c, det), F.try_divide(-b, det)], [F.try_divide(-b, det), F.try_divide(a, det)]]
    else:
        raise ValueError("more than two attributes need inverse_covariance()")
    total = sum((d[i] * inv[i][j] * d[j] for i in range(k) for j in range(k)), F.lit(0.0))
    return out.withColumn("score", exp_scale(s.exp_const, total) if s.exp_const > 0 else total).drop(*[c for c in cells if c not in s.keys and c != models.ALL])


STRATEGIES = {"zscore": (models.moments, zscore), "robustZscore": (models.medians, robust_zscore), "extremeValue": (models.moments, extreme_value)}
#: Strategies over a histogram of bins, with the function that scores by it.
BINNED = ("attributeProbability", "jointProbability", "cumulativeProbability", "metaProbability", "marginalProbability", "entropyIncrease")


def bins_of(s: Settings) -> dict[str, Column]:
    """A bin for each attribute: of ``extra["widths"][attr]`` from ``extra["lows"][attr]`` (0), or the value itself."""
    widths, lows = s.extra.get("widths", {}), s.extra.get("lows", {})
    return {f"__b{i}": models.bin_of(F.col(a), widths[a], lows.get(a, 0.0)) if a in widths else F.col(a) for i, a in enumerate(s.attrs)}


def fit(df: DataFrame, strategy: str, s: Settings) -> DataFrame:
    """The model table of a strategy, from all rows of ``df``."""
    if strategy == "interPercentile":
        return models.percentiles(df, s.keys, s.attrs, {"q25": 0.25, "q75": 0.75})
    if strategy == "mahalanobis":
        return inverse_covariance(models.covariance(df, s.keys, s.attrs))
    if strategy in BINNED:
        bins = bins_of(s)
        return models.histogram(df, s.keys, list(bins.values()), list(bins))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy][0](df, s.keys, s.attrs)


def apply(df: DataFrame, model: DataFrame, strategy: str, s: Settings) -> DataFrame:
    """``score`` by a model of ``fit``; ``df`` may be a stream.  ``extra["probability"]``: inverse or log."""
    bins, how = bins_of(s), s.extra.get("probability", "inverse")
    if strategy in ("attributeProbability", "cumulativeProbability") and len(s.attrs) > 1:
        raise ValueError(f"{strategy} takes one attribute")
    if strategy in ("attributeProbability", "jointProbability"):
        return bin_probability(df, model, s.keys, bins, how)
    if strategy == "cumulativeProbability":
        return cumulative_probability(df, model, s.keys, "__b0", bins["__b0"])
    if strategy == "metaProbability":
        return meta_probability(df, model, s.keys, bins, how)
    if strategy == "marginalProbability":
        weights = s.weights or [1 / len(s.attrs)] * len(s.attrs)
        return marginal_probability(df, model, s.keys, bins, weights, s.extra.get("only_if_missing", False))
    if strategy == "entropyIncrease":
        return entropy_increase(df, model, s.keys, bins)
    if strategy == "interPercentile":
        return inter_percentile(df, model, s)
    if strategy == "mahalanobis":
        return mahalanobis(df, model, s)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy][1](df, model, s)


def detect(df: DataFrame, strategy: str, s: Settings, reference: DataFrame | None = None) -> DataFrame:
    """Fit on ``reference`` (or the rows themselves), score, and tag by ``s``."""
    out = apply(df, fit(df if reference is None else reference, strategy, s), strategy, s)
    return out.withColumn("tag", tag(F.col("score"), s.threshold, s.polarity, s.low))


def out_of_range(df: DataFrame, ranges: DataFrame, s: Settings, steepness: float) -> DataFrame:
    """Logistic of the distance outside [lo, hi] (columns ``{attr}_lo``, ``{attr}_hi`` by key)."""

    def one(a: str) -> Column:
        v, lo, hi = _num(a), F.col(f"{a}_lo"), F.col(f"{a}_hi")
        return logistic_scale(steepness, F.when(v > (lo + hi) / 2, v - hi).otherwise(lo - v))

    return _scored(df, ranges, s, one)


def in_range(df: DataFrame, ranges: list[dict[str, tuple[float, float]]] | DataFrame, s: Settings, steepness: float) -> DataFrame:
    """High inside a range; of several ranges the best counts.

    ``ranges``: a short literal list of global ranges, or a table of any size (``s.keys``, ``{attr}_lo``, ``{attr}_hi``), global
    without keys, for which see ``in_range_table``.
    """
    if isinstance(ranges, DataFrame):
        return in_range_table(df, ranges, s, steepness)

    def inside(box: dict[str, tuple[float, float]]) -> Column:
        return s.total([_inside(_num(a), *(F.lit(float(x)) for x in box[a]), steepness) for a in s.attrs])

    scores = [inside(b) for b in ranges]
    return df.withColumn("score", F.greatest(*scores) if len(scores) > 1 else scores[0])


def _inside(v: Column, lo: Column, hi: Column, steepness: float) -> Column:
    return 1 - logistic_scale(steepness, F.when(v > (lo + hi) / 2, v - hi).otherwise(lo - v))


#: Bucket widths are 4 to the power of one of these.
LEVELS = range(-20, 511)


def in_range_table(df: DataFrame, ranges: DataFrame, s: Settings, steepness: float, reach: float = 40.0) -> DataFrame:
    """``in_range`` by an interval join: rows meet only ranges whose buckets of some attribute hold them.

    A range, made wider by ``reach`` / steepness on either side (beyond it an attribute counts for less than e^-reach), falls into at most five
    buckets of the least width that is a power of four and not below a quarter of its own; a row asks one bucket of each width in use.
    So the join is by equality of key, width and bucket, and only then checked.  A row that meets no range, or has a null
    attribute, scores 0 and null.  Ranges with a null or not finite edge, or with lo above hi, are none.
    """
    margin = reach / steepness
    edges = [number(f"{a}_{side}") for a in s.attrs for side in ("lo", "hi")]
    good = edges[0] <= edges[1]
    for lo, hi in zip(edges[2::2], edges[3::2], strict=True):
        good = good & (lo <= hi)
    own = [f"__k{i}" for i in range(len(s.keys))]
    boxes = ranges.where(F.coalesce(good, F.lit(False))).select(*[F.col(f"`{k}`").alias(o) for k, o in zip(s.keys, own, strict=True)], *[e.alias(f"__e{i}") for i, e in enumerate(edges)])
    boxes = boxes.distinct()
    # A score depends on the key and the values alone, by which rows are matched again; copies are searched once.
    columns = [*own, *[f"__v{i}" for i in range(len(s.attrs))]]
    wide = df.withColumns({**{o: F.col(f"`{k}`") for k, o in zip(s.keys, own, strict=True)}, **{f"__v{i}": _num(a) for i, a in enumerate(s.attrs)}})
    values = wide.select(*columns).dropna(subset=columns[len(own) :]).distinct()
    bucket = lambda x, at: F.floor(x / F.pow(F.lit(4.0), at))
    one = s.total([_inside(F.col(f"__v{i}"), F.col(f"__e{2 * i}"), F.col(f"__e{2 * i + 1}"), steepness) for i in range(len(s.attrs))])
    found = []
    for i in range(len(s.attrs)):
        low, high = F.col(f"__e{2 * i}") - margin, F.col(f"__e{2 * i + 1}") + margin
        level = F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[-1]), F.ceil(F.log(4.0, (high - low) / 4)))).cast("int")
        placed = boxes.withColumn("__level", level).withColumn("__bucket", F.explode(F.sequence(bucket(low, F.col("__level")), bucket(high, F.col("__level")))))
        used = [r[0] for r in placed.select("__level").distinct().collect()]  # one of the LEVELS each
        asks = values.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in used]) if used else F.expr("CAST(array() AS array<int>)"))).withColumn("__bucket", bucket(F.col(f"__v{i}"), F.col("__level")))
        found.append(models.attach(asks, placed, [*own, "__level", "__bucket"]).where(F.col("__e0").isNotNull()).groupBy(*columns).agg(F.max(one).alias("__one")))
    best = reduce(DataFrame.unionByName, found).groupBy(*columns).agg(F.max("__one").alias("__best"))
    whole = F.lit(True)
    for i in range(len(s.attrs)):
        whole = whole & F.col(f"__v{i}").isNotNull()
    return models.attach(wide, best, columns).withColumn("score", F.when(whole, F.coalesce("__best", F.lit(0.0)))).drop(*columns, "__best")


def outliers(df: DataFrame) -> DataFrame:
    """Only rows tagged O."""
    return df.where(F.col("tag") == "O")


def clean(df: DataFrame) -> DataFrame:
    """Rows not tagged O, without score and tag."""
    return df.where(F.col("tag") != "O").drop("score", "tag")


def above(df: DataFrame, threshold: float | None) -> DataFrame:
    """Rows with a score above ``threshold``; all without one."""
    return df if threshold is None else df.where(F.col("score") > threshold)


def keyed_threshold(df: DataFrame, thresholds: DataFrame, keys: list[str], default: float | None = None, polarity: str = "high") -> DataFrame:
    """Tag by each key's own threshold (column ``threshold``), else ``default``, else A."""
    out = models.attach(df, thresholds.select(*keys, "threshold"), keys)
    return out.withColumn("tag", tag(F.col("score"), F.coalesce("threshold", F.lit(default).cast("double")), polarity)).drop("threshold")
