"""What follows detection: counts, roll-up, thresholds, evaluation, clusters and level shifts of outliers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from quietsignal.functions.score import sequence, spread_back
from quietsignal.operators import models
from quietsignal.operators.fold import ordered_fold


def count_tags(df: DataFrame, keys: list[str], stamp: bool = False) -> DataFrame:
    """By key: number and percentage of each tag, and the total; tag A is counted like the others."""
    df, keys = models.keyed(df, keys)
    names = {"O": "outlier", "I": "unknown", "N": "normal", "A": "ambiguous"}
    out = df.groupBy(*keys).agg(*[F.count_if(F.col("tag") == t).alias(f"{n}_count") for t, n in names.items()], F.count("*").alias("total"))
    for n in names.values():
        out = out.withColumn(f"{n}_pct", 100.0 * F.col(f"{n}_count") / F.col("total"))
    return out.withColumn("counted_at", F.current_timestamp()) if stamp else out


def roll_up(df: DataFrame, hierarchy: DataFrame, how: str = "average") -> DataFrame:
    """Children (type, id, seq, value, score, tag) to their parents by ``hierarchy`` (type, id, parentType, parentId, singleton).

    If any child of a parent at a time is an outlier, only outliers are aggregated and the tag is O; otherwise
    all are, and it is N.  A singleton type has one parent whatever the id.  Children without a parent go to a
    null one.  Levels chain: the result has the columns of the input.
    """
    agg = {"average": F.avg, "max": F.max}[how]
    single = hierarchy.where("singleton").select("type", F.col("parentType").alias("p1"), F.col("parentId").alias("i1")).distinct()
    other = hierarchy.where("NOT singleton").select("type", "id", F.col("parentType").alias("p2"), F.col("parentId").alias("i2"))
    out = df.join(single, "type", "left").join(other, ["type", "id"], "left")
    out = out.withColumn("pt", F.coalesce("p1", "p2")).withColumn("pi", F.coalesce("i1", "i2"))
    bad = F.col("tag") == "O"
    pick = lambda c: F.coalesce(agg(F.when(bad, F.col(c))), agg(F.col(c))).alias(c)
    rolled = out.groupBy("pt", "pi", "seq").agg(pick("value"), pick("score"), F.when(F.max(bad.cast("int")) == 1, "O").otherwise("N").alias("tag"))
    return rolled.select(F.col("pt").alias("type"), F.col("pi").alias("id"), "seq", "value", "score", "tag")


def learn_threshold(df: DataFrame, keys: list[str], positive: Column, splits: list[float], criterion: str = "entropy") -> DataFrame:
    """Decision stumps on ``score``: keys, split, info (count-weighted impurity of both sides); one-sided splits are left out."""
    df, keys = models.keyed(df, keys)
    both = df.withColumn("split", F.explode(F.array(*[F.lit(float(s)) for s in splits])))
    sides = both.groupBy(*keys, "split").agg(
        F.count_if(F.col("score") < F.col("split")).alias("n0"), F.count_if((F.col("score") < F.col("split")) & positive).alias("p0"),
        F.count_if(F.col("score") >= F.col("split")).alias("n1"), F.count_if((F.col("score") >= F.col("split")) & positive).alias("p1"),
    )

    def impurity(p: Column, n: Column) -> Column:
        share = F.try_divide(p.cast("double"), n)
        if criterion == "gini":
            return 2 * share * (1 - share)
        term = lambda q: F.when(q > 0, -q * F.ln(q)).otherwise(0.0)
        return term(share) + term(1 - share)

    n0, n1 = F.col("n0"), F.col("n1")
    info = (n0 * impurity(F.col("p0"), n0) + n1 * impurity(F.col("p1"), n1)) / (n0 + n1)
    return sides.where("n0 > 0 AND n1 > 0").select(*keys, "split", info.alias("info"))


def best_split(stumps: DataFrame, keys: list[str]) -> DataFrame:
    """The split with the least impurity by key; of equal ones the smallest."""
    own = keys or [models.ALL]
    return stumps.groupBy(*own).agg(F.min(F.struct("info", "split")).alias("b")).select(*own, "b.split", "b.info")


def pseudo_relevance(df: DataFrame, keys: list[str], tie: str, top: float, as_percentage: bool, least: int, default: float, old: DataFrame | None = None) -> DataFrame:
    """By key, the mean of the scores at the rank that ``top`` gives and its two neighbours.

    Keys with ``least`` rows or fewer keep their old threshold (column ``threshold``), else ``default``.
    """
    df, keys = models.keyed(df, keys)
    size = Window.partitionBy(*keys)
    ranked = df.withColumn("__k", F.row_number().over(size.orderBy(F.col("score").desc(), tie))).withColumn("__n", F.count("*").over(size))
    at = F.floor(F.col("__n") * (top / 100.0)) if as_percentage else F.lit(int(top))
    at = F.least(F.greatest(at, F.lit(1)), F.col("__n"))
    found = ranked.withColumn("__at", at).groupBy(*keys).agg(F.max("__n").alias("__n"), F.avg(F.when(F.abs(F.col("__k") - F.col("__at")) <= 1, F.col("score"))).alias("mean3"))
    if old is not None:
        found = models.attach(found, old.select(*keys, F.col("threshold").alias("kept")), keys)
    else:
        found = found.withColumn("kept", F.lit(None).cast("double"))
    return found.select(*keys, F.when(F.col("__n") > least, F.col("mean3")).otherwise(F.coalesce("kept", F.lit(float(default)))).alias("threshold"))


def precision_recall(detected: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall of detected row keys against the true ones."""
    d, t = detected.select(*keys).distinct().withColumn("d", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = d.join(t, keys, "full")
    hit = both.agg(F.count_if(F.col("d").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("d").isNull()).alias("fn"))
    return hit.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


def score_tail(df: DataFrame, keys: list[str], shares: list[float], how: str = "narrowed") -> DataFrame:
    """By key, ``p{share}`` percentiles of the score; ``how`` as in ``models.quantiles``."""
    found = models.quantiles(df, keys, {"score": F.col("score")}, {f"p{round(100 * p)}": p for p in shares}, how)
    return found.select(*(keys or [models.ALL]), *[F.col(f"score_p{round(100 * p)}").alias(f"p{round(100 * p)}") for p in shares])


def tail_fit(df: DataFrame, keys: list[str], share: float, target: float) -> DataFrame:
    """Peaks over threshold: a generalised Pareto tail by moments over the ``share`` percentile, and its ``target`` quantile.

    shape = (1 - m^2 / v) / 2, scale = m (1 + m^2 / v) / 2 for excesses of mean m and variance v.
    """
    df, keys = models.keyed(df, keys)
    limits = models.attach(df.groupBy(*keys).agg(F.count("*").alias("n")), models.quantiles(df, keys, {"score": F.col("score")}, {"u": share}).withColumnRenamed("score_u", "u"), keys)
    over = models.attach(df.select(*keys, "score"), limits, keys).where("score > u").withColumn("e", F.col("score") - F.col("u"))
    fit = over.groupBy(*keys, "u", "n").agg(F.count("*").alias("excesses"), F.avg("e").alias("m"), F.var_pop("e").alias("v"))
    ratio = F.try_divide(F.col("m") * F.col("m"), F.col("v"))
    fit = fit.withColumn("shape", 0.5 * (1 - ratio)).withColumn("scale", 0.5 * F.col("m") * (1 + ratio))
    rest = F.col("n") * (1 - target) / F.col("excesses")
    q = F.when(F.abs("shape") < 1e-9, F.col("u") - F.col("scale") * F.ln(rest)).otherwise(F.col("u") + F.col("scale") / F.col("shape") * (F.pow(rest, -F.col("shape")) - 1))
    return fit.select(*keys, "u", "excesses", "shape", "scale", q.alias("quantile"))


def cluster_alerts(df: DataFrame, keys: list[str], seq: str, tie: str, max_gap: float | None = None, average_gap: float | None = None, least: int = 1, prototype: str = "center", ignore_small: bool = False) -> DataFrame:
    """One O for each cluster of outliers close in ``seq`` (a number); the others of it become N; I stays.

    A gap above ``max_gap`` begins a new cluster; with ``average_gap`` so does one with which the mean gap of the
    cluster so far would exceed it (a recursion, see ``fold``).  The prototype is the lower median in time, or ``max`` by score.  Clusters
    under ``least`` rows keep their outliers, or with ``ignore_small`` lose them.
    """
    if max_gap is None and average_gap is None:
        raise ValueError("a maximum or an average gap is needed")
    w = sequence(keys, [seq, tie])
    bad = df.where(F.col("tag") == "O")
    if average_gap is None:
        gap = F.col(seq).cast("double") - F.lag(F.col(seq).cast("double")).over(w)
        bad = bad.withColumn("__gap", gap).withColumn("__c", F.sum((F.col("__gap").isNull() | (F.col("__gap") > float(max_gap))).cast("int")).over(w))
    else:
        bad = _by_average_gap(bad, keys, seq, tie, float(average_gap), float("inf") if max_gap is None else float(max_gap))
    own = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit("all")]), F.col("__c"))
    inside = own.orderBy(F.col("score").desc(), tie) if prototype == "max" else own.orderBy(seq, tie)
    bad = bad.withColumn("__k", F.row_number().over(inside)).withColumn("__n", F.count("*").over(own))
    chosen = F.col("__k") == (1 if prototype == "max" else F.floor((F.col("__n") + 1) / 2))
    tag = F.when(F.col("__n") < least, F.lit("N" if ignore_small else "O")).when(chosen, "O").otherwise("N")
    marked = bad.select(*df.columns, "__c", tag.alias("__t"))
    rest = df.where(F.coalesce(F.col("tag") != "O", F.lit(True))).withColumn("__c", F.lit(None).cast("long")).withColumn("__t", F.col("tag"))
    return marked.unionByName(rest).withColumn("tag", F.col("__t")).withColumnRenamed("__c", "alert_cluster").drop("__t")


def _by_average_gap(df: DataFrame, keys: list[str], seq: str, tie: str, average: float, most: float) -> DataFrame:
    """``__c``: the number of the row's cluster; a key's outliers pass in order, and four numbers stay.  A null place is a cluster of its own."""

    def step(state: tuple[int, float, int, float | None], part: pd.DataFrame) -> tuple[tuple, list[list]]:
        c, start, inside, last = state
        out = []
        for x in part["__x"].to_numpy(float):
            if last is None or x != x or x - last > most or (x - start) / inside > average:
                c, start, inside = c + 1, x, 0
            inside, last = inside + 1, None if x != x else x
            out.append(c)
        return (c, start, inside, last), [out]

    placed = df.withColumn("__x", F.col(seq).cast("double"))
    return ordered_fold(placed, keys, [seq, tie], ["__x"], lambda _: (0, 0.0, 0, None), step, [StructField("__c", LongType())]).drop("__x")


def score_level_shift(df: DataFrame, keys: list[str], seq: str, tie: str, long: int, short: int, least_z: float) -> DataFrame:
    """Tag O where the mean score of the last ``short`` rows is over ``least_z`` deviations above that of the last ``long``.

    Both windows include the row.  Rows before the long window is full keep their tag; a shift also marks the
    ``short`` - 1 rows before it, except those tagged I.  Columns ``shift`` (the z-score) and ``tag``.
    """
    w = sequence(keys, [seq, tie])
    wide, narrow = w.rowsBetween(-(long - 1), 0), w.rowsBetween(-(short - 1), 0)
    z = F.try_divide(F.avg("score").over(narrow) - F.avg("score").over(wide), F.stddev_pop("score").over(wide))
    out = df.withColumn("__i", F.row_number().over(w)).withColumn("shift", F.when(F.row_number().over(w) >= long, z))
    back = spread_back(F.coalesce(F.col("shift") > least_z, F.lit(False)), w, short)
    full = F.col("__i") >= long
    tag = F.when(F.col("tag") == "I", "I").when(back, "O").when(full, "N").otherwise(F.col("tag"))
    return out.withColumn("tag", tag).drop("__i")


def level_shifts(df: DataFrame, keys: list[str], attr: str, means: DataFrame, seq: str, tie: str, window: int, tolerance: int) -> DataFrame:
    """Segments (keys, start, end, rows) over which the attribute stays on one side of its mean among outliers.

    A row is shifted up (down) if at least ``window`` - ``tolerance`` of the last ``window`` rows are outliers above
    (below) the key's mean.  Runs of shifted rows of one side are segments; they start ``window`` - 1 rows earlier.
    """
    w = sequence(keys, [seq, tie])
    last = w.rowsBetween(-(window - 1), 0)
    base = models.attach(df, means, keys)
    side = F.when(F.col("tag") == "O", F.signum(F.col(attr).cast("double") - F.col(f"{attr}_mean"))).otherwise(0)
    out = base.withColumn("s", side).withColumn("i", F.row_number().over(w)).withColumn("first", F.lag(seq, window - 1).over(w))
    up, down = (F.sum(F.when(F.col("s") == x, 1).otherwise(0)).over(last) for x in (1, -1))
    need = window - tolerance
    out = out.withColumn("dir", F.when(F.col("i") < window, 0).when(up >= need, 1).when(down >= need, -1).otherwise(0))
    out = out.withColumn("new", (F.col("dir") != F.coalesce(F.lag("dir").over(w), F.lit(0))).cast("int")).withColumn("island", F.sum("new").over(w))
    return out.where("dir <> 0").groupBy(*keys, "island", "dir").agg(F.min("first").alias("start"), F.max(seq).alias("end"), F.count("*").alias("rows")).drop("island")


def calibration(df: DataFrame, probability: Column, label: Column, bins: int, keys: list[str]) -> DataFrame:
    """Reliability by bin of the predicted probability, for all rows or by key."""
    df, keys = models.keyed(df, keys)
    b = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("predicted"), F.avg(label.cast("double")).alias("observed"))

