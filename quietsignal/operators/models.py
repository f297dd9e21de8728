"""Statistics of attributes by key, as model tables that detectors join."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.score import number

ALL = "__all"


def keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys to group by; without any, one literal key for all rows."""
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit("all")), [ALL])


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt to all of the session's shuffle partitions, for groups of few bytes and much work, which adaptive
    execution would put into one task."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *[F.col(f"`{c}`") for c in by])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in the session's ``spark.checkpoint.dir``; a local session that names none gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def same(left: str, right: str, keys: list[str]) -> Column:
    """Join condition on keys, null keys meeting null keys."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def attach(df: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a model; rows without a model get nulls.  Spark broadcasts the model if it is small."""
    fields = [c for c in model.columns if c not in keys]
    renamed = model.select(*[F.col(f"`{k}`").alias(f"__k_{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in fields])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & df[f"`{k}`"].eqNullSafe(renamed[f"__k_{i}"])
    return df.join(renamed, on, "left").drop(*[f"__k_{i}" for i in range(len(keys))])


def moments(df: DataFrame, keys: list[str], attrs: list[str], least: int = 1) -> DataFrame:
    """keys, and for each attribute n, sum, sum of squares, mean and population deviation; keys with under ``least`` rows are left out."""
    df, keys = keyed(df, keys)
    out = []
    for a in attrs:
        x = number(a)
        out += [F.count(x).alias(f"{a}_n"), F.sum(x).alias(f"{a}_sum"), F.sum(x * x).alias(f"{a}_sumsq"), F.avg(x).alias(f"{a}_mean"), F.stddev_pop(x).alias(f"{a}_sd")]
    return df.groupBy(*keys).agg(*out, F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")


#: Rank error of a sketch, as a share of a key's values: one in so many.
SKETCH = 10_000


def quantiles(df: DataFrame, keys: list[str], columns: dict[str, Column], shares: dict[str, float], how: str = "narrowed") -> DataFrame:
    """keys, and ``{column}_{name}`` for each column and share; nulls, NaN and infinities are left out.

    ``how``: ``sketch`` (mergeable, bounded memory, a value whose rank is off by one in SKETCH of the key's values at
    most), ``narrowed`` (exact: sketches bracket the rank, and only values in the bracket are counted and ranked, so
    no task holds a key's values and copies of a value are one count), or ``whole`` (exact, by a map of all of a key's
    values in one task: for keys of a known size).  Between two values the exact ones interpolate.
    """
    df, keys = keyed(df, keys)
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *[number(c).alias(f"__{n}") for n, c in columns.items()])
    each = [(f"{n}_{name}", f"__{n}", float(p)) for n in columns for name, p in shares.items()]
    if how == "whole":
        return rows.groupBy(*keys).agg(*[F.percentile(x, F.lit(p)).alias(out) for out, x, p in each])
    if how == "sketch":
        return rows.groupBy(*keys).agg(*[F.percentile_approx(x, F.lit(p), SKETCH).alias(out) for out, x, p in each])
    if how != "narrowed":
        raise ValueError(f"unknown way {how!r}")
    # Two sketches a share: their ranks are off by one in SKETCH, so four of these on either side are enough.
    room = 4 / SKETCH
    edge = lambda x, p: F.percentile_approx(x, F.lit(min(1.0, max(0.0, p))), SKETCH)
    sums = []
    for i, (_, x, p) in enumerate(each):
        # Brackets at the ends are open, and so are those of a key with at most SKETCH values: no rank falls outside.
        few = F.count(x) <= SKETCH
        low = F.min(x) if p <= room else F.when(few, F.min(x)).otherwise(edge(x, p - room))
        high = F.max(x) if p >= 1 - room else F.when(few, F.max(x)).otherwise(edge(x, p + room))
        sums += [F.count(x).alias(f"n{i}"), low.alias(f"a{i}"), high.alias(f"b{i}")]
    brackets = rows.groupBy(*keys).agg(*sums)
    wide = attach(rows, brackets, keys)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n"), F.when(F.col(x) < F.col(f"a{i}"), None).otherwise(F.col(x)).alias("x"), F.lit(p).alias("p")) for i, (_, x, p) in enumerate(each)]))
    inside = F.array(*[F.col(x).isNotNull() & (F.col(x) <= F.col(f"b{i}")) for i, (_, x, _) in enumerate(each)])
    counted = wide.select(*keys, values.alias("s"), inside.alias("inside")).where(F.get("inside", F.col("s.i"))).select(*keys, "s.*").groupBy(*keys, "i", "n", "p", "x").agg(F.count("*").alias("m"))
    # Values below the bracket are one count at null, which comes first.
    upto = F.sum("m").over(Window.partitionBy(*keys, "i").orderBy(F.col("x").asc_nulls_first()))
    place = F.col("p") * (F.col("n") - 1)
    ranked = counted.withColumn("upto", upto).withColumn("low", F.floor(place)).withColumn("high", F.ceil(place))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("x")))
    found = ranked.groupBy(*keys, "i", "n", "p").agg(at("low").alias("x0"), at("high").alias("x1"))
    share = F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))
    value = F.when(share == 0, F.col("x0")).otherwise((1 - share) * F.col("x0") + share * F.col("x1"))
    out = found.withColumn("value", value).groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, (name, _, _) in enumerate(each)])
    return attach(brackets.select(*keys), out, keys)


def medians(df: DataFrame, keys: list[str], attrs: list[str], how: str = "narrowed") -> DataFrame:
    """keys, and for each attribute the median and the median absolute deviation (not scaled); ``how`` as in ``quantiles``."""
    df, keys = keyed(df, keys)
    first = quantiles(df, keys, {a: F.col(f"`{a}`") for a in attrs}, {"med": 0.5}, how)
    gaps = {a: F.abs(number(f"`{a}`") - F.col(f"{a}_med")) for a in attrs}
    second = quantiles(attach(df.select(*keys, *[F.col(f"`{a}`") for a in attrs]), first, keys), keys, gaps, {"mad": 0.5}, how)
    return attach(first, second, keys)


def percentiles(df: DataFrame, keys: list[str], attrs: list[str], shares: dict[str, float], how: str = "narrowed") -> DataFrame:
    """keys, and ``{attr}_{name}`` for each share; ``how`` as in ``quantiles``."""
    return quantiles(df, keys, {a: F.col(f"`{a}`") for a in attrs}, shares, how)


def bin_of(value: Column, width: float, low: float = 0.0) -> Column:
    """Fixed-width bin number."""
    return F.floor((number(value) - F.lit(float(low))) / F.lit(float(width))).cast("long")


def histogram(df: DataFrame, keys: list[str], bins: list[Column], names: list[str]) -> DataFrame:
    """keys, bins, n (rows in the joint bin) and total (rows of the key)."""
    df, keys = keyed(df, keys)
    counts = df.groupBy(*keys, *[b.alias(n) for b, n in zip(bins, names, strict=True)]).agg(F.count("*").alias("n"))
    return attach(counts, counts.groupBy(*keys).agg(F.sum("n").alias("total")), keys)


def covariance(df: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """keys, means (array) and the flattened population covariance matrix (array), by one aggregation."""
    df, keys = keyed(df, keys)
    means = F.array(*[F.avg(number(a)) for a in attrs]).alias("means")
    cells = F.array(*[F.covar_pop(number(a), number(b)) for a in attrs for b in attrs]).alias("cov")
    return df.groupBy(*keys).agg(means, cells, F.count("*").alias("n"))
