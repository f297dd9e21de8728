"""Concept drift monitors over keyed streams of classifier errors (0 or 1), by running windows.

Each takes rows, the keys of a stream, its order (``seq``, ``tie``) and appends ``drift`` (0 or 1) with what the
decision rests on.  Rows of the warm-up are not judged; a null error is not counted and leaves everything as it was.  With ``keep`` a row also has ``state``, a struct; the last one of
each key (see ``state``) is what a next run takes as ``saved`` to go on as if it had never stopped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.score import number, sequence
from quietsignal.operators import models
from quietsignal.operators.fold import ordered_fold


def resumed(df: DataFrame, saved: DataFrame | None, keys: list[str]) -> tuple[DataFrame, Callable[[str, Column], Column]]:
    """Rows with the saved state of their key, and what a field of it is; the given default without one."""
    if saved is None:
        return df, lambda _, default: default
    out = models.attach(df, saved.select(*keys, F.col("state").alias("__s")), keys)
    return out, lambda name, default: F.coalesce(F.col(f"__s.{name}"), default)


def finished(out: DataFrame, keep: bool, columns: list[str], **fields: Column) -> DataFrame:
    """Without working columns; with ``keep`` also ``state``, from which a next run goes on after this row."""
    if keep:
        out = out.withColumn("state", F.struct(*[c.alias(n) for n, c in fields.items()]))
    return out.drop(*columns, "__s")


def ddm(df: DataFrame, keys: list[str], err: str, seq: str, tie: str, warm_up: int, factor: float, saved: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Drift if p + s exceeds p_min + factor * s_min, the minimum of p + s up to the row before.

    p is the running error rate, s = sqrt(p (1 - p) / n); the minimum starts at the end of the warm-up.
    """
    w = sequence(keys, [seq, tie])
    run, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out, old = resumed(df, saved, keys)
    n0, p0 = old("n", F.lit(0)), old("p", F.lit(0.0))
    x = F.col(err).cast("double")
    out = out.withColumn("n", (n0 + F.count(x).over(run)).cast("int")).withColumn("p", F.avg(x).over(run) if saved is None else F.try_divide(n0 * p0 + F.coalesce(F.sum(x).over(run), F.lit(0.0)), F.col("n")))
    out = out.withColumn("s", F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("n"))))
    state_ = F.when(F.col("n") >= warm_up, F.struct((F.col("p") + F.col("s")).alias("ps"), F.col("p").alias("p"), F.col("s").alias("s")))
    first = old("least", F.lit(None).cast("struct<ps:double,p:double,s:double>"))
    out = out.withColumn("low", F.least(first, F.min(state_).over(before))).withColumn("__least", F.least(first, F.min(state_).over(run)))
    hit = (F.col("n") > warm_up) & (F.col("p") + F.col("s") > F.col("low.p") + factor * F.col("low.s"))
    out = out.withColumn("drift", F.coalesce(hit, F.lit(False)).cast("int"))
    return finished(out, keep, ["low", "__least"], n=F.col("n"), p=F.col("p"), least=F.col("__least"))


def eddm(df: DataFrame, keys: list[str], err: str, seq: str, tie: str, warm_up: int, share: float, saved: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Drift if m + 2 sd of the distances between errors falls below ``share`` of its largest value so far.

    Only error rows after the first decide; other rows carry the last decision.
    """
    w = sequence(keys, [seq, tie])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast("double")
    out, old = resumed(df, saved, keys)
    out = out.withColumn("n", (old("n", F.lit(0)) + F.count(err).over(run)).cast("int")).withColumn("__at", F.when(F.col(err) == 1, F.col("n")))
    out = out.withColumn("__last", F.coalesce(F.last("__at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), old("last", F.lit(None).cast("int"))))
    out = out.withColumn("__d", F.when(F.col(err) == 1, (F.col("n") - F.col("__last")).cast("double")))
    zero = F.lit(0.0)
    sums = {"count": old("count", zero) + F.count("__d").over(run), "sum": old("sum", zero) + F.coalesce(F.sum("__d").over(run), zero), "squares": old("squares", zero) + F.coalesce(F.sum(F.col("__d") * F.col("__d")).over(run), zero)}
    for name, c in sums.items():
        out = out.withColumn(f"__{name}", c)
    mean = F.try_divide(F.col("__sum"), F.col("__count"))
    level = F.avg("__d").over(run) + 2 * F.stddev_pop("__d").over(run) if saved is None else mean + 2 * F.sqrt(F.greatest(F.col("__squares") / F.col("__count") - mean * mean, zero))
    out = out.withColumn("level", F.when(F.col("__d").isNotNull(), level))
    # The warm-up sets the first maximum with its last value; after it every error counts.
    out = out.withColumn("__start", F.coalesce(F.last(F.when(F.col("n") <= warm_up, F.col("level")), ignorenulls=True).over(run), old("start", none)))
    out = out.withColumn("__later", F.greatest(F.max(F.when(F.col("n") > warm_up, F.col("level"))).over(run), old("later", none)))
    own = F.when((F.col("n") > warm_up) & F.col("level").isNotNull(), (F.try_divide(F.col("level"), F.greatest("__start", "__later")) < share).cast("int"))
    out = out.withColumn("__f", own).withColumn("drift", F.coalesce(F.last("__f", ignorenulls=True).over(run), old("drift", F.lit(0))))
    now = F.coalesce("__at", "__last")
    return finished(out, keep, ["__at", "__last", "__d", "__f", "__start", "__later", "__count", "__sum", "__squares"], n=F.col("n"), last=now, count=F.col("__count"), sum=F.col("__sum"), squares=F.col("__squares"), start=F.col("__start"), later=F.col("__later"), drift=F.col("drift"))


def fhddm(df: DataFrame, keys: list[str], err: str, seq: str, tie: str, window: int, confidence: float, saved: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Drift if the accuracy of the last ``window`` rows is below the best so far by Hoeffding's bound sqrt(ln(2 / d) / (2 window))."""
    bound = math.sqrt(math.log(2 / confidence) / (2 * window))
    w = sequence(keys, [seq, tie])
    out, old = resumed(df, saved, keys)
    frame = w.rowsBetween(-(window - 1), 0)
    rate = F.avg(F.col(err).cast("double")).over(frame)
    out = out.withColumn("n", (old("n", F.lit(0)) + F.count(err).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    if saved is not None or keep:
        none = F.expr("CAST(array() AS array<double>)")
        whole = F.concat(old("recent", none), F.collect_list(F.col(err).cast("double")).over(frame))
        out = out.withColumn("__recent", whole).withColumn("__recent", F.slice("__recent", F.greatest(F.size("__recent") - window + 1, F.lit(1)), window))
        rate = F.aggregate("__recent", F.lit(0.0), lambda a, x: a + x) / F.size("__recent")
    out = out.withColumn("accuracy", F.when(F.col("n") >= window, 1 - rate))
    out = out.withColumn("__best", F.greatest(F.max("accuracy").over(w.rowsBetween(Window.unboundedPreceding, 0)), old("best", F.lit(None).cast("double"))))
    out = out.withColumn("drift", F.coalesce(F.col("__best") - F.col("accuracy") > bound, F.lit(False)).cast("int"))
    return finished(out, keep, ["__best", "__recent"], n=F.col("n"), best=F.col("__best"), **({"recent": F.col("__recent")} if keep else {}))


def paired_learners(df: DataFrame, keys: list[str], stable: str, reactive: str, seq: str, tie: str, threshold: float, warm_up: int = 0, saved: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Drift if the stable learner errs alone more often than the reactive one: (their difference) / n over ``threshold``."""
    w = sequence(keys, [seq, tie]).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when((F.col(stable) == 1) & (F.col(reactive) == 0), 1).when((F.col(stable) == 0) & (F.col(reactive) == 1), -1).otherwise(0)
    out, old = resumed(df, saved, keys)
    zero = F.lit(0).cast("long")
    out = out.withColumn("n", old("n", zero) + F.count(F.lit(1)).over(w)).withColumn("__steps", old("steps", zero) + F.sum(step).over(w))
    out = out.withColumn("difference", F.col("__steps") / F.col("n").cast("double"))
    out = out.withColumn("drift", ((F.col("n") > warm_up) & (F.col("difference") > threshold)).cast("int"))
    return finished(out, keep, ["__steps"], n=F.col("n"), steps=F.col("__steps"))


def ecdd(df: DataFrame, keys: list[str], err: str, seq: str, tie: str, smoothing: float, limit: float, warm_up: int = 0, saved: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Drift if the exponentially weighted error rate z exceeds p + limit * sd of z.

    z = (1 - e) z + e x from 0; p is the running rate; sd^2 = p (1 - p) e (1 - (1 - e)^(2 (t - 1))) / (2 - e).  z is
    a recursion: a key's rows pass in order, and three numbers stay.  A null error keeps the z of the row before.
    """
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField

    wide, old = resumed(df, saved, keys)
    zero = F.lit(0.0)
    wide = wide.withColumn("__t0", old("n", F.lit(0).cast("long"))).withColumn("__z0", old("z", zero)).withColumn("__p0", old("p", zero)).withColumn("__x", number(err)).drop("__s")

    def step(state: tuple[int, float, float], part: pd.DataFrame) -> tuple[tuple, list[list]]:
        t, z, p = state
        out: list[tuple] = []
        for x in part["__x"].to_numpy(float):
            if x != x:
                out.append((z, 0, t, p))
                continue
            t += 1
            p += (x - p) / t
            z = (1 - smoothing) * z + smoothing * x
            sd = math.sqrt(max(0.0, p * (1 - p) * smoothing * (1 - (1 - smoothing) ** (2 * (t - 1))) / (2 - smoothing)))
            out.append((z, int(t > warm_up and z > p + limit * sd), t, p))
        return (t, z, p), [list(c) for c in zip(*out, strict=True)]

    begin = lambda row: (int(row["__t0"]), float(row["__z0"]), float(row["__p0"]))
    added = [StructField("z", DoubleType()), StructField("drift", IntegerType()), StructField("__t", LongType()), StructField("__p", DoubleType())]
    out = ordered_fold(wide, keys, [seq, tie], ["__x", "__t0", "__z0", "__p0"], begin, step, added).drop("__t0", "__z0", "__p0", "__x")
    return finished(out, keep, ["__t", "__p"], n=F.col("__t"), z=F.col("z"), p=F.col("__p"))


def ensemble(df: DataFrame, flags: list[str], consensus: int) -> DataFrame:
    """``any_drift``, ``all_drift`` and ``drift`` (at least ``consensus`` of the flags)."""
    total = sum((F.col(f) for f in flags), F.lit(0))
    return df.withColumn("any_drift", (total > 0).cast("int")).withColumn("all_drift", (total == len(flags)).cast("int")).withColumn("drift", (total >= consensus).cast("int"))


def state(df: DataFrame, keys: list[str], columns: list[str], seq: str, tie: str) -> DataFrame:
    """The last row of each key: what a next run starts from."""
    df, own = models.keyed(df, keys)
    return df.groupBy(*own).agg(F.max(F.struct(seq, tie, *columns)).alias("s")).select(*own, *[F.col(f"s.{c}").alias(c) for c in columns])


def resume_rate(df: DataFrame, saved: DataFrame, keys: list[str], err: str, seq: str, tie: str) -> DataFrame:
    """Running error rate ``p`` and count ``n`` that go on from a saved state (keys, n, p)."""
    w = sequence(keys, [seq, tie]).rowsBetween(Window.unboundedPreceding, 0)
    base = models.attach(df, saved.select(*keys, F.col("n").alias("__n"), F.col("p").alias("__p")), keys)
    n0, p0 = F.coalesce("__n", F.lit(0)), F.coalesce("__p", F.lit(0.0))
    n = n0 + F.count(F.lit(1)).over(w)
    return base.withColumn("p", (n0 * p0 + F.sum(F.col(err).cast("double")).over(w)) / n).withColumn("n", n).drop("__n", "__p")
