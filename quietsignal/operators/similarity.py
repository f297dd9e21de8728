"""Pairs of rows that are alike over numeric and categorical attributes together, within one whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.score import number
from quietsignal.operators import models


def mixed_pairs(df: DataFrame, id_: str, numeric: dict[str, float], categorical: dict[str, float], most: int, scale: int = 1000, block: int = 2000) -> DataFrame:
    """source, target, dist of all pairs of different ids (the smaller is the source) at most ``most`` apart.

    The distance is floor(scale * (sum of weight * part) / (sum of weights)), with the weights given by attribute.  A
    numeric part is the difference over the attribute's range in the table (0 without a range), a categorical part 0 or 1.
    Null, NaN and infinite values are 0 from each other and 1 from any value.  Rows without an id are left out; rows that
    share an id are each paired with all others, and not with each other.  An empty table gives no pairs.

    Rows meet only where they can be near: a categorical attribute that alone would put two rows too far apart must be
    equal, and the numeric attribute of most weight is cut into bands as wide as the distance still allows, so a row meets
    its band and the next.  A band of many rows is dealt into hash buckets of about ``block`` rows, and each pair of
    buckets is a join key of its own: no key has to hold a band, however many rows it has.
    """
    total = float(sum(numeric.values()) + sum(categorical.values()))
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    values = {a: number(F.col(a)) for a in numeric}
    rows = df.select(F.col(id_).alias("id"), *[v.alias(f"x{i}") for i, v in enumerate(values.values())], *[F.col(c).alias(f"c{i}") for i, c in enumerate(categorical)]).where("id IS NOT NULL")
    ends = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(values)) for n, f in (("lo", F.min), ("hi", F.max))]).first() if values else None
    low = [ends[f"lo{i}"] or 0.0 for i in range(len(values))]
    span = [(ends[f"hi{i}"] or 0.0) - low[i] for i in range(len(values))]
    # Parts of a pair under this limit; a little wider than exact, as the distance itself decides.
    limit = (most + 1) / scale * total * (1 + 1e-9)

    strict = [F.col(f"c{i}") for i, w in enumerate(categorical.values()) if w >= limit]
    rows = rows.withColumn("__e", F.xxhash64(*strict, *[c.isNull() for c in strict]) if strict else F.lit(0).cast("long"))
    wide = max(range(len(values)), key=list(numeric.values()).__getitem__) if values else None
    if wide is not None and span[wide] > 0 and list(numeric.values())[wide] > limit:
        band = F.floor((F.col(f"x{wide}") - low[wide]) / span[wide] / (limit / list(numeric.values())[wide]))
        rows = rows.withColumn("__c", F.coalesce(band.cast("long"), F.lit(-2).cast("long")))
    else:
        rows = rows.withColumn("__c", F.lit(0).cast("long"))

    near = Window.partitionBy("__e").orderBy("__c")
    counts = rows.groupBy("__e", "__c").count().withColumn("__n", F.ceil(F.col("count") / block).cast("int"))

    def beside(step: int, f) -> Column:
        return F.when(f("__c").over(near) == F.col("__c") + step, f("__n").over(near))

    counts = counts.select("__e", "__c", "__n", beside(-1, F.lag).alias("__before"), beside(1, F.lead).alias("__after"))
    dealt = rows.join(counts, ["__e", "__c"]).withColumn("__h", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))

    def copies(n: str, same: bool) -> Column:
        """The buckets of a band (this or one beside) that a row has to meet."""
        each = F.sequence(F.lit(0), F.col(n) - 1)
        return F.when(F.col(n) > 0, F.transform(each, lambda b: F.struct(F.lit(same).alias("same"), b.alias("b")))).otherwise(F.array().cast("array<struct<same:boolean,b:int>>"))

    parts = [f"{x}{i}" for x, own in (("x", numeric), ("c", categorical)) for i in range(len(own))]
    own = ["__e", "__c", "__h", "same", "b"]
    left = dealt.withColumn("__m", F.explode(F.concat(copies("__n", True), copies("__after", False)))).select("__e", "__c", "__h", "__m.same", "__m.b", F.col("id").alias("source"), *[F.col(p).alias(f"{p}_a") for p in parts])
    # A right row is bucket b of its band; the left one's band is the same or the one before.
    right = dealt.withColumn("__m", F.explode(F.concat(copies("__n", True), copies("__before", False)))).select("__e", F.when(F.col("__m.same"), F.col("__c")).otherwise(F.col("__c") - 1).alias("__c"), F.col("__m.b").alias("__h"), "__m.same", F.col("__h").alias("b"), F.col("id").alias("target"), *[F.col(p).alias(f"{p}_b") for p in parts])

    def part(p: str, i: int) -> Column:
        a, b = F.col(f"{p}{i}_a"), F.col(f"{p}{i}_b")
        apart = F.when(a.eqNullSafe(b), 0.0)
        if p == "c":
            return apart.otherwise(1.0)
        return apart.when(a.isNull() | b.isNull(), 1.0).otherwise(F.abs(a - b) / span[i] if span[i] > 0 else F.lit(0.0))

    weighted = [part(p, i) * float(w) for p, weights in (("x", numeric), ("c", categorical)) for i, w in enumerate(weights.values())]
    dist = F.floor(sum(weighted[1:], weighted[0]) / total * scale).cast("long")
    met = left.join(right, own).where(~F.col("same") & (F.col("source") != F.col("target")) | (F.col("source") < F.col("target")))
    met = met.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), dist.alias("dist"))
    return met.where(F.col("dist") <= most)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers that follow each other as doubles do; by the same way back."""
    i = np.asarray(x).view(np.int64)
    return i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def farthest(x: np.ndarray, end: float, near) -> np.ndarray:
    """For each x the double farthest from it towards ``end`` that is still ``near`` to it; what lies between is too."""
    a, b = ordered(x), ordered(np.full(len(x), end))
    done = near(np.full(len(x), end), x)
    a = np.where(done, b, a)
    while (np.abs(a - b) > 1).any():
        mid = (a >> 1) + (b >> 1) + (a & b & 1)
        good = near(ordered(mid).view(np.float64), x)
        a, b = np.where(good, mid, a), np.where(good, b, mid)
        b = np.where(done, a, b)
    return ordered(a).view(np.float64)


def mixed_degrees(df: DataFrame, id_: str, numeric: dict[str, float], categorical: dict[str, float], most: int, scale: int = 1000, cell: int = 50_000) -> DataFrame:
    """``id_`` and n, how many pairs of ``mixed_pairs`` an id is in, if any; counted and not paired, so work grows with the rows.

    With one numeric attribute, what is near a row is a range of values, for each set of categorical attributes that
    differ.  Rows in a range are those up to its end less those before its start: running sums over the values, in cells of
    about ``cell`` distinct ones, and sums of the cells before.  Rows that differ in just these attributes are counted as those that
    agree in all others, less (plus) those that also agree in one (two) of these, and so on.  The ends of a range are the last doubles whose
    distance, as it is worked out for a pair, is not too large.
    """
    if len(numeric) != 1:
        raise ValueError("ranges are of one numeric attribute")
    total = float(sum(numeric.values()) + sum(categorical.values()))
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    ((attr, weight),) = numeric.items()
    cats, weights = [f"c{i}" for i in range(len(categorical))], [float(w) for w in categorical.values()]
    rows = df.select(F.col(id_).alias("id"), number(F.col(attr)).alias("x"), *[F.col(c).alias(n) for n, c in zip(cats, categorical, strict=True)]).where("id IS NOT NULL")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    low, high = low or 0.0, high or 0.0
    span, every = high - low, (1 << len(cats)) - 1

    def near(part: np.ndarray | float, other: int):
        """Whether a pair with this numeric part that differs in the attributes of ``other`` is near."""
        out = part * float(weight)
        for i, w in enumerate(weights):
            out = out + (1.0 if other >> i & 1 else 0.0) * w
        return np.floor(out / total * scale) <= most

    allowed = [s for s in range(every + 1) if near(0.0, s)]
    if not allowed:
        return rows.where(F.lit(False)).select(F.col("id").alias(id_), F.lit(0).cast("long").alias("n"))

    def within(rows: DataFrame, fixed: list[str]) -> DataFrame:
        """fixed, categorical attributes, x and n: near rows (the row itself too) that agree in ``fixed``."""
        own = [*fixed, *cats]
        counted = rows.groupBy(*own, "x").agg(F.count("*").alias("rows"))
        values = counted.where("x IS NOT NULL").select("x").distinct()
        cells = -(-values.count() // cell)
        cuts = np.unique(values.approxQuantile("x", [k / cells for k in range(1, cells)], 0.1 / cells)) if cells > 1 else np.zeros(0)
        fields = "x double, cell int, " + ", ".join(f"a{s} double, b{s} double, ca{s} int, cb{s} int" for s in allowed)

        def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = lambda y: np.searchsorted(cuts, y, side="right")
            for frame in frames:
                x = frame["x"].to_numpy(float)
                out = {"x": x, "cell": at(x)}
                for s in allowed:
                    close = lambda y, z: near(np.abs(y - z) / span if span > 0 else np.zeros(len(z)), s)  # noqa: B023, E731
                    a, b = farthest(x, low, close), farthest(x, high, close)
                    out |= {f"a{s}": a, f"b{s}": b, f"ca{s}": at(a), f"cb{s}": at(b)}
                yield pd.DataFrame(out)

        found = models.attach(counted, values.mapInPandas(ends, fields), ["x"])
        # What is asked for: rows up to y (kind 1) or before y (kind -1) among values or nulls (void) that agree in ``agree``.
        asks, none = [], F.col("x").isNull()
        ask = lambda agree, sign, void, place, y, kind: F.struct(F.lit(agree).alias("agree"), F.lit(sign).alias("sign"), F.lit(void).alias("void"), place.cast("int").alias("cell"), y.cast("double").alias("y"), F.lit(kind).alias("kind"))
        for s in allowed:
            for u in range(s + 1):
                if u & ~s:
                    continue
                agree, sign = (every & ~s) | u, -1 if u.bit_count() % 2 else 1
                asks.append(F.when(~none, ask(agree, sign, False, F.col(f"cb{s}"), F.col(f"b{s}"), 1)))
                asks.append(F.when(~none, ask(agree, -sign, False, F.col(f"ca{s}"), F.col(f"a{s}"), -1)))
                # Nulls are 0 from each other, and 1 from any value.
                asks.append(F.when(none, ask(agree, sign, True, F.lit(0), F.lit(0.0), 1)))
                if near(1.0, s):
                    asks.append(F.when(none, ask(agree, sign, False, F.lit(len(cuts)), F.lit(float("inf")), 1)))
                    asks.append(F.when(~none, ask(agree, sign, True, F.lit(0), F.lit(0.0), 1)))
        agrees = sorted({(every & ~s) | u for s in allowed for u in range(s + 1) if not u & ~s})
        asked = F.explode(F.filter(F.array(*asks), lambda a: a.isNotNull()))
        data = found.select(*own, "x", "rows", "cell", F.explode(F.lit(agrees)).alias("agree")).select(*own, "x", "agree", F.lit(0).alias("sign"), none.alias("void"), F.coalesce("cell", F.lit(0)).alias("cell"), F.coalesce("x", F.lit(0.0)).alias("y"), F.lit(0).alias("kind"), "rows")
        both = data.unionByName(found.select(*own, "x", asked.alias("q")).select(*own, "x", "q.*", F.lit(0).cast("long").alias("rows")))
        line = [*fixed, "agree", *[f"g{i}" for i in range(len(cats))], "void"]
        both = both.withColumns({f"g{i}": F.when(F.col("agree").bitwiseAND(1 << i) > 0, F.col(c)) for i, c in enumerate(cats)})
        inside = F.sum("rows").over(Window.partitionBy(*line, "cell").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0))
        before = F.sum("rows").over(Window.partitionBy(*line).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        earlier = both.groupBy(*line, "cell").agg(F.sum("rows").alias("rows")).select(*line, "cell", F.coalesce(before, F.lit(0)).alias("before"))
        answers = models.attach(both.withColumn("inside", inside).where("kind <> 0"), earlier, [*line, "cell"])
        return answers.groupBy(*own, "x").agg(F.sum(F.col("sign") * (F.col("inside") + F.col("before"))).alias("n"))

    # Rows that share an id do not count each other, nor a row itself.
    again = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    degrees = models.attach(rows, within(rows, []), [*cats, "x"])
    if again.isEmpty():
        degrees = degrees.withColumn("n", F.col("n") - 1)
    else:
        shared = within(rows.join(again, F.col("id") == F.col("again"), "left_semi"), ["id"]).withColumnRenamed("n", "own")
        degrees = models.attach(degrees, shared, ["id", *cats, "x"]).withColumn("n", F.col("n") - F.coalesce("own", F.lit(1)))
    return degrees.groupBy(F.col("id").alias(id_)).agg(F.sum("n").cast("long").alias("n")).where("n > 0")
