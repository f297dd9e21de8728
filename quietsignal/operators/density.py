"""Nearest neighbours within a key, and the detectors that rest on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.operators import models
from quietsignal.operators.knn import nearest

#: The least mean reachability that ``lof`` counts with.
LEAST_REACH = 1e-10


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of numbers, in doubles."""
    each = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "manhattan":
        return F.aggregate(each, F.lit(0.0), lambda s, d: s + F.abs(d))
    return F.sqrt(F.aggregate(each, F.lit(0.0), lambda s, d: s + d * d))


def pair_distances(df: DataFrame, keys: list[str], id_: str, vector: str, scale: int | None = None, most_rows: int = 20_000) -> DataFrame:
    """keys, source, target, dist of all ordered pairs within a key; scaled to integers with ``scale``.

    Quadratic by its definition, so a key with more than ``most_rows`` rows is an error; ``nearest`` is the way for those.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > most_rows:
        raise ValueError(f"a key has {largest} rows; all pairs are made for {most_rows} at most")
    a = df.select(*keys, F.col(id_).alias("source"), F.col(vector).alias("va"))
    b = df.select(*keys, F.col(id_).alias("target"), F.col(vector).alias("vb"))
    out = a.join(b, keys).where("source <> target").withColumn("dist", distance(F.col("va"), F.col("vb"))).drop("va", "vb")
    return out.withColumn("dist", F.floor(F.col("dist") * scale).cast("long")) if scale else out


def distance_sums(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> tuple[float, float, float]:
    """How many pairs of a row of ``a`` and one of ``b`` with different ids there are, by weights, the sum of their distances, and the least one.

    Distances come from a product of matrices; those too small for its rounding, and the least one, from differences.
    """
    n, total, least = 0.0, 0.0, float("nan")
    finite = np.isfinite(b).all(1)
    clean = np.where(finite[:, None], b, 0)
    squares, shared = (clean * clean).sum(1), len(np.intersect1d(ia, ib)) > 0

    def exact(i: np.ndarray, j: np.ndarray, part: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):  # infinity less infinity
            return np.sqrt(((part[i] - b[j]) ** 2).sum(1))

    for at in range(0, len(a), 256):
        part, w = a[at : at + 256], wa[at : at + 256]
        whole = np.isfinite(part).all(1)
        safe = np.where(whole[:, None], part, 0)
        both = (safe * safe).sum(1)[:, None] + squares[None, :]
        d = np.maximum(both - 2 * (safe @ clean.T), 0)
        small = (d <= 1e-6 * both) | ~whole[:, None] | ~finite[None, :]
        d = np.sqrt(d)
        other = ia[at : at + 256, None] != ib[None, :] if shared else np.ones(d.shape, bool)
        i, j = np.nonzero(small & other)
        for k in range(0, len(i), 100_000):
            d[i[k : k + 100_000], j[k : k + 100_000]] = exact(i[k : k + 100_000], j[k : k + 100_000], part)
        if shared:
            d[~other] = 0
        n += float(w @ other @ wb)
        total += float(w @ d @ wb)
        d[~other] = np.inf
        if other.any():
            # NaN is greater than all others, as Spark orders it.
            first = np.fmin.reduce(d, axis=None)
            i, j = np.nonzero(other & (d <= first * (1 + 1e-6)))
            if np.isfinite(first) and first > 0:
                first = min(exact(i[k : k + 100_000], j[k : k + 100_000], part).min() for k in range(0, len(i), 100_000))
            elif np.isinf(first) and not (other & (d == np.inf)).any():
                first = np.nan
            least = np.fmin(least, first)
    return n, total, float(least)


def pair_summary(df: DataFrame, keys: list[str], id_: str, vector: str, block: int = 4096) -> DataFrame:
    """keys, pairs (how many ordered pairs of different ids ``pair_distances`` has), mean_dist and least, by pairs of blocks.

    All distances are worked out, as many as pairs, but none is a row: a key's rows are dealt to blocks of about ``block``
    rows, and each pair of blocks is a group of its own that gives its count, sum and least.  Pairs whose distance
    is null (null vectors or components, other lengths) count as pairs only.
    """
    own = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], F.col(f"`{id_}`").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v"))
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*own, "id"]))
    ids = rows.groupBy(*own, "id").agg(F.count("*").alias("n"))
    counts = ids.groupBy(*own).agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).cast("long").alias("pairs")).where("pairs > 0")
    # Rows alike in id and vector are one, with a weight; they would all fall into one block.
    whole = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).groupBy(*own, "id", "v").agg(F.count("*").cast("double").alias("w")).withColumn("size", F.size("v"))
    by = [*own, "size"]
    blocks = whole.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = models.attach(whole, blocks, by).withColumn("b", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("b", "o"), "q": F.greatest("b", "o")})
    names = [*own, "n", "total", "least", "total_nan", "least_nan"]
    fields = [met.schema[o] for o in own]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        x, w, code = np.stack(part["v"].to_numpy()), part["w"].to_numpy(), pd.factorize(part["id"])[0]
        first = (part["b"] == part["p"]).to_numpy()
        second, times = (first, 1) if part["p"].iloc[0] == part["q"].iloc[0] else (~first, 2)
        n, total, least = distance_sums(x[first], x[second], w[first], w[second], code[first], code[second])
        # From pandas NaN would come as null, so it is told apart.
        return pd.DataFrame([[*(part[o].iloc[0] for o in own), times * n, times * total, least, bool(np.isnan(total)), bool(np.isnan(least))]], columns=names)

    group = [*by, "p", "q"]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "n double, total double, least double, total_nan boolean, least_nan boolean"])
    found = models.spread(met.select(*group, "b", "id", "v", "w"), group).groupBy(*group).applyInPandas(work, schema).where("n > 0")
    found = found.withColumns({c: F.when(F.col(f"{c}_nan"), F.lit(float("nan"))).otherwise(F.col(c)) for c in ("total", "least")})
    sums = found.groupBy(*own).agg((F.sum("total") / F.sum("n")).alias("mean_dist"), F.min("least").alias("least"))
    out = counts.join(sums, own, "left")
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "pairs", "mean_dist", "least")


def key_columns(neighbours: DataFrame) -> list[str]:
    """The keys of a table of neighbours: what stands before its sources."""
    return neighbours.columns[: neighbours.columns.index("source")]


def lof(neighbours: DataFrame) -> DataFrame:
    """keys, source, lof: the mean local reachability density of a row's neighbours over its own.

    Ids may repeat over keys.  A mean reachability below ``LEAST_REACH`` counts as that, so rows among more than k copies
    of themselves get 1 and not null.
    """
    own = key_columns(neighbours)
    kdist = neighbours.groupBy(*own, F.col("source").alias("target")).agg(F.max("dist").alias("kd"))
    reach = models.attach(neighbours, kdist, [*own, "target"]).where(F.col("kd").isNotNull()).withColumn("reach", F.greatest("dist", "kd"))
    lrd = reach.groupBy(*own, "source").agg((1 / F.greatest(F.avg("reach"), F.lit(LEAST_REACH))).alias("lrd"))
    theirs = models.attach(neighbours, lrd.select(*own, F.col("source").alias("target"), F.col("lrd").alias("other")), [*own, "target"]).groupBy(*own, "source").agg(F.avg("other").alias("other"))
    return models.attach(theirs, lrd, [*own, "source"]).where(F.col("lrd").isNotNull()).select(*own, "source", F.try_divide("other", "lrd").alias("lof"))


def average_distance(pairs: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """keys, source, avg_dist: integer mean of the ``k`` smallest distances."""
    w = Window.partitionBy(*keys, "source").orderBy("dist", "target")
    top = pairs.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k)
    return top.groupBy(*keys, "source").agg(F.floor(F.sum("dist") / F.count("*")).cast("long").alias("avg_dist"))


def density(average: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """``density``: scale over the average distance, in integers; a distance of 0 counts as 1."""
    return average.withColumn("density", F.floor(F.lit(scale) / F.greatest("avg_dist", F.lit(1))).cast("long"))


def neighbour_groups(pairs: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """keys, leader, member, place: each row leads a group of itself (0) and its ``k`` nearest."""
    w = Window.partitionBy(*keys, "source").orderBy("dist", "target")
    top = pairs.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).select(*keys, F.col("source").alias("leader"), F.col("target").alias("member"), F.col("__k").alias("place"))
    return top.unionByName(top.select(*keys, "leader").distinct().withColumn("member", F.col("leader")).withColumn("place", F.lit(0)))


def relative_density(groups: DataFrame, densities: DataFrame, scale: int = 1000) -> DataFrame:
    """keys, leader, relative: the leader's density times ``scale`` over the sum of its group's (its own included)."""
    own = groups.columns[: groups.columns.index("leader")]
    joined = models.attach(groups, densities.select(*own, F.col("source").alias("member"), "density"), [*own, "member"])
    leader = F.sum(F.when(F.col("place") == 0, F.col("density")))
    return joined.groupBy(*own, "leader").agg(F.floor(leader * scale / F.sum("density")).cast("long").alias("relative"))


def neighbour_drift(neighbours: DataFrame, later: DataFrame, top: int | None = None) -> DataFrame:
    """keys, source, drift: neighbours from the other half over those of its own, less 1; the ``top`` largest by size.

    ``later`` (keys, id, late) tells each row's half, or (id, late) where ids are unique over keys; no neighbour of its own half counts as one.
    """
    own = key_columns(neighbours)
    by = [k for k in own if k in later.columns]
    half = lambda of, name: later.select(*by, F.col("id").alias(of), F.col("late").alias(name))
    a = models.attach(models.attach(neighbours, half("source", "la"), [*by, "source"]), half("target", "lb"), [*by, "target"]).where("la IS NOT NULL AND lb IS NOT NULL")
    other = F.count_if(F.col("la") != F.col("lb"))
    out = a.groupBy(*own, "source").agg((other / F.greatest(F.count("*") - other, F.lit(1)) - 1).alias("drift"))
    return out if top is None else out.orderBy(F.abs("drift").desc(), "source", *own).limit(top)


def classifier_drift(neighbours: DataFrame, later: DataFrame) -> DataFrame:
    """certainty: mean over rows of the larger share of a half among its neighbours; 0.5 if old and new mix, 1 if they part.

    ``later`` as in ``neighbour_drift``.
    """
    own = key_columns(neighbours)
    by = [k for k in own if k in later.columns]
    known = models.attach(neighbours, later.select(*by, F.col("id").alias("target"), "late"), [*by, "target"]).where("late IS NOT NULL")
    votes = known.groupBy(*own, "source").agg(F.avg(F.col("late").cast("int").cast("double")).alias("p"))
    return votes.agg(F.avg(F.greatest("p", 1 - F.col("p"))).alias("certainty"))


def large_clusters(clusters: list[dict], share: float = 0.9, ratio: float = 5.0) -> list[dict]:
    """Clusters (id, size, center) with ``large``: the largest until ``share`` of all rows, or until a next one is ``ratio`` times smaller."""
    out, total, upto, open_ = [], sum(c["size"] for c in clusters), 0, True
    ranked = sorted(clusters, key=lambda c: -c["size"])
    for i, c in enumerate(ranked):
        out.append({**c, "large": open_})
        upto += c["size"]
        if upto >= share * total or i + 1 < len(ranked) and c["size"] >= ratio * ranked[i + 1]["size"]:
            open_ = False
    return out


def cluster_distance(df: DataFrame, attrs: list[str], clusters: list[dict], exp_const: float = 0.0) -> DataFrame:
    """Distance to the nearest cluster if it is large, else to the nearest large one.  Clusters are a short literal list."""
    from quietsignal.functions.score import exp_scale

    if not any(c["large"] for c in clusters):
        raise ValueError("no large cluster")
    here = F.array(*[F.col(a).cast("double") for a in attrs])
    each = [F.struct(distance(here, F.array(*[F.lit(float(x)) for x in c["center"]])).alias("d"), F.lit(c["id"]).alias("id"), F.lit(c["large"]).alias("large")) for c in sorted(clusters, key=lambda c: c["id"])]
    nearest_ = F.array_min(F.array(*each))
    large = F.array_min(F.filter(F.array(*each), lambda c: c["large"]))
    score = F.when(nearest_["large"], nearest_["d"]).otherwise(large["d"])
    return df.withColumn("cluster", nearest_["id"]).withColumn("score", exp_scale(exp_const, score) if exp_const > 0 else score)


__all__ = ["average_distance", "classifier_drift", "cluster_distance", "density", "distance", "large_clusters", "lof", "nearest", "neighbour_drift", "neighbour_groups", "pair_distances", "pair_summary", "relative_density"]
