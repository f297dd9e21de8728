"""Isolation forest: growth of trees on samples, growth that goes on, and scoring.

A tree is a table of nodes (keys, tree, node, attr, split, n, leaf); node 1 is the root and the children of node
i are 2 i (below the split) and 2 i + 1.  Samples have a fixed size, so one grouped call grows a whole tree; rows to
score meet the nodes of their key in tasks that hold one key's forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietsignal.functions.score import number
from quietsignal.operators import models

MIN_RANGE = 0.001
NODES = "tree long, node long, attr int, split double, n long, leaf boolean"


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows: 2 (ln(n - 1) + 0.5772156649) - 2 (n - 1) / n; 1 for 2, 0 below."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def hash_choice(tree: int, node: int) -> tuple[int, float]:
    """A number below 2 ** 32 that picks the attribute, and a share in [0, 1) that places the split."""
    pick = lambda s: int(hashlib.md5(f"{s}:{tree}:{node}".encode()).hexdigest()[:8], 16)
    return pick("a"), pick("s") / 2**32


def random_choice(seed: int) -> Callable[[int, int], tuple[int, float]]:
    """Choices of a generator seeded by tree and node, so a repeated task grows the same tree."""

    def choose(tree: int, node: int) -> tuple[int, float]:
        rng = np.random.default_rng((seed, tree, node))
        return int(rng.integers(1 << 32)), float(rng.random())

    return choose


def grow(x: np.ndarray, tree: int, depth: int, choose: Callable[[int, int], tuple[int, float]], old: pd.DataFrame | None = None) -> list[tuple]:
    """Nodes of a tree over the rows of ``x``; splits of ``old`` are kept, and its leaves grow on."""
    splits = {} if old is None else {int(r.node): (int(r.attr), float(r.split)) for r in old.itertuples() if not r.leaf}
    out, level = [], [(1, np.arange(len(x)))]
    for d in range(depth + 1):
        below = []
        for node, rows in level:
            own = x[rows]
            if node in splits:
                a, split = splits[node]
            else:
                a, share = choose(tree, node)
                a %= x.shape[1]
                low, high = (own[:, a].min(), own[:, a].max()) if len(rows) else (0.0, 0.0)
                if d == depth or len(rows) <= 1 or high - low <= MIN_RANGE:
                    out.append((tree, node, None, None, len(rows), True))
                    continue
                split = low + (high - low) * share
            out.append((tree, node, int(a), float(split), len(rows), False))
            right = own[:, a] >= split
            below += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        level = below
    return out


def samples(df: DataFrame, id_: str, attrs: list[str], trees: int, size: int) -> DataFrame:
    """tree, rank_hash, id, attrs: for each tree the ``size`` rows with the smallest hashes of tree and id; ties by id.

    A sample does not grow with the table, and those of two tables merge: see ``merge``.  Only rows whose hash is
    among the smallest 4 ``size`` + 64 by expectation are ranked; that fewer than ``size`` of them come up has a chance
    below e^-``size``.
    """
    n = df.count()
    share = min(1.0, (4 * size + 64) / max(1, n))
    ranked = lambda tree: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("r"), tree, F.col("id"))), 1, 8), 16, 10).cast("long")
    own = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), lambda tree: ranked(tree) <= F.lit(int(share * (1 << 32))))
    rows = df.select(F.col(id_).alias("id"), *[number(a).alias(a) for a in attrs]).dropna().withColumn("tree", F.explode(own)).withColumn("rank_hash", ranked(F.col("tree")))
    return lowest(rows, size)


def lowest(rows: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("tree").orderBy("rank_hash", "id")
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= size).drop("__k")


def fit(sampled: DataFrame, attrs: list[str], depth: int, choose: Callable[[int, int], tuple[int, float]] = hash_choice, old: DataFrame | None = None) -> DataFrame:
    """The forest of ``samples``; with ``old`` nodes these keep their splits and go on growing (incremental mode)."""

    names, goes_on = [c.split()[0] for c in NODES.split(", ")], old is not None

    def one(part: pd.DataFrame) -> pd.DataFrame:
        before = None
        if goes_on:
            part, before = part[~part["__old"]], part[part["__old"]]
            if not len(part):
                return before[names]
        rows = grow(part.sort_values("id")[attrs].to_numpy(float), int(part["tree"].iloc[0]), depth, choose, before if before is not None and len(before) else None)
        return pd.DataFrame(rows, columns=names).astype({"attr": "Int32"})

    if old is None:
        return sampled.groupBy("tree").applyInPandas(one, NODES)
    both = sampled.withColumn("__old", F.lit(False)).unionByName(old.withColumn("__old", F.lit(True)), allowMissingColumns=True)
    return both.groupBy("tree").applyInPandas(one, NODES)


def merge(old_sample: DataFrame, new_sample: DataFrame, size: int) -> DataFrame:
    """The sample of both tables together, from a sample of each; as ``fit`` takes it, with ``old`` nodes or without."""
    return lowest(old_sample.unionByName(new_sample), size)


class Trees:
    """A forest as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.trees = []
        for _, part in rows.sort_values(["tree", "node"]).groupby("tree"):
            nodes = part["node"].to_numpy(np.int64)

            def child(side: int, nodes: np.ndarray = nodes) -> np.ndarray:
                at = np.minimum(np.searchsorted(nodes, 2 * nodes + side), len(nodes) - 1)
                return np.where(nodes[at] == 2 * nodes + side, at, -1)

            length = np.floor(np.log2(nodes.astype(float))) + path_norm(part["n"].to_numpy())
            self.trees.append((part["attr"].fillna(0).to_numpy(int), part["split"].fillna(0).to_numpy(float), child(0), child(1), length, int(part["n"].iloc[0])))
        self.norm = float(path_norm(np.mean([t[5] for t in self.trees]))) if self.trees else 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for attr, split, left, right, length, _ in self.trees:
            node = np.zeros(len(x), int)
            while True:
                inner = left[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), attr[node]] >= split[node]
                node = np.where(inner, np.where(go, right[node], left[node]), node)
            total += length[node]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(self.norm, 1e-9))


#: Rows of a key that one task scores (about); the key's nodes are sent once for each such share.
SHARE_ROWS = 500_000


def score(df: DataFrame, forest: DataFrame, attrs: list[str], key_filter: str | None = None, keys: list[str] | None = None, model_filter: str | None = None) -> DataFrame:
    """``score`` = 2 ^ (-mean path length / path_norm(rows of a tree's sample)), by following all trees in numpy.

    A path ends in a leaf of n rows and counts its depth and path_norm(n).  With ``keys``, a row follows the trees
    of its own key (nodes of ``fit_by_key``); without a forest its score is null, and so it is with a null or NaN
    attribute.  Nodes and rows of a key meet in the same tasks, nodes first; a task holds one key's forest, whatever
    the number of keys, and nothing passes the driver.  A key with many rows has several tasks, by the partition that
    a row comes from.  ``key_filter`` chooses rows, and ``model_filter`` nodes, by SQL.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    chosen = df if key_filter is None else df.where(key_filter)
    nodes = forest if model_filter is None else forest.where(model_filter)
    named = [x for k in keys or [] for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))]
    group = [F.xxhash64(*named).alias("g1"), F.xxhash64(F.lit(7), *named).alias("g2")] if keys else [F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2")]
    sizes = chosen.select(*group).groupBy("g1", "g2").agg(F.ceil(F.count("*") / SHARE_ROWS).cast("int").alias("shares"))
    least = F.lit(1) if keys else F.lit(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sizes = sizes.withColumn("shares", F.greatest("shares", least))
    fields = [c.split()[0] for c in NODES.split(", ")]
    whole = F.struct(*[F.col(f"`{c}`") for c in chosen.columns])
    values = F.array(*[number(f"`{a}`") for a in attrs])
    rows = chosen.select(*group, F.spark_partition_id().alias("from"), F.lit(1).alias("kind"), values.alias("x"), whole.alias("row"))
    rows = models.attach(rows, sizes, ["g1", "g2"]).withColumn("share", F.pmod("from", "shares"))
    tree = F.struct(*[F.col(c) for c in fields])
    leading = nodes.select(*group, F.lit(0).alias("kind"), tree.alias("node")).join(sizes, ["g1", "g2"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    sent = ["g1", "g2", "share", "kind"]
    both = leading.select(*sent, "node", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast(rows.schema["row"].dataType).alias("row")).unionByName(rows.select(*sent, F.lit(None).cast(leading.schema["node"].dataType).alias("node"), "x", "row"))
    placed = models.spread(both, ["g1", "g2", "share"]).withColumn("__place", F.row_number().over(Window.partitionBy("g1", "g2", "share").orderBy("kind")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        trees: Trees | None = None
        for batch in batches:
            kind, fresh = batch.column("kind").to_numpy(), batch.column("__place").to_numpy() == 1
            cuts = sorted({0, *np.flatnonzero(fresh).tolist(), *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if fresh[a]:
                    held, trees = [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(pd.DataFrame({f: part.column("node").field(f).to_pandas() for f in fields}))
                    continue
                if held:
                    held, trees = [], Trees(pd.concat(held))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b - a, len(attrs))
                out, good = np.full(b - a, np.nan), ~np.isnan(x).any(1)
                if trees is not None and good.any():
                    out[good] = trees.score(x[good])
                yield pa.record_batch([part.column("row"), pa.array(out, mask=np.isnan(out))], ["row", "score"])

    scored = placed.mapInArrow(work, StructType([StructField("row", rows.schema["row"].dataType), StructField("score", DoubleType())]))
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in chosen.columns], "score")


def fit_by_key(df: DataFrame, keys: list[str], attrs: list[str], trees: int = 100, subsample: int = 100, depth: int | None = None, seed: int = 1) -> DataFrame:
    """keys and nodes of a random forest for each key, on samples of ``subsample`` rows (three quarters of a smaller key).

    Rows are ranked by a hash for each tree only among a key's candidates, which a first bound has thinned out; rows with
    a null or NaN attribute are none.  A key's samples, ``trees`` times ``subsample`` rows at most, make its forest in one call.
    """
    df, own = models.keyed(df, keys)
    depth = depth or int(np.ceil(np.log2(max(2, subsample))))
    counts = df.dropna(subset=attrs).groupBy(*own).agg(F.count("*").alias("__n"))
    take = F.when(F.col("__n") > subsample, F.lit(subsample)).otherwise(F.greatest(F.floor(F.col("__n") * 0.75), F.lit(1))).cast("int")
    wide = models.attach(df.select(*own, *[number(a).alias(a) for a in attrs]).dropna(subset=attrs), counts, own).withColumn("__take", take)
    # Only the trees that a row is a candidate of become rows.
    h = lambda tree: F.pmod(F.xxhash64(F.lit(seed), tree, *attrs), F.lit(1 << 30))
    few = F.lit(float(1 << 30)) * F.greatest(F.col("__take") * 4, F.lit(64))
    own_trees = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), lambda tree: h(tree).cast("double") * F.col("__n") <= few)
    thinned = wide.withColumn("tree", F.explode(own_trees)).withColumn("__h", h(F.col("tree")))
    ranked = thinned.withColumn("__k", F.row_number().over(Window.partitionBy(*own, "tree").orderBy("__h", *attrs))).where("__k <= __take")
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in own)
    choose = random_choice(seed)

    def all_of(part: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for tree, rows in part.sort_values("__k").groupby("tree"):
            found += grow(rows[attrs].to_numpy(float), int(tree), depth, choose)
        nodes = pd.DataFrame(found, columns=[c.split()[0] for c in NODES.split(", ")]).astype({"attr": "Int32"})
        return nodes.assign(**{k: [part[k].iloc[0]] * len(nodes) for k in own})[[*own, *nodes.columns]]

    group = own if keys else [*own, "tree"]  # a single forest is grown tree by tree
    return models.spread(ranked, group).groupBy(*group).applyInPandas(all_of, f"{fields}, {NODES}")
