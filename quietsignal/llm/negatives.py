"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors are integers, and a row's score is its inner product with an anchor.  With M at least the norm of every
row, a row x is augmented to (x, sqrt(M^2 - |x|^2)) and an anchor a to (a, 0); then their squared distance is
|a|^2 + M^2 - 2 a.x, so higher scores are smaller distances, and a window of scores is an annulus around the anchor.

1. Rows are dealt to shards by their hashed ids.  A task reads the rows of a shard, builds its tree, and answers the
   anchors that follow in the same sorted partition, one Arrow batch at a time: it holds one shard, never all anchors.
2. A search visits nodes and rows nearest first, from a heap of bounds.  A node that lies inside the annulus' hole or
   beyond its rim, by the triangle inequality, is left out with all its rows.  A search ends at its k-th row.
3. The first pass finds each anchor's positives in every shard, and the best of all shards stay; the second pass
   looks for rows of other labels in the annulus of each positive.

All scores are whole numbers and exact; distances only order the visits, with bounds widened by more than their error.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietsignal.llm.common import partitions, released, table

#: Rows of a shard at most (about), and at least where there are fewer shards than shuffle partitions; rows of a leaf.
SHARD_ROWS, LEAST_ROWS, LEAF = 1 << 17, 1 << 12, 512
#: A gap in the distances from a vantage is wide from this share of their range on.
WIDE = 0.1
#: Anchors in an Arrow batch of answers.
ANSWERS = 4096


def usable(rows: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label (long) and vector (floor(256 x) of each component, as doubles) of the rows that take part."""
    x = F.col(vector)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    chosen = rows.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = lambda v: v.cast("double") * 256
    # From 2 ** 53 on a double has no fraction.
    return chosen.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.when(F.abs(scaled(v)) < float(1 << 53), F.floor(scaled(v)).cast("double")).otherwise(scaled(v))).alias("vector"))


def exact(x: np.ndarray, norm: float) -> np.ndarray:
    """``x`` in the smallest type in which sums of products up to ``norm`` are exact."""
    return x.astype(np.float32) if norm < 1 << 24 else x if norm < 1 << 53 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def parted(d: np.ndarray) -> int:
    """Where to cut sorted distances in two: at the widest gap if it is wide, so that clusters stay whole, else at the median."""
    gaps = np.diff(d[LEAF // 8 - 1 : len(d) - LEAF // 8 + 1])
    widest = int(gaps.argmax())
    return LEAF // 8 + widest if gaps[widest] > WIDE * (d[-1] - d[0]) else len(d) // 2


class Tree:
    """A vantage-point tree over rows (ids, labels, vectors in doubles without a fraction)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm: float):
        """``norm``: the largest squared norm of any row or anchor."""
        squares = (x * x).sum(1)
        self.radius = float(squares.max(initial=0.0))
        own = np.hstack([x, np.sqrt(np.maximum(self.radius - squares, 0))[:, None]])
        # Each node: its vantage (a row), or -1 for a leaf; its rows in ``order``; its children are numbered later.
        order, self.first, self.last, self.child, vantage = np.arange(len(x)), [0], [len(x)], [None], [-1]
        self.low, self.high, at = [0.0], [0.0], 0
        while at < len(self.first):
            a, b = self.first[at], self.last[at]
            rows = order[a:b]
            if b - a > LEAF:
                middle = own[rows].mean(0)
                v = rows[((own[rows] - middle) ** 2).sum(1).argmax()]
                d = np.sqrt(((own[rows] - own[v]) ** 2).sum(1))
                nearer = np.argsort(d, kind="stable")
                order[a:b], d = rows[nearer], d[nearer]
                half = parted(d)
                vantage[at], self.child[at] = v, len(self.first)
                for i, j in ((0, half), (half, b - a)):
                    self.first.append(a + i)
                    self.last.append(a + j)
                    self.low.append(float(d[i:j].min()))
                    self.high.append(float(d[i:j].max()))
                    self.child.append(None)
                    vantage.append(-1)
            at += 1
        self.ids, self.labels, self.x = ids[order], labels[order], exact(x[order], norm)
        inner = [i for i, v in enumerate(vantage) if v >= 0]
        self.views = exact(x[[vantage[i] for i in inner]].reshape(len(inner), x.shape[1]), norm)
        self.hung = np.array([self.child[i] for i in inner], int)
        self.low, self.high = np.array(self.low), np.array(self.high)


class Search:
    """The searches of one anchor in a tree; scores of a leaf are worked out once."""

    def __init__(self, tree: Tree, anchor: np.ndarray, norm: float):
        self.tree, self.known, self.visited = tree, {}, 0
        wide = max(tree.x.shape[1], len(anchor))
        if wide > tree.x.shape[1]:  # components that no row has
            anchor = anchor[: tree.x.shape[1]]
        self.anchor = exact(np.pad(anchor, (0, tree.x.shape[1] - len(anchor)))[None, :], norm)[0]
        square = float((anchor.astype(float) ** 2).sum()) + tree.radius
        to = np.sqrt(np.maximum(square - 2 * (tree.views @ self.anchor).astype(float), 0))
        least, most = np.zeros(len(tree.low)), np.full(len(tree.low), np.inf)
        for side in (0, 1):
            c = tree.hung + side
            least[c] = np.maximum(np.maximum(to - tree.high[c], tree.low[c] - to), 0)
            most[c] = to + tree.high[c]
        # Bounds of the scores below each node, a little wider than rounding can make them wrong.
        slack = 1 + 1e-9 * (square + norm)
        self.top = (square - least**2) / 2 + slack
        self.bottom = np.where(np.isinf(most), -np.inf, (square - most**2) / 2 - slack)

    def scores(self, leaf: int) -> np.ndarray:
        if leaf not in self.known:
            t = self.tree
            found = t.x[t.first[leaf] : t.last[leaf]] @ self.anchor
            self.known[leaf] = found if found.dtype == object else np.rint(found).astype(np.int64)
        return self.known[leaf]

    def nearest_first(self, low: float, high: float, label: int, same: bool, k: int, but: int | None = None) -> Iterator[tuple[int, int]]:
        """(score, id) of the first ``k`` rows whose score is in [low, high] and whose label is ``label`` (``same``) or not."""
        t, heap, left = self.tree, [(-np.inf, 0, 0)], k
        while heap and left:
            bound, is_row, at = heappop(heap)
            if is_row:
                left -= 1
                yield -bound, at
            elif t.child[at] is None:
                self.visited += 1
                s, part = self.scores(at), slice(t.first[at], t.last[at])
                fit = (s >= low) & (s <= high) & ((t.labels[part] == label) == same)
                if but is not None:
                    fit &= t.ids[part] != but
                if fit.sum() > left:
                    fit &= s >= np.sort(s[fit])[-left]
                for row in nsmallest(left, zip((-s[fit]).tolist(), t.ids[part][fit].tolist(), strict=True)):
                    heappush(heap, (row[0], 1, row[1]))
            else:
                for c in (t.child[at], t.child[at] + 1):
                    top = min(-bound, self.top[c])
                    if top >= low and self.bottom[c] <= high:
                        heappush(heap, (-top, 0, c))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled up with zeros, and their lengths."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    flat, n = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends).astype(int)
    wide = int(n.max(initial=0))
    if len(n) and n.min() == wide:
        return flat.reshape(len(n), wide), n
    out = np.zeros((len(n), wide))
    for i, size in enumerate(n):
        out[i, :size] = flat[ends[i] : ends[i + 1]]
    return out, n


OUT = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])


def answers(rows: DataFrame, asks: DataFrame, shards: int, norm: float, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, other_id, score: of each shard the first ``k`` rows for each question.

    ``asks`` (id, label, vector, positives: structs of score and id) asks for rows of other labels with a score of
    ``low`` to ``high`` hundredths of each positive's; null positives ask for the anchor's own positives.
    """
    kind = "array<struct<score:bigint,id:bigint>>"
    given = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "id", "label", "vector", F.lit(None).cast(kind).alias("positives"))
    asked = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "id", "label", "vector", F.col("positives").cast(kind).alias("positives"))

    def answer(tree: Tree, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        vectors, sizes = matrix(batch.column("vector"))
        for i, (name, label, positives) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("positives").to_pylist(), strict=True)):
            search, seen = Search(tree, vectors[i, : sizes[i]], norm), {}
            if positives is None:
                found += [(name, None, None, other, s) for s, other in search.nearest_first(-np.inf, np.inf, label, True, k, name)]
            for p in positives or ():
                s = p["score"]
                if s not in seen:  # the window in whole scores: low s <= 100 score <= high s
                    least, most = -(-low * s // 100), high * s // 100
                    seen[s] = list(search.nearest_first(least, most, label, False, k, name)) if least <= most else []
                found += [(name, p["id"], s, other, x) for x, other in seen[s]]
            if len(found) >= ANSWERS:
                yield written(found)
                found = []
        yield written(found)

    def written(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * len(OUT)
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=OUT)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard come first, by id; then its questions."""
        shard, held, tree = None, [], None
        for batch in batches:
            at = batch.column("shard").to_numpy() * 2 + batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if part.num_rows == 0:
                    continue
                if at[a] // 2 != shard:
                    shard, held, tree = at[a] // 2, [], None
                if at[a] % 2 == 0:
                    held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vector"))[0]))
                    continue
                if tree is None and held:
                    ids, labels = (np.concatenate([h[c] for h in held]) for c in (0, 1))
                    x = np.zeros((len(ids), max(h[2].shape[1] for h in held)))
                    n = 0
                    for _, _, own in held:
                        x[n : n + len(own), : own.shape[1]] = own
                        n += len(own)
                    fresh = np.append(True, np.diff(ids) != 0)  # of rows that share an id the first
                    tree, held = Tree(ids[fresh], labels[fresh], x[fresh], norm), []
                if tree is not None:
                    yield from answer(tree, part)

    dealt = given.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "ask", "id", "label", "vector")
    return dealt.mapInArrow(released(fold), "anchor_id long, positive_id long, positive_score long, other_id long, score long")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for rows (id, label, vector of ``usable``).

    Each row with ``anchors`` is an anchor.  Its positives are the first ``positives`` other rows of its label by score,
    ties by id; for each, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high``
    hundredths of the positive's are ranked from 1.  An anchor alone in its label has no positive, and a positive
    with nothing in its window no row: so has a negative score, whose window is empty.  Vectors of different lengths
    are filled up with zeros.  Of rows that share an id the one with the smallest label and vector takes part.
    Scores must fit 64 bits, or the job fails; up to there they are exact.  No rows give no rows.
    """
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))).first()
    norm, spark = float(norm or 0.0) + 1, rows.sparkSession
    shards = max(1, -(-n // SHARD_ROWS), min(partitions(spark), n // LEAST_ROWS))
    asks = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")
    best = answers(rows, asks.withColumn("positives", F.lit(None)), shards, norm, positives, low, high)
    # An anchor has at most ``positives`` answers from each shard.
    chosen = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id"))).where(F.col("rank") <= positives)
    gathered = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("score", F.col("other_id").alias("id"))).alias("positives"))
    found = answers(rows, asks.join(gathered, "id"), shards, norm, negatives, low, high)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "other_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP13_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s WHERE p.k <= 5)
SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5"""


def op13_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(table(spark, sf_dir, "embeddings").withColumn("label", label)), F.col("id") % 100 == 0)
