"""Nearest rows of the same key, as a metric join that leaves out what the triangle inequality rules out.

1. Equal vectors of a key become one, with the ``k`` + 1 smallest of their ids; so a large group of copies costs no more than one row.
2. Some rows of a large key are its pivots, and each row goes to its nearest pivot.  A pivot's rows form a block (or
   several, if they are many), of which its row count and its least and largest distance to the pivot are known.
3. Every block is searched by its own rows; the distance of a row's last neighbour so far bounds what it still looks for.
4. A row is then sent only to blocks that can hold something as near: those whose range of distances to their pivot
   meets the row's own distance to it, give or take the bound.
5. The best of all answers stay, and rows that share a vector take them over.

Vectors never leave a key's tasks whole: a task holds one block, or the pivots of a key, and rows pass it in batches.
They are sent as packed bytes, floats as floats, and what is found at home (3) and at last (5) is checkpointed, as later steps read it repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from quietsignal.operators import models

#: Rows of a block (about), and pivots of a key at most; a key with more rows than both allow has several blocks a pivot.
BLOCK, MOST_PIVOTS = 16_384, 1024
#: Rows that a step works on, and gives, at once; a row may go to many blocks, and copies of its vector with it.
STEP = 2048
#: Numbers in an array of a search at most (about), and rows of a block that bound what its others can be among.
ROOM, SAMPLE = 1 << 21, 1024
#: Visits of rows to blocks that are worked out at once, at most (unless one row has more).
VISITS = 1 << 18
#: Rounding may make a bound wrong by this share; bounds are wider by it.
SLACK = 1e-9


def matrix(v: pd.Series, kind: str) -> np.ndarray:
    """Vectors, packed as ``kind`` or as arrays, as rows of doubles."""
    if not isinstance(v.iloc[0], bytes):
        return np.stack(v.to_numpy()).astype(float)
    width = len(v.iloc[0]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(v), kind).reshape(len(v), width).astype(float) if width else np.zeros((len(v), 0))


def places(row: np.ndarray) -> np.ndarray:
    """The place of each element among the equal ones of a sorted array, from 0."""
    return np.arange(len(row)) - np.searchsorted(row, row)


class Held:
    """Vectors to search among, ``sizes`` ids for each, and these in ``ids`` one after another."""

    def __init__(self, x: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.x, self.sizes, self.starts, self.ids = x, sizes, np.cumsum(sizes) - sizes, ids
        squares = (x * x).sum(1)
        self.most, self.wide = squares.max(initial=0), np.column_stack([-2 * x, squares, np.ones(len(x))]).T.copy()
        self.rank = np.empty(len(ids), int)
        self.rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))

    @classmethod
    def of(cls, part: pd.DataFrame, kind: str) -> Held:
        return cls(matrix(part["v"], kind), part["ids"].map(len).to_numpy(int), np.concatenate(list(part["ids"])))


class Metric:
    """Euclidean distances, or their whole multiples of 1 / ``scale``, and the nearest of a block."""

    def __init__(self, k: int, scale: int | None):
        self.k, self.scale = k, scale

    def reach(self, last: np.ndarray) -> np.ndarray:
        """The distance from which on nothing can come before a neighbour at ``last``."""
        return (last + 1) / self.scale if self.scale else last

    def nearest(self, asks: np.ndarray, held: Held, count: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``asks``, distance and id of its first ``count`` ids, by distance and id, that are no farther than its ``reach``.

        One product of matrices picks the vectors that may be among them, with room for its rounding: those within ``reach``
        and the ``count``-th distance to every so many-th of them.  Distances are then worked out from differences.
        """
        found = []
        step, every = max(16, ROOM // len(held.x)), max(1, len(held.x) // max(SAMPLE, 16 * count))
        for at in range(0, len(asks), step):
            part = asks[at : at + step]
            bound = np.full(len(part), np.inf) if reach is None else reach[at : at + step] * (1 + SLACK)
            own = (part * part).sum(1)
            d = np.column_stack([part, np.ones(len(part)), own]) @ held.wide
            room, limit, some = 1e-9 * (own + held.most), bound, d[:, ::every]
            if count <= some.shape[1]:
                last = np.sqrt(np.maximum(np.partition(some, count - 1, axis=1)[:, count - 1], 0) + room)
                limit = np.minimum(bound, (np.floor(last * self.scale) + 1) / self.scale if self.scale else last)
            near = d <= (limit * limit + room)[:, None]
            upto = np.cumsum(near.sum(1)) // max(1, ROOM // max(1, part.shape[1]))
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                row, x = np.nonzero(near[a:b])
                found.append(self.first(part[a:b], row, x, held, count, bound[a:b]))
                found[-1][0][:] += at + a
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def first(self, asks: np.ndarray, row: np.ndarray, at: np.ndarray, held: Held, count: int, bound: np.ndarray) -> list[np.ndarray]:
        """The first ``count`` ids of each row among candidates, by rows."""
        dist = np.sqrt(((held.x[at] - asks[row]) ** 2).sum(1))
        keep = dist <= bound[row]
        row, at, dist = row[keep], at[keep], np.floor(dist[keep] * self.scale).astype(int) if self.scale else dist[keep]
        order = np.lexsort((dist, row))
        row, at, dist = row[order], at[order], dist[order]
        last, nth = np.full(len(asks), np.inf), places(row) == count - 1
        last[row[nth]] = dist[nth]
        keep = dist <= last[row]
        row, at, dist = row[keep], at[keep], dist[keep]
        times = held.sizes[at]
        row, dist, name = np.repeat(row, times), np.repeat(dist, times), np.repeat(held.starts[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        order = np.lexsort((held.rank[name], dist, row))
        order = order[places(row) < count]
        return [row[order], dist[order], held.ids[name[order]]]


def by_row(found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """How many each of ``n`` rows found, and their distances and ids."""
    ends = np.searchsorted(found[0], np.arange(n + 1))
    cuts = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
    return np.diff(ends), [found[1][a:b] for a, b in cuts], [found[2][a:b] for a, b in cuts]


def fields_of(df: DataFrame, keys: list[str], id_: str, scale: int | None) -> tuple[list[str], list[StructField], DataType, DataType]:
    own = [f"k{i}" for i in range(len(keys))]
    kinds = [StructField(o, df.schema[k].dataType) for o, k in zip(own, keys, strict=True)]
    return [*own, "size"], [*kinds, StructField("size", IntegerType())], df.schema[id_].dataType, LongType() if scale else DoubleType()


def usable(df: DataFrame, keys: list[str], id_: str, vector: str) -> DataFrame:
    """Keys as k0, k1, ..., the vector's size, id and the vector (floats, or else doubles), of rows with whole vectors."""
    kind = "float" if df.schema[vector].dataType.elementType == FloatType() else "double"
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast(kind))
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.size(x).cast("int").alias("size"), F.col(f"`{id_}`").alias("id"), x.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda y: y.isNotNull() & (F.abs(y) < float("inf"))))


def small_keys(rows: DataFrame, own: list[str], kinds: list[StructField], id_type: DataType, dist: DataType, metric: Metric) -> DataFrame:
    """Keys of one block each: a search within the key."""
    fields = [*kinds, StructField("source", id_type), StructField("target", id_type), StructField("dist", dist), StructField("rank", IntegerType())]

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, ids = matrix(part["v"], ""), part["id"].to_numpy()
        row, d, target = metric.nearest(x, Held(x, np.ones(len(ids), int), ids), metric.k + 1 + len(ids) - len(set(ids)))
        other = target != ids[row]
        row, d, target = row[other], d[other], target[other]
        rank = places(row) + 1
        keep = rank <= metric.k
        found = {"source": ids[row[keep]], "target": target[keep], "dist": d[keep], "rank": rank[keep]}
        found |= {o: np.full(len(found["rank"]), part[o].iloc[0], object) for o in own}
        return pd.DataFrame({c: pd.Series(x, dtype=x.dtype) for c, x in found.items()})

    return models.spread(rows, own).groupBy(*own).applyInPandas(search, StructType(fields))


class Join:
    """The steps of the join for keys of any size, as tables."""

    def __init__(self, rows: DataFrame, keys: list[str], id_type: DataType, dist: DataType, metric: Metric, block: int):
        # Two hashes stand for the keys until the end: pandas would turn whole numbers among nulls into floats.
        named = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
        rows = rows.withColumn("g1", F.xxhash64(*named)).withColumn("g2", F.xxhash64(F.lit(7), *named))
        own, kinds = ["g1", "g2"], [StructField("g1", LongType()), StructField("g2", LongType())]
        self.own, self.metric, self.block = own, metric, block
        self.kind = "f4" if rows.schema["v"].dataType.elementType == FloatType() else "f8"
        one, vector = [StructField("h1", LongType()), StructField("h2", LongType())], StructField("v", BinaryType())
        ids, near = StructField("ids", ArrayType(id_type)), [StructField("dist", ArrayType(dist)), StructField("id", ArrayType(id_type))]
        hashed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
        self.vector = [*own, "h1", "h2"]
        count = metric.k + 1
        first = hashed.withColumn("place", F.row_number().over(Window.partitionBy(*self.vector).orderBy("id"))).where(F.col("place") <= count)
        distinct = first.groupBy(*self.vector).agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
        sizes = rows.groupBy(*own).agg(F.count("*").alias("n"))
        # Tasks with the pivots of a large key take a share of its rows each.
        shares = F.ceil(F.col("n") / (4 * block)).cast("int")
        sized = models.attach(distinct, sizes.select(*own, "n", shares.alias("shares")), own).withColumn("share", F.pmod("h1", F.col("shares")).cast("int"))
        wanted = F.least(F.ceil(F.col("n") / block), F.lit(MOST_PIVOTS))
        by_hash = Window.partitionBy(*own).orderBy("h2", "h1")
        pivots = sized.withColumn("pivot", F.row_number().over(by_hash)).where(F.col("pivot") <= MOST_PIVOTS).where(F.col("pivot") <= wanted).select(*own, "pivot", "v", "shares")
        self.pivots = pivots
        self.cells = self.assigned(sized, [*kinds, *one, vector, ids, StructField("share", IntegerType()), StructField("pivot", IntegerType()), StructField("d", DoubleType())])
        counts = self.cells.groupBy(*own, "pivot").agg(F.count("*").alias("rows"), F.min("d").alias("low"), F.max("d").alias("high"))
        self.blocks = counts.withColumn("parts", F.ceil(F.col("rows") / (2 * block)).cast("int"))
        self.placed = models.attach(self.cells, self.blocks.select(*own, "pivot", "parts"), [*own, "pivot"]).withColumn("part", F.pmod("h2", F.col("parts")).cast("int"))
        at = [StructField("pivot", IntegerType()), StructField("part", IntegerType()), StructField("reach", DoubleType())]
        self.home = models.checkpointed(self.searched_at_home([*kinds, *one, vector, ids, StructField("share", IntegerType()), *at, *near]))
        self.visits = self.sent([*kinds, *one, vector, *at])
        self.answers = self.answered([*kinds, *one, *near])
        every = self.home.select(*self.vector, F.arrays_zip("dist", "id").alias("near")).unionByName(self.answers.select(*self.vector, F.arrays_zip("dist", "id").alias("near")))
        best = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, count)
        merged = models.checkpointed(every.groupBy(*self.vector).agg(best.alias("near")))
        members = models.attach(hashed.select(*keys, *self.vector, "id"), merged, self.vector)
        others = F.slice(F.filter("near", lambda p: p["id"] != F.col("id")), 1, metric.k)
        each = members.select(*keys, F.col("id").alias("source"), F.posexplode(others).alias("rank", "p"))
        self.found = each.select(*keys, "source", F.col("p.id").alias("target"), F.col("p.dist").alias("dist"), (F.col("rank") + 1).cast("int").alias("rank"))

    def assigned(self, sized: DataFrame, fields: list[StructField]) -> DataFrame:
        """Rows with their nearest pivot and the distance to it."""
        wide = {"h1": 0, "h2": 0, "ids": None}
        leading = self.pivots.select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"))
        following = sized.select(*self.own, "share", "v", "h1", "h2", "ids", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("pivot"))
        both = leading.select(*self.own, "share", "kind", "pivot", "v", *[F.lit(x).cast(sized.schema[c].dataType).alias(c) for c, x in wide.items()]).unionByName(following)
        names, kind = [f.name for f in fields], self.kind

        def answer(held: pd.DataFrame, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            held = held.sort_values("pivot")
            p, x = matrix(held["v"], kind), matrix(frame["v"], kind)
            d = np.stack([np.sqrt(((x - a) ** 2).sum(1)) for a in p], 1)
            best = d.argmin(1)
            packed = [v.tobytes() for v in x.astype(kind)]
            yield frame.assign(v=packed, pivot=held["pivot"].to_numpy(int)[best], d=d[np.arange(len(x)), best])[names]

        return self.streamed(both, [*self.own, "share"], answer, fields)

    def searched_at_home(self, fields: list[StructField]) -> DataFrame:
        """The nearest of a row's own block, and how far it still looks."""
        names, count, metric, kind = [f.name for f in fields], self.metric.k + 1, self.metric, self.kind

        def search(part: pd.DataFrame) -> pd.DataFrame:
            held = Held.of(part, kind)
            n, dist, ids = by_row(metric.nearest(held.x, held, count), len(part))
            reach = np.array([metric.reach(d[-1]) if m == count else np.inf for m, d in zip(n, dist, strict=True)])
            return part.assign(dist=dist, id=ids, reach=reach)[names]

        return models.spread(self.placed, [*self.own, "pivot", "part"]).groupBy(*self.own, "pivot", "part").applyInPandas(search, StructType(fields))

    def sent(self, fields: list[StructField]) -> DataFrame:
        """Rows with each other block that can hold something as near as they still look for."""
        kind = self.kind

        @F.pandas_udf("binary")
        def pack(v: pd.Series) -> pd.Series:
            return v.map(lambda x: np.asarray(x, kind).tobytes())

        leading = models.attach(self.pivots.withColumn("v", pack("v")), self.blocks, [*self.own, "pivot"]).select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind")).drop("shares")
        following = self.home.select(*self.own, "share", "v", "h1", "h2", "pivot", "part", "reach", F.lit(1).alias("kind"))
        zero = F.lit(0).cast("long")
        both = leading.withColumns({"h1": zero, "h2": zero, "part": F.lit(0)}).unionByName(following, allowMissingColumns=True)
        names = [f.name for f in fields]

        def answer(held: pd.DataFrame, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            held = held[held["rows"].notna()]
            p = matrix(held["v"], kind)
            low, high, number, parts = (held[c].to_numpy(float) for c in ("low", "high", "pivot", "parts"))
            # The more blocks a key has, the fewer rows at once: each may have to go to all of them.
            step = max(1, VISITS // max(1, int(parts.sum())))
            for at in range(0, len(frame), step):
                yield from visits(frame.iloc[at : at + step], p, low, high, number.astype(int), parts.astype(int))

        def visits(frame: pd.DataFrame, p: np.ndarray, low: np.ndarray, high: np.ndarray, number: np.ndarray, parts: np.ndarray) -> Iterator[pd.DataFrame]:
            x = matrix(frame["v"], kind)
            d = np.stack([np.sqrt(((x - a) ** 2).sum(1)) for a in p], 1)
            least = np.maximum(np.maximum(d - high, low - d), 0) - SLACK * (d + high)
            row, at = np.nonzero(least <= frame["reach"].to_numpy()[:, None])
            own, mine, times = frame["pivot"].to_numpy(int), frame["part"].to_numpy(int), parts[at]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at = np.repeat(row, times), np.repeat(at, times)
            other = (number[at] != own[row]) | (part != mine[row])
            row, pivot, part = row[other], number[at[other]], part[other]
            for a in range(0, len(row), STEP):
                some = slice(a, a + STEP)
                yield frame.iloc[row[some]].assign(pivot=pivot[some], part=part[some])[names]

        return self.streamed(both, [*self.own, "share"], answer, fields)

    def answered(self, fields: list[StructField]) -> DataFrame:
        """What each visited block has for its visitors."""
        leading = self.home.select(*self.own, "pivot", "part", "v", "ids", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
        both = leading.unionByName(self.visits.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        names, count, metric, kind = [f.name for f in fields], self.metric.k + 1, self.metric, self.kind
        last: list = [None, None]

        def answer(held: pd.DataFrame, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if last[0] is not held:
                last[:] = [held, Held.of(held, kind)]
            n, dist, ids = by_row(metric.nearest(matrix(frame["v"], kind), last[1], count, frame["reach"].to_numpy()), len(frame))
            yield frame.assign(dist=dist, id=ids)[names][n > 0]

        return self.streamed(both, [*self.own, "pivot", "part"], answer, fields)

    @staticmethod
    def streamed(both: DataFrame, group: list[str], answer, fields: list[StructField]) -> DataFrame:
        """Rows of kind 1 through ``answer``, STEP by STEP, with all rows of kind 0 of their group, which come first."""
        fresh = Window.partitionBy(*group).orderBy("kind")
        placed = models.spread(both, group).withColumn("__place", F.row_number().over(fresh))

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for frame in frames:
                cuts = sorted({0, *np.flatnonzero(frame["__place"].to_numpy() == 1).tolist(), len(frame)})
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = frame.iloc[a:b]
                    if part["__place"].iloc[0] == 1:
                        held = []
                    leads = (part["kind"] == 0).to_numpy()
                    if leads.any():
                        held.append(part[leads])
                    if not leads.all():
                        held = held if len(held) == 1 else [pd.concat(held)]
                        rest = part[~leads]
                        for c in range(0, len(rest), STEP):
                            yield from answer(held[0], rest.iloc[c : c + STEP])

        return placed.mapInPandas(work, StructType(fields))


def nearest(df: DataFrame, keys: list[str], id_: str, vector: str, k: int, block: int = BLOCK, scale: int | None = None) -> DataFrame:
    """keys, source, target, dist, rank of the ``k`` nearest rows of the same key; ties by target.

    With ``scale``, distances are whole multiples of 1 / scale (rounded down), and tie as such.  Rows with a null id, a null
    vector, or one with a null or not finite component have no neighbours and are none; vectors of another length
    neither.  Null keys are a key.  Ids are taken to be unique in a key; rows that share one are not neighbours.
    """
    own, kinds, id_type, dist = fields_of(df, keys, id_, scale)
    rows, metric = usable(df, keys, id_, vector), Metric(k, scale)
    largest = rows.groupBy(*own).count().agg(F.max("count")).first()[0] or 0
    found = small_keys(rows, own, kinds, id_type, dist, metric) if largest <= block else Join(rows, own, id_type, dist, metric, block).found
    return found.select(*[F.col(o).alias(name) for o, name in zip(own, keys, strict=False)], "source", "target", "dist", "rank")
