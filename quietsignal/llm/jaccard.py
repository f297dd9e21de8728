"""Jaccard join of word n-gram sets by T-occurrence search, and the groups of documents that it links.

Two sets link if of * intersection >= near * union, by a ``Rule`` of (words in a shingle, near, of): op9 takes three
words and 9 / 10, stages on word shingles five words and 4 / 5.  The join has three steps, each exact:

1. Documents with equal sets form a class; one of each class goes on.
2. Candidates.  Linked sets of a and b shingles differ in at most (a + b) * (of - near) / (of + near).  Sizes are put into classes, and
   for each pair of neighbouring classes the hash range is cut into more parts than its largest sets may
   differ in: linked sets then agree on a whole part.  That
   holds of any shingles left out on both sides too, so those frequent in a sample are left out of the parts.  Each set sends a signature of each part.  Sets that share
   one by chance grow faster than the table and would chain most of it into one group, so where few share it, their pairs
   are compared by sketches: a shingle flips one bit of its set's sketch, so sketches differ in no more bits than the sets
   in shingles, and no linked pair is lost.  Where many share one they are hung on the smallest of them, a star and not all
   pairs.  Connected components gather what is left.
3. T-occurrence search over the inverted lists of a gathered group (DivideSkip).  A set's lists are divided into
   L long ones and the short rest, L = T / (MU * log2(longest list) + 1) as published.  Short lists are merged
   by a heap that skips what cannot come T - L times; what is left is looked up in the long ones by binary
   search.  Candidates that are linked to the set already, through others, are skipped: the result is a
   forest with the same components as all links.
4. A group of more than ``BLOCK`` sets is cut into blocks.  Every block is searched together with the first one,
   which links a family of near copies in a linear number of searches.  Where a group does not become one
   component by that, sets outside its largest component are searched against all its blocks, so that no link is
   lost; no task holds more than two blocks of a group.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietsignal.llm.common import WordHash, apart, drop_dead_shuffles, mixed, partitions, release, released, shared_checkpoints, space_words, table
from quietsignal.llm.components import components


class Rule(NamedTuple):
    """Words in a shingle, and the least similarity as a fraction, near / of, of 2 / 3 or more."""

    n: int
    near: int
    of: int


#: What op9's contract asks for, and what binds every other stage on word shingles.
OP9, STAGE = Rule(3, 9, 10), Rule(5, 4, 5)
BLOCK = 400
#: The published method's weight of a heap step against a look-up, and sets that share a call.
MU, SETS = 0.0085, 2_000
#: Rows of ids and digests up to which they are broadcast, about 120 bytes each as the check tool measures; above, they are
#: joined, and of the texts only those that a filter of the ids lets through are shuffled.
BROADCAST_ROWS = 400_000
#: Sets in the sample (about; or one text in SHARE, if that is more), in how many of them a hash is frequent, and how many of the most frequent reach the driver.
SAMPLE, SHARE, OFTEN, MOST_FREQUENT = 5_000, 100, 4, 200_000
#: Sets that share a signature up to which all their pairs are compared by sketches.
FEW = 16


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, rule: Rule = OP9):
    """The smallest intersection with which sets of a and b elements link."""
    return -(-rule.near * (a + b) // (rule.near + rule.of))


def classes(size: int, rule: Rule = OP9) -> tuple[list[int], list[int]]:
    """First and last size of each class up to the one that holds ``size``, and one more."""
    low, high = [1], [rule.of // rule.near]
    while high[-1] < size or len(high) < 2 or high[-2] < size:
        low.append(high[-1] + 1)
        high.append(rule.of * low[-1] // rule.near)
    return low, high


class Sizes:
    """Number of parts by class, made longer as larger sets come."""

    def __init__(self, rule: Rule = OP9) -> None:
        self.rule = rule
        self.low, self.high = classes(1000, rule)

    def parts(self, size: int) -> list[tuple[int, int, int]]:
        """(class, parts, most differences) of the two searches that a set of ``size`` takes part in.

        Parts that are likely to be empty are made up for by further parts, so that a set seldom has no more
        filled parts than it may differ in.
        """
        _, near, of = self.rule
        if len(self.high) < 2 or self.high[-2] < size:
            self.low, self.high = classes(2 * size, self.rule)
        c = int(np.searchsorted(self.high, size))
        out = []
        for g in (c, c - 1):
            if g >= 0:
                most = (self.high[g] + self.high[g + 1]) * (of - near) // (near + of)
                more = int(3 * (most + 1) * math.exp(-self.low[g] / (most + 1)) + 0.9)
                out.append((g, most + 1 + more, most))
        return out


def shingle_hashes(words: np.ndarray, n: int = OP9.n) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, of the whole sequence."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(n))
        for j in range(n):
            h = mixed(h * np.uint64(0x100000001B3) ^ words[j : j + m])
    return np.unique(h)


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a, b = mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mixed(h ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(h: np.ndarray, sizes: Sizes, frequent: np.ndarray | None = None) -> np.ndarray:
    """Signatures of the parts of a set, of which the sorted ``frequent`` hashes are left out; of empty parts only if
    these might be all that it shares with another."""
    found = []
    own = len(h) * (sizes.rule.of - sizes.rule.near) // sizes.rule.near  # what a set may differ in from any that it links with
    searches = sizes.parts(len(h))
    if frequent is not None and len(frequent):
        h = h[frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] != h]
    for g, parts, most in searches:
        if g == 0 or sizes.low[g] == sizes.high[g] and sizes.high[g + 1] == sizes.high[g] + 1 and most == 0:
            continue  # such small sets link only if they are equal
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        with np.errstate(over="ignore"):
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            sums = np.add.reduceat(mixed(h ^ np.uint64(0x2545F4914F6CDD1D)), starts) if len(h) else h
            names = part[starts] + np.uint64(g << 40)
            found.append(mixed(sums ^ mixed(names)))
            if len(starts) <= min(most, own):
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts]) + np.uint64(g << 40)
                found.append(mixed(np.uint64(0x6C62272E07BB0142) ^ mixed(empty)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes by their low bits, in at least as many bits as hashes; 64 at least, a power of two."""
    bits = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In how many elements the sets of two sketches differ at least; the longer sketch is folded to the other's length."""
    x, y = sorted((np.frombuffer(s, np.uint64) for s in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


#: Columns that ``sets_of`` makes of a set, by what is asked for.
FIELDS = {"name": {"h1": "long", "h2": "long", "sketch": "binary"}, "hashes": {"hashes": "array<bigint>"}, "sigs": {"h1": "long", "h2": "long", "sigs": "array<bigint>"}, "set": {"set": "binary"}}


def sets_of(docs: DataFrame, what: str, rule: Rule = OP9, frequent: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_shingles, and the set's digest and sketch, hashes, digest and signatures, or the bytes of its hashes, with docs' further columns."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = FIELDS[what] | {c: docs.schema[c].dataType.simpleString() for c in more}
    schema = ", ".join(["doc_id long", "n_shingles long", *(f"{c} {k}" for c, k in kinds.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sizes = WordHash(), Sizes(rule)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole[at : at + 1000]
                sets = [shingle_hashes(hashed(space_words(t)), rule.n) for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), pa.array(map(len, sets), pa.int64())]
                if what in ("name", "sigs"):
                    names = [digest(h) for h in sets]
                    columns += [pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)]
                if what == "name":
                    columns.append(pa.array([sketch(h) for h in sets], pa.binary()))
                if what == "hashes":
                    columns.append(pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())))
                elif what == "sigs":
                    columns.append(pa.array([signatures(h, sizes, frequent).view(np.int64) for h in sets], pa.list_(pa.int64())))
                elif what == "set":
                    columns.append(pa.array([h.tobytes() for h in sets], pa.binary()))
                columns += [batch.column(2 + k) for k in range(len(more))]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", *kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(released(work), schema)


class Forest:
    def __init__(self, labels: np.ndarray):
        """Items of equal ``labels`` are linked from the start."""
        _, first, own = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[own]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are not linked to i yet."""
        up = self.up
        top = up[others]
        while (up[top] != top).any():
            top = up[top]
        up[others] = top
        return others[top != self.root(i)]


def merge_skip(lists: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """Numbers that are in ``least`` or more of the ascending lists, and in how many.

    A heap holds the head of each list.  When the smallest head is in too few lists, the ``least`` - 1 lists with
    the smallest heads skip to the next head of all the others: no smaller number can be in enough of them.
    """
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapify(heap)
    found, counts = [], []
    while len(heap) >= least:
        head = heap[0][0]
        out = []
        while heap and heap[0][0] == head:
            out.append(heappop(heap)[1])
        if len(out) >= least:
            found.append(head)
            counts.append(len(out))
            for i in out:
                at[i] += 1
        else:
            while heap and len(out) < least - 1:
                out.append(heappop(heap)[1])
            if not heap:
                break
            aim = heap[0][0]
            for i in out:
                at[i] = bisect_left(lists[i], aim, at[i])
        for i in out:
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return found, counts


def occurrence_search(sets: list[np.ndarray], side: np.ndarray | None = None, rule: Rule = OP9, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among ``sets`` that make up a forest with all links' components.  With ``side``, only across sides; sets
    of equal ``labels`` count as linked already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(tokens, kind="stable")  # so the owners in each list ascend
    codes = np.empty(len(tokens), np.int64)
    ranked = tokens[by]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    codes[by] = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(tokens))
    lists = owner[by]
    sides = None if side is None else side[order]
    first = np.concatenate([[0], np.cumsum(sizes)])
    forest = Forest(np.arange(len(order)) if labels is None else labels[order])
    for q in range(1, len(order)):
        s = int(sizes[q])
        least = -(-rule.near * s // rule.of)  # T: smaller sets than that cannot link with q, nor others with a smaller overlap
        floor = int(np.searchsorted(sizes, least))
        if floor >= q:
            continue
        if not len(forest.apart(q, np.arange(floor, q))):
            continue
        own = codes[first[q] : first[q + 1]]
        lengths = begin[own + 1] - begin[own]
        own = own[np.argsort(lengths, kind="stable")]
        long = min(least - 1, int(least / (MU * math.log2(max(2, lengths.max())) + 1)))
        short, rest = own[: s - long], own[s - long :]
        heads = [lists[begin[c] : begin[c + 1]] for c in short]
        found, counts = map(np.array, merge_skip([x[np.searchsorted(x, floor) : np.searchsorted(x, q)].tolist() for x in heads], least - long))
        if not len(found):
            continue
        if sides is not None:
            across = sides[found] != sides[q]
            found, counts = found[across], counts[across]
        keep = counts >= least_overlap(s, sizes[found], rule) - long
        found, counts = found[keep], counts[keep]
        best = np.argsort(-counts, kind="stable")
        found, counts = found[best], counts[best]
        known = np.zeros(len(order), np.int64)
        known[found] = counts
        width = 4
        while len(found := forest.apart(q, found)):
            some, found = found[:width], found[width:]
            total = known[some]
            need = least_overlap(s, sizes[some], rule)
            for k, c in enumerate(rest):
                part = lists[begin[c] : begin[c + 1]]
                at = np.searchsorted(part, some)
                total += part[np.minimum(at, len(part) - 1)] == some
                if k % 32 == 31:  # what cannot reach its T any more is dropped
                    alive = total + (len(rest) - k - 1) >= need
                    some, total, need = some[alive], total[alive], need[alive]
                    if not len(some):
                        break
            for c in some[total >= need].tolist():
                forest.link(q, c)
            width *= 2
    return [(order[i], order[j]) for i, j in forest.links]


def searched(dealt: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of the searches (key, search, node, side, label, set): across sides where ``side`` is set."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in rows.groupby("search"):
            nodes = part["node"].to_numpy()
            side = None if part["side"].isna().any() else part["side"].to_numpy()
            links = occurrence_search([np.frombuffer(x, np.uint64) for x in part["set"]], side, rule, part["label"].to_numpy())
            out += [(nodes[a], nodes[b]) for a, b in links]
        release()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.select("key", "search", "node", "side", "label", "set").groupBy("key").applyInPandas(work, "a long, b long")


def sets_in(docs: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """node, set and the columns of ``chosen`` (node, ...; checkpointed) for its nodes; texts are read again."""
    some, docs = chosen.withColumnRenamed("node", "doc_id"), docs.select("doc_id", "text")
    if chosen.count() <= BROADCAST_ROWS:
        own = docs.join(F.broadcast(some), "doc_id")
    else:
        own = apart(docs, chosen.select(F.col("node").alias("doc_id")))[1].join(some, "doc_id")
    found = sets_of(own, "set", rule)
    return found.where("n_shingles > 0").withColumnRenamed("doc_id", "node")


def verified(docs: DataFrame, clusters: DataFrame, rule: Rule = OP9) -> DataFrame:
    """Links (a, b) among the sets of each cluster (node, cluster, size; checkpointed): a forest with all links' components."""
    spark = docs.sparkSession
    total = clusters.count()
    # Small clusters share a task's call, about SETS of them; a large one has calls of its own.
    many = max(8 * partitions(spark), total // SETS)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    large = F.col("size") > BLOCK
    sets = sets_in(docs, clusters, rule).withColumn("own", own)
    # The first block goes to the search of every other one.
    place = F.explode(F.when(~large, F.array(F.lit(0))).when(F.col("own") == 0, F.sequence(F.lit(1), blocks - 1)).otherwise(F.array("own")))
    dealt = sets.withColumn("j", place).withColumn("search", F.when(large, F.xxhash64("cluster", "j")).otherwise(F.col("cluster")))
    key = F.when(large, F.col("search").bitwiseOR(F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(many)))
    links = searched(dealt.withColumn("key", key).withColumn("side", F.lit(None).cast("int")).withColumn("label", F.col("node")), rule).checkpoint()
    wide = clusters.where(large)
    if wide.isEmpty():
        return links
    # Large clusters that are not one component yet: the rest against all.
    labelled = wide.join(components(links), "node", "left").select("node", "cluster", "size", F.coalesce("component", "node").alias("label")).checkpoint()
    each = labelled.groupBy("cluster", "size", "label").agg(F.count("*").alias("n"))
    top = each.groupBy("cluster", "size").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n")).where("n < size").select("cluster", "top", (F.col("size") - F.col("n")).alias("minor")).checkpoint()
    if top.isEmpty():
        return links
    open_ = labelled.join(F.broadcast(top) if top.count() <= BROADCAST_ROWS else top, "cluster").checkpoint()
    few = F.ceil(F.col("minor") / BLOCK).cast("int")
    sets = sets_in(docs, open_, rule).withColumn("own", own)
    # side 0: a set outside the top component, which meets each block; side 1: any set, which meets each block of the former.
    asks = sets.where("label <> top").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), few).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
    answers = sets.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), few - 1))).withColumn("side", F.lit(1))
    both = asks.unionByName(answers, allowMissingColumns=True).withColumn("search", F.xxhash64("cluster", "i", "j"))
    return links.unionByName(searched(both.withColumn("key", F.col("search")), rule).checkpoint())


def frequent_hashes(docs: DataFrame, rule: Rule = OP9) -> np.ndarray:
    """Sorted hashes that are in OFTEN or more sets of a sample of the texts.  A guess will do: results don't depend on it."""
    share = min(SHARE, max(1, docs.count() // SAMPLE))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct().select(F.lit(0).alias("doc_id"), "text")
    counts = sets_of(some, "hashes", rule).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= OFTEN)
    rows = counts.orderBy(F.desc("k"), "h").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def signed(docs: DataFrame, one: DataFrame, filled: DataFrame, frequent: np.ndarray, rule: Rule) -> DataFrame:
    """node and sigs of each set of ``one`` (node, h1, h2, n_shingles; checkpointed), which stands for the rows ``filled``.

    Texts are read again, so the signatures, about as large as the texts, are never stored.  Of rows that share a doc_id,
    those send whose set the node stands for.
    """
    nodes = one.select(F.col("node").alias("doc_id"), F.col("h1").alias("own1"), F.col("h2").alias("own2"))
    if one.count() <= BROADCAST_ROWS:
        sure, asked = None, docs.join(F.broadcast(nodes), "doc_id")
    else:
        # Rows of ids that no copy has all stand for their sets; only the others ask.
        copies = filled.join(one.withColumnRenamed("node", "doc_id"), ["doc_id", "h1", "h2", "n_shingles"], "left_anti").select("doc_id").distinct().checkpoint()
        sure, asked = apart(docs, copies)
        asked = asked.join(nodes, "doc_id")
    found = sets_of(asked, "sigs", rule, frequent).where("h1 = own1 AND h2 = own2").select(F.col("doc_id").alias("node"), "n_shingles", "sigs")
    if sure is not None:
        found = found.unionByName(sets_of(sure, "sigs", rule, frequent).select(F.col("doc_id").alias("node"), "n_shingles", "sigs"))
    return found.where("n_shingles > 0 AND node IS NOT NULL").select("node", "sigs")


def candidates(sent: DataFrame) -> DataFrame:
    """a, b, sure: pairs of nodes that share a signature (``sent``: node, sigs).

    Of up to FEW nodes that share one these are all pairs, not sure; of more, a star that hangs them together, sure.
    """
    one_each = sent.select("node", F.explode("sigs").alias("sig"))
    order = Window.partitionBy("sig").orderBy("node")
    later = one_each.withColumn("u", F.min("node").over(order)).where("node > u")
    # The smallest is gone here, so a node's place tells how many are before it.
    before = F.array("u", *[F.lag("node", i).over(order) for i in range(1, FEW)])
    placed = later.withColumn("place", F.row_number().over(order)).withColumn("before", before)
    others = F.when(F.col("place") > FEW, F.array("u")).otherwise(F.array_compact("before"))
    pairs = placed.select(F.col("node").alias("a"), F.explode(others).alias("b"), (F.col("place") >= FEW).alias("sure"))
    return pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def alike(pairs: DataFrame, one: DataFrame, rule: Rule) -> DataFrame:
    """a, b of the ``pairs`` (a, b, sure) that are sure, or whose sketches in ``one`` (node, n_shingles, sketch) do not rule out a link."""
    side = lambda c: one.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
            na, nb = na.to_numpy(), nb.to_numpy()
            most = na + nb - 2 * least_overlap(na, nb, rule)
            keep = pa.array([least_difference(x.as_py(), y.as_py()) <= m for x, y, m in zip(sa, sb, most.tolist(), strict=True)], pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    asked = pairs.where("NOT sure").join(side("a"), "a").join(side("b"), "b")
    found = asked.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(released(work), "a long, b long")
    return pairs.where("sure").select("a", "b").unionByName(found)


def gathered(sent: DataFrame, one: DataFrame, rule: Rule) -> DataFrame:
    """node, cluster, size of the nodes that may link with others they share signatures with (checkpointed); ``sent``: node, sigs; ``one`` as in ``alike``."""
    clusters = components(alike(candidates(sent).checkpoint(), one, rule))
    return clusters.join(clusters.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", F.col("component").alias("cluster"), "size").checkpoint()


def groups(docs: DataFrame, rule: Rule = OP9) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts, and texts of white space, have an empty set and link with nothing, not even each
    other; so do rows with a null doc_id, whose component is null.  Rows of one doc_id are one document.  Very
    long texts are sets like others.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    docs = docs.select("doc_id", "text")
    named = sets_of(docs, "name", rule).checkpoint()
    filled = named.where("n_shingles > 0 AND doc_id IS NOT NULL")
    name = ["h1", "h2", "n_shingles"]
    one = filled.groupBy(name).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")).checkpoint()
    large = one.count() > BROADCAST_ROWS
    sized = gathered(signed(docs, one.drop("sketch"), filled.drop("sketch"), frequent_hashes(docs, rule), rule), one, rule)
    if large:
        drop_dead_shuffles(spark)  # those of the signatures
    links = verified(docs, sized, rule)
    if large:
        drop_dead_shuffles(spark)  # those of the sets
    linked = components(links)
    label = one.join(linked, "node", "left").select(*name, F.coalesce("component", "node").alias("label"))
    # Rows of one doc_id with different texts are one document: their labels meet in the smallest.
    rows = named.select("doc_id", *name).join(label, name, "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = OP9) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each linked group, all columns kept.

    Rows with a null doc_id and documents with an empty set stay.  Of rows that share a doc_id the one with the
    smallest text stays.
    """
    found = groups(docs, rule)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")).checkpoint()
    gone = ids.where("doc_id <> c").select(F.col("doc_id").alias("__gone"))
    few, again = gone.count() <= BROADCAST_ROWS, not ids.where("n > 1").isEmpty()
    stay = lambda rows: rows.join(F.broadcast(gone) if few else gone, rows["doc_id"].cast("long") == F.col("__gone"), "left_anti")
    if few and not again:
        return stay(docs)
    # Rows whose id neither goes nor comes again stay where they are.
    rest, some = apart(docs, ids.where("doc_id <> c OR n > 1").select("doc_id"))
    some = stay(some)
    if again:
        order = Window.partitionBy("doc_id").orderBy("text")
        some = some.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return rest.unionByName(some)


def op9_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), OP9)


#: All pairs that share a shingle, then reachability; for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id)
"""
