"""Benchmark decontamination with an FM-index for each shard of the documents.

Benchmark texts become windows of ``width`` consecutive words (a shorter text is one window).  A shard is a
slice of a task's documents; all its words are indexed, whether a window has them or not, each document ended by
a separator: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions
sampled.  All windows of one length are searched backward at once; occurrences are located by walking to the next
sampled position, and the words they cover are merged into spans to remove.

The benchmark is broadcast in blocks of a bounded number of characters, one at a time; each block is one pass.  What
several blocks find in a text is brought together by a 128-bit hash of the text, on which alone it depends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quietsignal.llm.arrays import let, running, upto
from quietsignal.llm.common import WORD_BYTES, alnum_words, released, slices, table

WIDTH = 10
#: Characters of benchmark text that one pass searches for.
BLOCK_CHARS = 4_000_000
SAMPLE_EVERY = 16
#: Characters of documents' text that are numbered and searched together.
SLICE_CHARS = 1_000_000
#: Words of a shard.
SHARD_WORDS = 1 << 20


#: Each bit of a word of 64, and all bits below it.
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BELOW = _BIT - np.uint64(1)


class WaveletMatrix:
    """Symbols below ``2 ** levels`` with rank and access for arrays of positions.

    A level holds its bits in words of 64, and how many ones stand before each word.
    """

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.words, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            words = np.zeros(len(bit) // 64 + 1, "<u8")
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(int(len(bit) - before[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position of a level."""
        word = at >> 6
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & _BELOW[at & 63])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        first = np.zeros_like(at)
        for k, zeros in enumerate(self.zeros):
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at, first = (np.where(bit, zeros + ones, x - ones) for x, ones in ((x, self._ones(k, x)) for x in (at, first)))
        return at - first

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol, first = np.zeros_like(at), np.zeros_like(at)
        for k, zeros in enumerate(self.zeros):
            bit = self.words[k][at >> 6] & _BIT[at & 63] != 0
            at, first = (np.where(bit, zeros + ones, x - ones) for x, ones in ((x, self._ones(k, x)) for x in (at, first)))
            symbol = symbol * 2 + bit
        return symbol, at - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (numbers below 2 ** 21, and so is their count) in order; each stretch ends with a 0, and
    zeros differ from each other, so no comparison reaches beyond one.

    Prefix doubling over sorted 64-bit keys: (rank, rank behind, place).  Only suffixes that still share their
    rank are sorted again.
    """
    n = len(text)
    gaps = text == 0
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    first = np.where(gaps, np.cumsum(gaps) - 1, np.count_nonzero(gaps) + text - 1).astype(np.uint64)
    after = np.append(first[1:], np.uint64(0))
    wide = np.uint64(max(1, int(first.max()).bit_length()) if n else 1)
    keys = (((first << wide) | after) << bits) | np.arange(n, dtype=np.uint64)
    del first, after, gaps
    keys.sort()
    order = (keys & low).astype(np.int64)
    slots, step = np.arange(n), 2
    rank = np.zeros(n, np.uint64)
    keys >>= bits
    while n:
        new = np.empty(len(keys), bool)
        new[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        at = slots[np.flatnonzero(new)]  # where each run of equal keys begins
        rank[order[slots]] = np.repeat(at, np.diff(np.append(np.flatnonzero(new), len(keys)))).astype(np.uint64)
        single = new.copy()
        single[:-1] &= new[1:]
        slots = slots[~single]
        if not len(slots):
            return order
        own = order[slots]
        keys = np.sort((((rank[own] << bits) | rank[own + step]) << bits) | np.arange(len(own), dtype=np.uint64))
        order[slots] = own[(keys & low).astype(np.int64)]
        keys >>= bits
        step *= 2
    return order


class FMIndex:
    """``text``: symbols from 1, each stretch ended by a separator 0.  Suffixes end at their separator."""

    def __init__(self, text: np.ndarray):
        suffixes = suffix_array(text)
        before = text[suffixes - 1]
        self.n = len(text)
        self.tree = WaveletMatrix(before.astype(np.int32), max(1, int(text.max()).bit_length()) if self.n else 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1))])  # rows that start with a smaller symbol
        self.sampled = (suffixes % SAMPLE_EVERY == 0) | (before == 0)
        self.place = np.where(self.sampled, suffixes, -1).astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each phrase (a row of symbols, 0: not in this text) and the place of each of its occurrences."""
        alive = np.flatnonzero((phrases > 0).all(axis=1) & (phrases < len(self.first) - 1).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low, high = (self.first[symbol] + self.tree.rank(symbol, x) for x in (low, high))
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        counts = high - low
        which = np.repeat(alive, counts)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(which)) if len(which) else np.zeros(0, np.int64)
        return which, self._locate(rows)

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            there = self.sampled[rows]
            out[open_[there]] = self.place[rows[there]] + steps
            open_, rows = open_[~there], rows[~there]
            symbol, rank = self.tree.access(rows)
            rows, steps = self.first[symbol] + rank, steps + 1
        return out


@dataclass
class Phrases:
    """One block of benchmark windows: word numbers, and by length the distinct windows and the items of each.

    A window's items stand in one array, from its place in another on; about 60 bytes a word of the block.
    """

    numbers: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    items: list = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple], width: int = WIDTH) -> Phrases:
        out, parts = cls(items=[item for item, _ in items]), {}
        for k, (_, text) in enumerate(items):
            ids = np.array([out.numbers.setdefault(w, len(out.numbers) + 1) for w in alnum_words(text)], np.int32)
            m = min(width, len(ids))
            if m:
                own = np.lib.stride_tricks.sliding_window_view(ids, m)
                parts.setdefault(m, []).append((own, np.full(len(own), k, np.int32)))
        for m in list(parts):
            wide, owner = (np.concatenate([x[c] for x in parts[m]]) for c in (0, 1))
            del parts[m]
            _, first, which = np.unique(np.ascontiguousarray(wide).view(np.dtype((np.void, 4 * m))).ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((owner, which))
            fresh = np.append(True, (np.diff(which[order]) != 0) | (np.diff(owner[order]) != 0))
            order = order[fresh]
            out.windows[m] = wide[first], np.append(0, np.cumsum(np.bincount(which[order], minlength=len(first)))), owner[order]
        return out

    def items_of(self, m: int, window: int) -> list:
        _, starts, owners = self.windows[m]
        return [x for x in (self.items[k] for k in owners[starts[window] : starts[window + 1]].tolist()) if x is not None]

    @staticmethod
    def numbered(text: str | None, known: dict[bytes, int]) -> list[int]:
        """Numbers of a text's words; those that are not known yet get further ones."""
        words = alnum_words(text)
        out = list(map(known.get, words))
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    out[i] = known.setdefault(words[i], len(known) + 1)
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """For each text: its number of words, merged spans of hit words (end exclusive), items found."""
        vocabulary = dict(self.numbers)  # and the texts' other words; no call leaves any behind
        split = [np.array(self.numbered(t, vocabulary), np.int32) for t in texts]
        symbols = len(vocabulary) + 1
        del vocabulary
        sizes = np.array([len(x) for x in split], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.zeros(starts[-1], np.int32)
        for x, at in zip(split, starts, strict=False):
            flat[at : at + len(x)] = x
        del split
        out = [(int(n), [], set()) for n in sizes]
        cover = np.zeros(len(flat) + 1, np.int32)
        longest = max(self.windows, default=1)
        for begin in range(0, len(flat) if self.windows else 0, SHARD_WORDS):
            shard = flat[begin : begin + SHARD_WORDS + longest]  # so no window is lost where a shard ends
            if shard[-1]:
                shard = np.append(shard, 0)
            present = np.zeros(symbols, bool)
            present[shard] = True
            present[0] = False
            dense = np.where(present, np.cumsum(present), 0)
            index = FMIndex(dense[shard])
            for m, (windows, _, _) in self.windows.items():
                which, at = index.search(dense[windows])
                at = at + begin
                np.add.at(cover, at, 1)
                np.add.at(cover, at + m, -1)
                docs = np.searchsorted(starts, at, side="right") - 1
                for doc, w in np.unique(np.stack([docs, which], 1), axis=0).tolist():
                    out[doc][2].update(self.items_of(m, w))
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8)]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            doc = int(np.searchsorted(starts, a, side="right") - 1)
            out[doc][1].append((int(a - starts[doc]), int(b - starts[doc])))
        return out


def sent(benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark's blocks as broadcast variables; the driver's Python holds one block at a time, and no windows."""
    context, out = benchmark.sparkSession.sparkContext, []
    for items in blocks(benchmark):
        out.append(context.broadcast(items))
        del items
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Benchmark rows in blocks of about ``limit`` characters, chosen by hashed text."""
    own = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = own.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-total // limit))
    for k in range(count):
        yield [(r[0], r[1]) for r in own.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()]


_WORD = re.compile(rb"[^ ]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans of words (see ``hits``) cut out; a line feed stands for each."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : words[a][0]])
        at = words[b - 1][1]
    return b"\n".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def found_in(docs: DataFrame, block: Broadcast, kind: str, width: int, names: tuple[str, str, str], cut: bool = False, sparse: bool = False) -> DataFrame:
    """``docs`` with the number of words, the merged spans of hit words, and the items of one block.

    With ``cut``, the spans are cut out of the text (and texts of which nothing is left go); with ``sparse``,
    rows without a hit are left out.  A task makes the windows of the block for itself, and frees them at its end.
    """
    more = ["bigint", "array<struct<start:bigint,end:bigint>>", f"array<{kind}>"]
    schema = docs.schema.names
    text, sizes = schema.index("text"), schema.index("n_chars") if "n_chars" in schema else None
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = pa.int64(), span, pa.list_(pa.string() if kind == "string" else pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for batch in batches:
            phrases = phrases or Phrases.of(block.value, width)
            for a, b in slices(pc.utf8_length(batch.column(text)).to_pylist(), SLICE_CHARS):
                columns = [c.slice(a, b - a) for c in batch.columns]
                texts = columns[text].to_pylist()
                found = phrases.search(texts)
                stay = [bool(f[1]) for f in found] if sparse else [True] * len(found)
                if cut:
                    own = [without(t, f[1]) if f[1] else t for t, f in zip(texts, found, strict=True)]
                    stay = [not f[1] or sum(y - x for x, y in f[1]) < f[0] for f in found]
                    columns[text] = pa.array(own, columns[text].type)
                    if sizes is not None:
                        columns[sizes] = pa.array([len(t) if f[1] else n for t, f, n in zip(own, found, columns[sizes].to_pylist(), strict=True)], columns[sizes].type)
                else:
                    values = [f[0] for f in found], [[{"start": x, "end": y} for x, y in f[1]] for f in found], [sorted(f[2]) for f in found]
                    columns += [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
                yield pa.record_batch(columns, schema if cut else [*schema, *names]).filter(pa.array(stay, pa.bool_()))

    if cut:
        return docs.mapInArrow(released(work), docs.schema)
    added = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(names, more, strict=True)))
    return docs.mapInArrow(released(work), StructType([*docs.schema.fields, *added.fields]))


def merged(spans: Column) -> Column:
    """Spans sorted by start, those that meet or overlap as one."""

    def of(before: Column) -> Column:  # the greatest end of the spans before each
        heads = F.filter(upto(F.size(spans)), lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(before, i)))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return let(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), F.coalesce(F.get(before, F.get(h, k + 1)), last).alias("end"))))

    return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), of)


def with_hits(docs: DataFrame, parts: list[Broadcast], kind: str, width: int, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with three more columns: number of words, merged spans of hit words in the text as it is, sorted items."""
    if len(parts) == 1:
        return found_in(docs, parts[0], kind, width, names)
    k1, k2 = (F.xxhash64(*seed, F.coalesce("text", F.lit(""))) for seed in ((), (F.lit(7),)))
    texts = docs.select("text", k1.alias("__k1"), k2.alias("__k2"))
    key = ["__k1", "__k2"]
    each = [found_in(texts, block, kind, width, ("__n", "__spans", "__items"), sparse=True).select(*key, "__spans", "__items") for block in parts[1:]]
    rest = reduce(DataFrame.unionByName, each).groupBy(key).agg(F.array_sort(F.flatten(F.collect_set("__spans"))).alias("__spans"), F.flatten(F.collect_set("__items")).alias("__items"))
    every = found_in(docs.withColumn("__k1", k1).withColumn("__k2", k2), parts[0], kind, width, names).join(rest, key, "left").drop(*key)
    both = F.when(F.col("__spans").isNull(), F.col(names[1])).otherwise(let(F.array_sort(F.concat(names[1], "__spans")), merged))
    all_items = F.when(F.col("__items").isNull(), F.col(names[2])).otherwise(F.array_sort(F.array_distinct(F.concat(names[2], "__items"))))
    return every.withColumn(names[1], both).withColumn(names[2], all_items).drop("__spans", "__items")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans (array of hit words' start and end, merged), items (sorted array) of every row.

    Null and empty texts have no words; items without words, or with a null text, have no window; a null item_id
    hits words but is not listed.  Items of equal id count once.  Rows stay as they are, repeated ones too.
    With an empty benchmark nothing is hit.  Other columns are not read.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sent(benchmark), kind, width, ("n_words", "spans", "items")).drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the benchmark's windows: hit words are cut out of ``text`` and ``n_chars`` follows.

    All windows are searched in the texts as they are, whatever number of blocks the benchmark has.  A document
    of which no word is left goes; one without any hit, or with a null or empty text, stays as it is.  Repeated
    rows stay; all columns stay.
    """
    parts, kind = sent(benchmark), benchmark.schema["item_id"].dataType.simpleString()
    if len(parts) == 1:
        return found_in(docs, parts[0], kind, width, ("", "", ""), cut=True)
    found = with_hits(docs, parts, kind, width, ("__n", "__hit", "__found")).drop("__found")
    schema = docs.schema
    text, sizes = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, words, hit = batch.columns
            spans = [[(s["start"], s["end"]) for s in x] for x in hit.to_pylist()]
            own = [without(t, x) if x else t for t, x in zip(columns[text].to_pylist(), spans, strict=True)]
            columns[text] = pa.array(own, columns[text].type)
            if sizes is not None:
                columns[sizes] = pa.array([len(t) if x else n for t, x, n in zip(own, spans, columns[sizes].to_pylist(), strict=True)], columns[sizes].type)
            stay = [not x or sum(b - a for a, b in x) < n for x, n in zip(spans, words.to_pylist(), strict=True)]
            yield pa.record_batch(columns, schema.names).filter(pa.array(stay, pa.bool_()))

    return found.mapInArrow(released(work), schema)


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
f AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, s)),
h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
