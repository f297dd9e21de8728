"""A bigram language model with Katz backoff, learned from and applied to whole tables.

Tokens are words between ASCII white space, A-Z lower-cased, and one end token for each text; the first token's
context is the start.  For a context h seen c(h) times and a token w seen r times after it,

    P(w | h) = d(r) r / c(h)            if r > 0
               alpha(h) P(w)            otherwise,  alpha(h) = (1 - sum of P(seen | h)) / (1 - sum of P(seen)),

and P(w) = d1(c) c / N for a token seen c times; what is left of 1 is the one unknown token's.  d and d1 are
Good-Turing discounts for counts up to K (absolute ones where Good-Turing gives none); counts above K keep all
but EPSILON, so that every context leaves something to unseen tokens and alpha normalises exactly.

Words and contexts are known by 64-bit hashes: of 10 ** 10 different words about three pairs are expected to merge
their counts.  The tables are partitioned by hashed token and then by hashed context, and rows are blobs of packed arrays: a
map task sends each partition the distinct pairs of its documents with the documents they are in.  The steps:

1. unigram counts (packed by partition): N, V, counts of counts, and the words so frequent that they need salt;
2. by token: counts of all pairs; sums for each document; by context, what alpha needs; pairs that were not seen;
3. by context: alpha, applied to the pairs not seen;
4. by slice of documents: the sums meet.

Words that make up more than 1 / (4 * partitions) of all tokens, at most 4 * partitions of them, are dealt by
their contexts instead, and as contexts by slices of documents; their counts come from step 1.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quietsignal.llm.common import WordHash, crc_of_id, drop_dead_shuffles, mixed, partitions, release, released, shared_checkpoints, space_words, table

K, EPSILON = 5, 1e-4
#: Tokens that a map task holds before it sends their pairs.
SLICE_TOKENS = 1_000_000
#: Entries (a pair in a document) and documents that a reduce task expands together; a slice with more is expanded as a whole.
CHUNK_ENTRIES = 250_000
#: Characters of text for each partition of the tables, about what one task holds as arrays.
BUCKET_CHARS = 24_000_000
FIXED = 1e9
END, START = np.uint64(0xE17A1465E17A1465), np.uint64(0x57A2757A2757A275)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of equal weight stand together."""
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return bytes(memoryview(zstandard.ZstdCompressor(level=1).compress(head + body)))  # what compress() returns holds a buffer for the whole input


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = raw[0], 1 + 10 * raw[0]
    out = []
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        dtype = np.dtype("<" + kind.decode())
        end = at + size * dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw[at:end], np.uint8).reshape(dtype.itemsize, size).T).reshape(-1).view(dtype))
        at = end
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets ascend with the hash, so sorted hashes fall into slices."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each run of a sorted array."""
    if len(bucket):
        starts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(starts, starts[1:], strict=False):
            yield int(bucket[a]), a, b


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in arrays sorted together."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def spread(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ np.uint64(0xA0761D6478BD642F))


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0), ..., d(K + 1) from the numbers of things seen 1, ..., K + 1 times; d(K + 1) is for all higher counts."""
    n = np.concatenate([[0.0], counts.astype(float)])
    out = np.full(K + 2, 1 - EPSILON)
    out[0] = 0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    share = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - absolute) / r
    return out


class Unigrams:
    """Totals of step 1.  ``hot``: sorted hashes of frequent words, with their counts."""

    def __init__(self, n: int, v: int, counts: np.ndarray, texts: int, hot: list[tuple[int, int]]):
        self.n, self.v, self.texts, self.d = n, v, texts, discounts(counts)
        hot = sorted((np.uint64(h % (1 << 64)), c) for h, c in hot)
        self.hot, self.hot_counts = np.array([h for h, _ in hot], np.uint64), np.array([c for _, c in hot], np.int64)
        low = np.arange(1, K + 1)
        seen = (self.d[1 : K + 1] * low * counts[:K]).sum() + (n - (low * counts[:K]).sum()) * self.d[K + 1]
        self.unknown = max((n - seen) / n, 1e-300) if n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / max(1, self.n), self.unknown)

    def of_hot(self, h: np.ndarray) -> np.ndarray:
        """Place in the list of frequent words, or -1."""
        if not len(self.hot):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)


def token_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_TOKENS) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """Documents until ``limit`` tokens are together: ids, whether they train, hashes of the tokens of each."""
    hashed = WordHash(200_000)
    ids, train, tokens, size = [], [], [], 0
    for batch in batches:
        for doc, use, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids.append(doc)
            train.append(use)
            tokens.append(np.append(hashed(space_words(text.as_py())), END))
            size += len(tokens[-1])
            if size >= limit:
                yield ids, np.array(train, np.uint8), tokens
                ids, train, tokens, size = [], [], [], 0
    if ids:
        yield ids, np.array(train, np.uint8), tokens


def unigrams(rows: DataFrame, buckets: int) -> Unigrams:
    """Step 1, over ``rows`` (doc_id, train, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, tokens in token_slices(batches, 2 * SLICE_TOKENS):
            own = [t for t, use in zip(tokens, train, strict=True) if use]
            if own:
                w, c = np.unique(spread(np.concatenate(own)), return_counts=True)
                parts = list(pieces(bucket_of(w, buckets)))
                yield pa.record_batch([pa.array([p[0] for p in parts], pa.int64()), pa.array([pack(w[a:b], c[a:b].astype(np.uint32)) for _, a, b in parts], pa.binary())], ["bucket", "blob"])

    end = int(spread(np.array([END]))[0])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(b) for b in frame["blob"]]
        w, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
        order = np.argsort(w, kind="stable")
        at = runs(w[order])
        c, w = np.add.reduceat(c[order], at), w[order][at]
        many = np.flatnonzero(c * 4 * buckets > c.sum())  # none else can have that share of all tokens
        texts = int(c[w == np.uint64(end)].sum())
        return pd.DataFrame({"n": [int(c.sum())], "v": [len(c)], "texts": [texts], "counts": [np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].astype(np.int64)], "words": [w[many].view(np.int64)], "many": [c[many]]})

    found = rows.mapInArrow(released(count), "bucket long, blob binary").groupBy("bucket").applyInPandas(freed(total), "n long, v long, texts long, counts array<bigint>, words array<bigint>, many array<bigint>").persist(StorageLevel.DISK_ONLY)
    sums = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0)), *[F.coalesce(F.sum(F.get("counts", F.lit(k))), F.lit(0)) for k in range(K + 1)]).first()
    each = found.select(F.explode(F.filter(F.arrays_zip("words", "many"), lambda x: x["many"] * 4 * buckets > sums[0])).alias("x"))
    hot = [(r[0], r[1]) for r in each.select("x.words", "x.many").collect()]  # under 4 * buckets words have so large a share
    found.unpersist()
    return Unigrams(sums[0], sums[1], np.array(sums[3:], np.int64), sums[2], hot)


PARTS = "kind string, key long, blob binary, numbers array<bigint>, mass double"


def sent(rows: DataFrame, known: Unigrams, buckets: int) -> DataFrame:
    """Map side of step 2: (bucket, slice, kind, blob)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for number, (ids, train, tokens) in enumerate(token_slices(batches)):
            sizes = np.array([len(t) for t in tokens])
            flat = np.concatenate(tokens)
            before = np.empty_like(flat)
            before[1:] = flat[:-1]
            before[np.cumsum(sizes) - sizes] = START
            w, h = spread(flat), spread(before)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            hot = known.of_hot(w) >= 0
            out = [(int((base + number) % buckets), "ids", pack(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), train))]
            for own in (~hot, hot):
                x, y, z = w[own], h[own], doc[own]
                at = bucket_of(x, buckets) if own is not hot else bucket_of(y, buckets)
                order = np.lexsort((y, x, at)) if own is hot else np.lexsort((y, x))  # stable: documents ascend
                x, y, z, at = x[order], y[order], z[order], at[order]
                entry = runs(at, x, y, z)
                times = np.diff(np.append(entry, len(x))).astype(np.uint32)
                x, y, z, at = x[entry], y[entry], z[entry], at[entry]
                for bucket, a, b in pieces(at):
                    p = runs(x[a:b], y[a:b])
                    q = runs(x[a:b][p])
                    contexts, code = np.unique(y[a:b][p], return_inverse=True)
                    blob = pack(
                        x[a:b][p][q], np.diff(np.append(q, len(p))).astype(np.uint32), contexts, code.astype(np.uint16 if len(contexts) < 1 << 16 else np.uint32),
                        np.diff(np.append(p, b - a)).astype(np.uint32), z[a:b], times[a:b], train,
                    )
                    out.append((bucket, "pairs", blob))
            kinds = [pa.array([o[0] for o in out], pa.int64()), pa.array([base + number] * len(out), pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.binary())]
            yield pa.record_batch(kinds, ["bucket", "slice", "kind", "blob"])

    return rows.mapInArrow(released(work), "bucket long, slice long, kind string, blob binary")


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one, which are let go."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def together(sizes: list[tuple[int, int]], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of (slice, size), sorted by slice: whole slices of at most ``limit`` together; a larger slice is a range of its own."""
    first = last = size = own = 0  # own: size of the slice that began at ``last``
    for i, (name, n) in enumerate(sizes):
        if i and name != sizes[i - 1][0]:
            last, own = i, 0
        size, own = size + n, own + n
        if size > limit and last > first:
            yield first, last
            first, size = last, own
    if first < len(sizes):
        yield first, len(sizes)


def freed(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``work`` on a group, after which memory is given back; by then all that it held is freed."""

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        out = work(frame)
        release()
        return out

    return whole


def by_token(known: Unigrams, buckets: int, limit: int = CHUNK_ENTRIES):
    """Reduce side of step 2.  The pairs are counted as a whole, their entries expanded a few slices at a time."""
    end = int(spread(np.array([END]))[0])

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = [("ids", r.slice, r.blob, None, None) for r in frame[frame["kind"] == "ids"].itertuples()]
        pairs = frame[frame["kind"] == "pairs"].sort_values("slice", kind="stable")  # what frequent and other words sent stands together
        if not len(pairs):
            return pd.DataFrame(out, columns=["kind", "key", "blob", "numbers", "mass"])
        slices = pairs["slice"].tolist()
        w, h, own, entries, docs, times, texts = [], [], [], [], [], [], {}
        for s, blob in zip(slices, pairs["blob"], strict=True):
            words, many, contexts, code, each, z, n, use = unpack(blob)
            w.append(np.repeat(words, many))
            h.append(contexts[code])
            own.append(np.add.reduceat(n * use[z], np.cumsum(each, dtype=np.int64) - each).astype(np.uint32))
            entries.append(each)
            docs.append(z)
            times.append(n)
            texts[s] = len(use)
        del frame, pairs, words, many, contexts, code, each, z, n, use
        w, h, own = joined(w), joined(h), joined(own)
        order = np.lexsort((h, w))
        w, h = w[order], h[order]
        at = runs(w, h)
        r = np.add.reduceat(own[order].astype(np.int64), at)
        pair_w, pair_h = w[at], h[at]
        del w, h, own
        group = np.empty(len(order), np.int64 if len(at) >> 31 else np.int32)
        group[order] = np.repeat(np.arange(len(at), dtype=group.dtype), np.diff(np.append(at, len(order))))
        del order, at
        per_word = runs(pair_w)
        cw = np.add.reduceat(r, per_word)
        hot = known.of_hot(pair_w[per_word])
        if (hot >= 0).any():
            cw = np.where(hot >= 0, known.hot_counts[hot], cw)
        cw = np.repeat(cw, np.diff(np.append(per_word, len(r))))
        p1 = known.p(cw)

        # What a pair adds to a document's sums.
        part = -np.log10(np.maximum(cw, 1))
        part[pair_w == np.uint64(end)] = 0.0
        part[r > K] += np.log10(r[r > K]) + np.log10(1 - EPSILON)
        part[r == 0] += np.log10(p1[r == 0])
        base, met = np.log10(cw + 0.5), cw > 0
        del pair_w, per_word, cw, hot

        # By context: what alpha needs.
        seen = r > 0
        order = np.argsort(pair_h[seen], kind="stable")
        y, n, q = pair_h[seen][order], r[seen][order], p1[seen][order]
        if len(y):
            at = runs(y)
            stats = [np.add.reduceat((n == k).astype(np.int64), at) for k in range(1, K + 1)] + [np.add.reduceat(np.where(n > K, n, 0), at)]
            mass, y = np.add.reduceat(q, at), y[at]
            hot = hot_context(known, y)
            for i in np.flatnonzero(hot >= 0).tolist():
                out.append(("frequent", int(hot[i]), None, [int(x[i]) for x in stats], float(mass[i])))
            cold = hot < 0
            y, mass, stats = y[cold], mass[cold], [x[cold] for x in stats]
            for bucket, a, b in pieces(bucket_of(y, buckets)):
                out.append(("alpha", bucket, pack(y[a:b], mass[a:b], *[x[a:b].astype(np.uint32 if k < K else np.int64) for k, x in enumerate(stats)]), None, None))
            del at, stats, mass, hot, cold
        del seen, order, y, n, q, p1
        out.append(("totals", 0, None, np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2].tolist(), None))

        # Sums for each document, and the entries of pairs that were not seen.
        lost_h, lost_slice, lost_doc, lost_times = [], [], [], []
        edges = np.cumsum([0, *map(len, entries)])
        for i, j in together([(s, len(z) + texts[s]) for s, z in zip(slices, docs, strict=True)], limit):
            names = np.unique(slices[i:j])
            first = np.cumsum([0, *(texts[s] for s in names.tolist())])
            doc = np.concatenate([z + a for z, a in zip(docs[i:j], first[np.searchsorted(names, slices[i:j])], strict=True)])
            to = np.repeat(group[edges[i] : edges[j]], np.concatenate(entries[i:j]))
            many = np.concatenate(times[i:j]).astype(np.int64)
            docs[i:j] = entries[i:j] = times[i:j] = [None] * (j - i)
            seen = r[to]
            count = lambda x: np.bincount(doc, x * many, first[-1])  # noqa: B023, E731
            sums = [count(base[to]), count(part[to])]
            numbers = [count(1), count(met[to])] + [count(seen == k) for k in range(1, K + 1)]
            for s, a, b in zip(names.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                out.append(("docs", s, pack(*[np.rint(x[a:b] * FIXED).astype(np.int64) for x in sums], *[x[a:b].astype(np.uint32) for x in numbers]), None, None))
            lost = np.flatnonzero(seen == 0)
            which = np.searchsorted(first[1:], doc[lost], side="right")
            lost_h.append(pair_h[to[lost]])
            lost_slice.append(names[which])
            lost_doc.append((doc[lost] - first[which]).astype(np.uint32))
            lost_times.append(many[lost].astype(np.uint32))
        del group, r, part, base, met, pair_h, doc, to, many, seen, sums, numbers, lost, which, count
        y, names, doc, times = joined(lost_h), joined(lost_slice), joined(lost_doc), joined(lost_times)
        at = np.where(hot_context(known, y) >= 0, names % buckets, bucket_of(y, buckets).astype(np.int64))
        order = np.lexsort((y, at))
        y, names, doc, times, at = y[order], names[order], doc[order], times[order], at[order]
        for bucket, a, b in pieces(at):
            out.append(("unseen", bucket, pack(y[a:b], names[a:b], doc[a:b], times[a:b]), None, None))
        return pd.DataFrame(out, columns=["kind", "key", "blob", "numbers", "mass"])

    return work


def hot_context(known: Unigrams, h: np.ndarray) -> np.ndarray:
    """Place of a context in the list of frequent words, or -1."""
    return known.of_hot(h)


def backoff(d: np.ndarray, stats: list[np.ndarray], mass: np.ndarray) -> np.ndarray:
    """log10 of alpha(h) * c(h), from the numbers of tokens seen 1..K times after h, the sum of higher counts, and P."""
    low = [s.astype(float) for s in stats[:K]]
    total = sum(k * s for k, s in enumerate(low, 1)) + stats[K]
    kept = sum(d[k] * k * s for k, s in enumerate(low, 1)) + d[K + 1] * stats[K]
    # alpha(h) c(h) = (c(h) - kept) / (1 - mass)
    return np.log10(np.maximum(total - kept, 1e-300)) - np.log10(np.maximum(1 - mass, 1e-12))


def by_document(names: np.ndarray, doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``part`` by slice and document."""
    order = np.lexsort((doc, names))
    names, doc, part = names[order], doc[order], part[order]
    at = runs(names, doc)
    return names[at], doc[at], np.add.reduceat(part, at) if len(at) else part


def by_context(d: np.ndarray, known: Unigrams, hot: np.ndarray):
    """Step 3: for each slice, sums of log10(alpha(h) c(h)) over the pairs that were not seen."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(b) for b in frame.loc[frame["kind"] == "alpha", "blob"]]
        y = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint64)
        order = np.argsort(y, kind="stable")
        at = runs(y[order])
        value = np.zeros(0)
        if len(y):
            sums = [np.add.reduceat(np.concatenate([g[k] for g in got])[order].astype(float if k == 1 else np.int64), at) for k in range(1, K + 3)]
            value, y = backoff(d, sums[1:], sums[0]), y[order][at]
        each = []
        for blob in frame.loc[frame["kind"] == "unseen", "blob"]:
            h, names, doc, times = unpack(blob)
            part = np.zeros(len(h))  # a context never seen: alpha is 1
            if len(y):
                near = np.minimum(np.searchsorted(y, h), len(y) - 1)
                part = np.where(y[near] == h, value[near], 0.0)
            place = hot_context(known, h)
            if (place >= 0).any():
                part = np.where(place >= 0, hot[place], part)
            each.append(by_document(names, doc, part * times))
        out = []
        if each:  # one row for each slice, whatever number of blobs its documents were in
            names, doc, part = by_document(*(np.concatenate(x) for x in zip(*each, strict=True)))
            out = [(s, pack(doc[a:b], np.rint(part[a:b] * FIXED).astype(np.int64))) for s, a, b in pieces(names)]
        return pd.DataFrame({"kind": ["more"] * len(out), "key": [o[0] for o in out], "blob": [o[1] for o in out]}).astype({"key": "int64"})

    return work


def finished(d: np.ndarray, known: Unigrams):
    """Step 4: one row for each document of a slice."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = frame.groupby("kind")["blob"]
        own = {k: [unpack(b) for b in v] for k, v in kinds}
        ids, missing, train = own["ids"][0]
        sums = [sum(g[k].astype(np.int64) for g in own["docs"]) for k in range(2 + 2 + K)]
        for doc, part in own.get("more", ()):
            np.add.at(sums[1], doc, part)
        base, score = sums[0] / FIXED, sums[1] / FIXED
        tokens, seen = sums[2], sums[3]
        for k in range(1, K + 1):
            score = score + sums[3 + k] * np.log10(d[k] * k)
        if known.texts:
            score = score - np.log10(known.texts)  # of the start as a context
        rate = np.log10(known.n + 0.5 * (known.v + 1))
        return pd.DataFrame({"doc_id": pd.array(np.where(missing == 1, 0, ids), "Int64"), "held_out": train == 0, "n_tokens": tokens, "n_known": seen, "train_tokens": known.n, "base_score": base - tokens * rate, "score": score}).assign(doc_id=lambda f: f["doc_id"].mask(missing == 1))

    return work


def score(docs: DataFrame, held_out: Column, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    The model is learned from the rows that are not ``held_out``.  Null and empty texts have the end token only.
    Repeated rows count, and are scored, once each; a null doc_id stays null.  Without training rows every token
    is unknown and has probability 1.  Other columns are not read; an empty table gives no rows.  No step holds
    more than a slice of documents or one partition of the tables, expanded a few slices of documents at a time.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    if not buckets:
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        buckets = max(5 * partitions(spark) // 4, chars // BUCKET_CHARS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out).alias("train"), "text")
    known = unigrams(rows, buckets)
    parts = sent(rows, known, buckets).groupBy("bucket").applyInPandas(freed(by_token(known, buckets)), PARTS).checkpoint()
    drop_dead_shuffles(spark)  # the pairs sent by token, the largest part of what is on disk
    n = parts.where("kind = 'totals'").agg(*[F.coalesce(F.sum(F.get("numbers", F.lit(k))), F.lit(0)) for k in range(K + 1)]).first()
    d = discounts(np.array(n, np.int64))
    hot = np.zeros(len(known.hot))
    frequent = parts.where("kind = 'frequent'").groupBy("key").agg(F.sum("mass"), *[F.sum(F.get("numbers", F.lit(k))) for k in range(K + 1)])
    for r in frequent.collect():  # at most the list of frequent words
        hot[r[0]] = backoff(d, [np.array([x]) for x in r[2:]], np.array([r[1]]))[0]
    more = parts.where("kind IN ('alpha', 'unseen')").select("kind", "key", "blob").groupBy("key").applyInPandas(freed(by_context(d, known, hot)), "kind string, key long, blob binary")
    every = parts.where("kind IN ('ids', 'docs')").select("kind", "key", "blob").unionByName(more)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return every.groupBy("key").applyInPandas(finished(d, known), schema)


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_of_id("doc_id") % 5 == 1)
