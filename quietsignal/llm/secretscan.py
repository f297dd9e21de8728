"""Secrets by a linear-chain conditional random field over the tokens of whole texts.

Base secrets follow stated patterns.  They also teach a model: tokens of base secrets in a bounded sample of texts are
begin or inside, all others outside.  A token is seen by its shape, its neighbouring words and what its file
is like, never by the patterns themselves, so a value of the right shape in the right company is found where no pattern
holds.  Labels of a text are decoded together, by Viterbi.

* Tokens are runs of letters, digits and ``_+/-``, and every other character that is no space by itself.
* The fit minimises the negative log-likelihood of the labels, with a square penalty, by L-BFGS.  Forward and backward
  sums run over blocks of the chain side by side: products of label matrices first, then the blocks' ends, then their insides.
* Decoding leaves out what cannot matter: where outside beats the others by more than all transitions around a token
  can make up for, it is outside in every best labelling.  Viterbi runs over the stretches in between, and the labelling
  is the best of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietsignal.llm.common import released, slices, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run of so many characters is what is left of a greedy one after failing matches are dropped.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
#: What texts with a base secret contain, for the sample; one character class at a time.
SIGN = r"""[0-9a-f]{24}|AKIA[A-Z0-9]{16}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
#: The fit's bounded sample: so many distinct whole texts with a base secret and as many without, the smallest by hash.
SAMPLE_ROWS = 150
OUTSIDE, BEGIN, INSIDE = range(3)
#: Words and beginnings that come up so often in the sample have weights of their own.
LEAST_SEEN = 3
#: Characters that a task turns into tokens at once.
CHUNK, SLICE = 500_000, 1_000_000
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base secrets, by start and kind; and the values in them are what ``values`` gives."""
    return sorted((a, k, b) for k, a, b, _ in matches(text))


def matches(text: str) -> Iterator[tuple[int, int, int, int]]:
    """kind, start, end, and where the secret value starts."""
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield 0, m.start(), m.end(), m.start(2)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield 1, m.start(), m.end(), m.start()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end(), m.start()


#: By code point: 0 space, 1 lower, 2 upper, 3 digit, 4 symbol inside tokens, 5 other scripts (128 stands for all), 6 alone.
CLASS = np.array([0 if chr(c).isspace() else 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 4 if chr(c) in "_+/-" else 6 for c in range(128)] + [5], np.uint8)
HEXADECIMAL = np.array([chr(c) in "0123456789abcdef" for c in range(128)] + [False])
LENGTHS = np.array([2, 3, 4, 6, 8, 10, 13, 16, 20, 24, 32, 41, 65])
CHANGES = np.array([1, 2, 3, 5, 8, 12])
RATES = np.array([0.002, 0.01, 0.03, 0.1, 0.3])
SHAPES = (32 + 128) * (len(LENGTHS) + 1)
DETAILS = 2 * (len(CHANGES) + 1)
FILES = (len(RATES) + 1) ** 2
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)


class Tokens(NamedTuple):
    """Columns by token: code point range, text number, shape, detail, word hash, hash of the first letters, file features."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    shape: np.ndarray
    detail: np.ndarray
    word: np.ndarray
    begins: np.ndarray
    file: np.ndarray


def tokens(texts: list[str]) -> Tokens:
    """The tokens of texts, places counted within each text; a long text is worked off in pieces cut at spaces."""
    joined, first = "\n".join(texts), np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    parts, a = [], 0
    while a < len(joined):
        b = a + CHUNK
        if b < len(joined):
            cut = max(joined.rfind(" ", a, b), joined.rfind("\n", a, b))
            if cut <= a:
                after = re.compile(r"[ \n]").search(joined, b)
                cut = after.start() if after else len(joined)
            b = cut + 1
        parts.append(tokens_of(joined[a:b], a))
        a = b
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in range(8)]
    start, end, shape, detail, word, begins, digits, marks = columns
    text = np.searchsorted(first, start, side="right") - 1
    size = np.maximum(1, [len(t) for t in texts]) if texts else np.ones(1)
    rates = [np.searchsorted(RATES, np.bincount(text, x, len(size)) / size, side="right") for x in (digits, marks)]
    file = (rates[0] * (len(RATES) + 1) + rates[1])[text]
    return Tokens(start - first[text] if len(texts) else start, end - first[text] if len(texts) else end, text, shape, detail, word.astype(np.uint64), begins.astype(np.uint64), file)


def tokens_of(piece: str, shift: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(codes, 128)
    kind = CLASS[small]
    inner = (kind > 0) & (kind < 6)
    edge = np.concatenate([[False], inner, [False]])
    alone = kind == 6
    start = np.flatnonzero(inner & ~edge[:-2] | alone)
    end = np.flatnonzero(inner & ~edge[2:] | alone) + 1
    upto = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int32))
    count = lambda mask: (lambda c: c[end] - c[start])(upto(mask))
    size, has = end - start, [count(kind == k) for k in range(1, 6)]
    mask = sum((h > 0).astype(int) << k for k, h in enumerate(has))
    mark = np.where(alone[start], 32 + small[start], mask)
    shape = mark.astype(int) * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, size, side="right")
    turned = upto(np.append(False, kind[1:] != kind[:-1]))
    changes = np.searchsorted(CHANGES, turned[end] - turned[np.minimum(start + 1, len(codes))], side="right")
    detail = changes * 2 + (count(HEXADECIMAL[small]) == size)
    low = codes.astype(np.uint64) + np.where((codes >= 65) & (codes <= 90), 32, 0).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(codes) + 1, FACTOR, np.uint64))
        back = np.cumprod(np.full(len(codes) + 1, np.uint64(pow(int(FACTOR), -1, 1 << 64)), np.uint64))
        sums = np.append(np.uint64(0), np.cumsum(low * powers[:-1], dtype=np.uint64))
        word = (sums[end] - sums[start]) * back[start]
        begins = np.zeros(len(start), np.uint64)
        at = start[size >= 8]
        begins[size >= 8] = sum((codes[at + i].astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(16 * i) for i in range(4)) + np.uint64(1)
    return start + shift, end + shift, shape, detail, word, begins, has[2], alone[start].astype(int)


class Model(NamedTuple):
    """Known words and beginnings (sorted hashes), a weight of each feature and label, of each pair of labels, and of a first label."""

    words: np.ndarray
    beginnings: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray


def features(t: Tokens, words: np.ndarray, beginnings: np.ndarray) -> tuple[np.ndarray, int]:
    """Feature numbers by token, a row for each kind of feature, and how many features there are."""

    def known(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.zeros(len(h), int)
        at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
        return np.where(sorted_[at] == h, at + 1, 0)

    def moved(x: np.ndarray, by: int, none: int) -> np.ndarray:
        """The value ``by`` tokens before (after, if negative) in the same text."""
        out = np.full(len(x), none)
        here, there = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
        same = t.text[here] == t.text[there]
        out[here][same] = x[there][same]
        return out

    word, wide = known(words, t.word), len(words) + 2
    columns = [(t.shape, SHAPES), (t.detail, DETAILS), (word, wide), (known(beginnings, t.begins), len(beginnings) + 1), (t.file, FILES)]
    columns += [(moved(word, by, len(words) + 1), wide) for by in (1, 2, 3, -1)]
    columns += [(moved(t.shape, by, SHAPES), SHAPES + 1) for by in (1, -1)]
    ids, total = [], 0
    for c, n in columns:
        ids.append(c + total)
        total += n
    return np.array(ids).reshape(len(columns), len(t.start)), total


def scores(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((ids.shape[1], 3))
    for row in ids:
        out += weights[row]
    return out


def scanned(matrices: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, float]:
    """Normalised row vectors begin M1 ... Mt for every t, and the log of what all of them were divided by."""
    n = len(matrices)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    m = np.concatenate([matrices, np.broadcast_to(np.eye(3), (blocks * size - n, 3, 3))]).reshape(blocks, size, 3, 3)
    m = np.ascontiguousarray(m.transpose(1, 2, 3, 0))  # place, row, column, block
    whole, lost = m[0], np.zeros(blocks)
    for i in range(1, size):
        whole = whole[:, 0, None] * m[i, 0] + whole[:, 1, None] * m[i, 1] + whole[:, 2, None] * m[i, 2]
        if i % 8 == 0 or i == size - 1:
            top = whole.max((0, 1))
            whole, lost = whole / top, lost + np.log(top)
    at, starts, log = begin, [], 0.0
    for k in range(blocks):
        starts.append(at)
        at = at @ whole[:, :, k]
        log += lost[k] + np.log(at.sum())
        at = at / at.sum()
    out, now = np.empty((size, 3, blocks)), np.array(starts).T
    for i in range(size):
        now = now[0] * m[i, 0] + now[1] * m[i, 1] + now[2] * m[i, 2]
        now = now / now.sum(0)
        out[i] = now
    return out.transpose(2, 0, 1).reshape(-1, 3)[:n], float(log)


def likelihood(unary: np.ndarray, steps: np.ndarray, first: np.ndarray, fresh: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood of chains (``fresh`` marks their first tokens), and its slopes by unary score, step and first label."""
    top = unary.max(1)
    m = np.exp((unary - top[:, None])[:, None, :] + np.where(fresh[:, None, None], first[None, None, :], steps[None, :, :]))
    # A chain's first matrix has equal rows, so whatever came before does not matter.
    alpha, log = scanned(m, np.full(3, 1 / 3))
    turned = np.concatenate([np.ones((1, 3, 3)) / 3, m[:0:-1].transpose(0, 2, 1)]) if len(m) else m
    beta = scanned(turned, np.full(3, 1 / 3))[0][::-1] if len(m) else alpha
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    before = np.concatenate([np.full((1, 3), 1 / 3), alpha[:-1]])
    pairs = before[:, :, None] * m * beta[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    inner, at = ~fresh, np.arange(len(labels))
    own = unary[at, labels].sum() + first[labels[fresh]].sum() + steps[labels[:-1][inner[1:]], labels[1:][inner[1:]]].sum()
    slope = gamma.copy()
    slope[at, labels] -= 1
    seen = np.zeros((3, 3))
    np.add.at(seen, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    return log + top.sum() - own, slope, pairs[inner].sum(0) - seen, gamma[fresh].sum(0) - np.bincount(labels[fresh], minlength=3)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8, enough: float = 0.02) -> np.ndarray:
    """L-BFGS with halved steps."""
    value, slope = f(x)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < enough:
            break
        d, used = slope.copy(), []
        for s, y, r in reversed(kept):
            a = r * (s @ d)
            used.append(a)
            d -= a * y
        if kept:
            s, y, r = kept[-1]
            d *= 1 / (r * (y @ y))
        else:
            d /= max(1.0, float(np.abs(d).sum()))
        for (s, y, r), a in zip(kept, reversed(used), strict=True):
            d += s * (a - r * (y @ d))
        step, gain = 1.0, float(slope @ d)
        while True:
            there, turned = f(x - step * d)
            if there <= value - 1e-4 * step * gain or step < 1e-6:
                break
            step /= 2
        s, y = -step * d, turned - slope
        if s @ y > 1e-12:
            kept = [*kept, (s, y, 1 / float(s @ y))][-memory:]
        x, value, slope = x - step * d, there, turned
    return x


def labelled(texts: list[str], t: Tokens) -> np.ndarray:
    """Labels of tokens: those that a base secret's value touches are begin (the first of a value) or inside."""
    out, ends = np.zeros(len(t.start), int), np.searchsorted(t.text, np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        a, b = ends[k], ends[k + 1]
        for _, _, stop, value in sorted(matches(text)):
            i = a + int(np.searchsorted(t.end[a:b], value, side="right"))
            j = a + int(np.searchsorted(t.start[a:b], stop))
            if j > i and not out[i:j].any():
                out[i], out[i + 1 : j] = BEGIN, INSIDE
    return out


def learned(texts: list[str], penalty: float = 1.0, rounds: int = 40) -> Model | None:
    """The model of sampled texts; without a base secret among them there is none."""
    t = tokens(texts)
    labels = labelled(texts, t)
    if not labels.any():
        return None

    def often(h: np.ndarray) -> np.ndarray:
        value, n = np.unique(h, return_counts=True)
        return value[n >= LEAST_SEEN]

    words, beginnings = often(t.word), often(t.begins[t.begins > 0])
    ids, total = features(t, words, beginnings)
    fresh = np.append(True, np.diff(t.text) != 0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, steps, first = x[: 3 * total].reshape(total, 3), x[3 * total : 3 * total + 9].reshape(3, 3), x[3 * total + 9 :]
        value, slope, by_step, by_first = likelihood(scores(ids, w), steps, first, fresh, labels)
        by_feature = np.stack([sum(np.bincount(row, slope[:, y], total) for row in ids) for y in range(3)], 1)
        return value + penalty / 2 * float(x @ x), np.concatenate([by_feature.ravel(), by_step.ravel(), by_first]) + penalty * x

    x = minimised(loss, np.zeros(3 * total + 12), rounds)
    return Model(words, beginnings, x[: 3 * total].reshape(total, 3), x[3 * total : 3 * total + 9].reshape(3, 3), x[3 * total + 9 :])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of ``rows`` distinct texts with a base secret and as many without, the smallest by hash; whole texts.

    Copies count once.  An empty table, or one without a base secret, gives no model, and then nothing is added.
    """
    own = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("h"), F.col("text").rlike(SIGN).alias("has"))
    few = own.groupBy("has", "h").agg(F.lit(1).alias("one")).withColumn("k", F.row_number().over(Window.partitionBy("has").orderBy("h"))).where(F.col("k") <= rows)
    chosen = [r["h"] for r in few.select("h").collect()]
    texts = own.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect() if chosen else []
    return learned([r["text"] for r in texts]) if texts else None


def certain(unary: np.ndarray, model: Model) -> np.ndarray:
    """Tokens that are outside in every best labelling: no transitions around them make up for the difference."""
    before = np.concatenate([model.steps, model.first[None, :]])  # a last token has no step after it
    after = np.concatenate([model.steps, np.zeros((3, 1))], 1)
    most = np.array([(before[:, y][:, None] - before[:, OUTSIDE][:, None] + after[y][None, :] - after[OUTSIDE][None, :]).max() for y in range(3)])
    return (unary[:, OUTSIDE] > (unary + most)[:, 1:].max(1) + 1e-9) if len(unary) else np.zeros(0, bool)


def viterbi(unary: np.ndarray, steps: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
    """The best labels of a stretch; ``before`` and ``after``: what each first and last label gains from outside it."""
    best, back = unary[0] + before, []
    for u in unary[1:]:
        each = best[:, None] + steps
        back.append(each.argmax(0))
        best = each.max(0) + u
    at = int((best + after).argmax())
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def decoded(t: Tokens, model: Model) -> np.ndarray:
    """The best labels of all texts."""
    unary = scores(features(t, model.words, model.beginnings)[0], model.weights)
    labels, open_ = np.zeros(len(unary), int), np.flatnonzero(~certain(unary, model))
    if not len(open_):
        return labels
    # Stretches end where a token is certain or a text ends.
    gap = (np.diff(open_) > 1) | (np.diff(t.text[open_]) != 0)
    for stretch in np.split(open_, np.flatnonzero(gap) + 1):
        a, b = stretch[0], stretch[-1] + 1
        begins, ends = a == 0 or t.text[a - 1] != t.text[a], b == len(unary) or t.text[b] != t.text[b - 1]
        labels[a:b] = viterbi(unary[a:b], model.steps, model.first if begins else model.steps[OUTSIDE], np.zeros(3) if ends else model.steps[:, OUTSIDE])
    return labels


def kind_of(value: str) -> int:
    """What an added secret looks like most."""
    return 2 if re.fullmatch("[0-9a-f]+", value) else 1 if re.fullmatch("[A-Z0-9]+", value) else 0


def added(texts: list[str], model: Model | None, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Decoded secrets of each text that touch no base secret."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is None or not any(texts):
        return out
    t = tokens(texts)
    labels = decoded(t, model)
    found = np.flatnonzero(labels)
    begins = [i for k, i in enumerate(found) if labels[i] == BEGIN or not k or found[k - 1] != i - 1 or t.text[i] != t.text[i - 1]]
    for a, b in zip(begins, [*begins[1:], None], strict=False):
        last = found[(len(found) if b is None else np.searchsorted(found, b)) - 1]
        k, start, end = int(t.text[a]), int(t.start[a]), int(t.end[last])
        if not any(start < y and x < end for x, _, y in base[k]):
            out[k].append((start, kind_of(texts[k][start:end]), end))
    return out


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end by start, then kind; code points) of every row.

    Null and empty texts have no spans.  Repeated rows and ids are kept, a null id too; other columns are not read.  An
    added span touches no base span.  Whole texts are decoded, however long.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            column, names = batch.column(1), batch.column(0)
            for a, b in slices(pa.compute.utf8_length(column).fill_null(0).to_pylist(), SLICE):
                texts = [x or "" for x in column.slice(a, b - a).to_pylist()]
                base = [base_spans(x) for x in texts]
                more = added(texts, model, base)
                spans = [sorted(x + y) for x, y in zip(base, more, strict=True)]
                rows = [pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in side], kind) for side in (base, spans)]
                yield pa.record_batch([names.slice(a, b - a), *rows], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(work), f"doc_id long, base {SPAN}, spans {SPAN}")


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def how_many(kind: int) -> Column:
    # A function of one argument: Spark hands a second one, default or not, the place in the array.
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op12_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    counts = [how_many(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
