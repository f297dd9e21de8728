"""Harmonic packing of token pieces into sequences of a fixed length.

Piece lengths belong to reciprocal-capacity classes: class k holds the lengths from capacity // (k + 1) + 1
to capacity // k, and a bin of class k is full with exactly k pieces.  Documents may be cut, so a document's
remainder is cut to the largest length of its class (capacity // k) until less than ``tail`` tokens are left;
those go whole to the class of their length.  Every worker (a Spark task over one part of the input) fills its
bins alone: no shuffle, no counters shared between tasks, and a repeated task makes the same rows again.

What is left in unfilled bins when a worker ends is closed at powers of two, which need no padding: the
pieces are cut again so that each sequence holds the largest power of two that the rest still fills.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsignal.llm.common import released, slices

#: Characters of text that are split and looked up together.
SLICE_CHARS = 1_500_000
#: Never part of a word of letters or digits.
SYMBOLS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(length: int, capacity: int, tail: int) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then class lengths, then a tail of under ``tail``."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest >= tail:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


class Packer:
    """The open bins of one worker.  ``base`` makes its sequence numbers differ from all other workers'."""

    def __init__(self, base: int, capacity: int = 2048, tail: int = 64):
        self.base, self.capacity, self.tail, self.count = base, capacity, tail, 0
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.count, offset))
            offset += len(ids)
        self.count += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        start = 0
        for n in cut(len(ids), self.capacity, self.tail):
            k = self.capacity // n
            own = self.open.setdefault(k, [])
            own.append((doc, start, ids[start : start + n].copy(), len(ids)))
            start += n
            if len(own) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        """Close what is left, at the capacity and then at falling powers of two, without padding."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        rest = sum(len(p[2]) for p in left)
        own: list[tuple] = []
        room = 0
        for doc, start, ids, total in left:
            while len(ids):
                if not room:
                    room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                take = min(room, len(ids))
                own.append((doc, start, ids[:take], total))
                ids, start, room, rest = ids[take:], start + take, room - take, rest - take
                if not room:
                    self.close(own)
                    own = []


class Encoder:
    """Token ids of whole texts, through a dictionary of the ids of chunks between plain spaces and line feeds.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in order.  Of
    Latin-1 texts, which its normalizer leaves as they are but for case, chunks are lower-cased first; symbols
    after letters are encoded for themselves; and unknown words of letters are encoded many at a time and told
    apart by their word ends.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _plain(self, chunks: list[str]) -> None:
        """Learn chunks of lower-cased Latin-1 text: letters with a run of symbols behind them are two tokens' worth."""
        known = self.known
        bases = [w.rstrip(SYMBOLS) for w in chunks]
        words = [w for w in set(bases).difference(known) if w.isalpha()]
        groups = [words[i : i + 250] for i in range(0, len(words), 250)]
        for i in range(0, len(groups), 20):
            some = groups[i : i + 20]
            for own, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
                if len(ends) == len(own) + 1:
                    raw = ids.tobytes()
                    known.update(zip(own, [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], strict=True))
        tails = {w[len(base) :] for w, base in zip(chunks, bases, strict=True)}
        self._any(list(tails.difference(known)))
        rest = []
        for w, base in zip(chunks, bases, strict=True):
            if len(w) > len(base):
                if base in known and base.isalpha():
                    known[w] = known[base] + known[w[len(base) :]]
                else:
                    rest.append(w)
            elif w not in known:
                rest.append(w)
        self._any(list(set(rest).difference(known)))

    def _any(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 10_000):
            for w, e in zip(chunks[i : i + 10_000], self.tokenizer.encode_batch_fast(chunks[i : i + 10_000], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
        last = np.array([end], "<u4").tobytes()
        split: list[list[str]] = []
        new: tuple[set, set] = (set(), set())
        for text in texts:
            text = text or ""
            try:
                plain = text.encode("latin-1") is not None
            except UnicodeEncodeError:
                plain = False
            split.append((text.lower() if plain else text).replace("\n", " ").split(" "))
            new[plain].update(split[-1])
        if len(self.known) > self.limit:
            # What the texts at hand hold stays: frequent words are among it.
            self.known = {"": b""} | {w: self.known[w] for w in new[True].union(new[False]).intersection(self.known)}
        known = self.known
        self._plain(list(new[True].difference(known)))
        self._any(list(new[False].difference(known)))
        for words in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)) + last, "<u4")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, tail: int = 64, words: int = 500_000) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it is from and which place of which sequence it has.

    A null text counts as empty: its document is the end id alone.  Repeated rows are packed each for itself;
    a null doc_id stays null.  An empty table gives no rows.  Other columns are not read.  Very long texts are
    cut into whole sequences.  Memory: open bins hold under ``capacity`` tokens for each of at most
    capacity / tail + tail classes, whatever the input, and a worker remembers about ``words`` words and their ids
    (200 bytes each); fewer take more time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(tokenizer, words)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, tail)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE_CHARS):
                for doc, tokens in zip(ids[a:b], encoder(texts[a:b].to_pylist(), end_id), strict=True):
                    packer.add(doc, tokens)
                yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(work), SCHEMA)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quietsignal.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
