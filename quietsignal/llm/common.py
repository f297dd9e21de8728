"""What several operators share: table reading, shared folders, word splitting and hashing."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 16 MB of text stay together at most while a Python worker handles a slice of an Arrow batch.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder that the session names.

    Where it names none, a local session (one machine, as in tests) gets a folder of its own; a cluster an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def drop_dead_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that are checkpointed by now.

    Spark deletes them when the driver's garbage collector finds their plans gone, which by itself may be long after.
    The bridge to the JVM lets go of what Python dropped once a second, so that is waited for.
    """
    import gc
    import time

    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


#: Bits for each id in a filter of ids, and the most bits of a filter (32 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 28
#: Bits in a row of Spark's bitmaps.
BUCKET = 32_768


def apart(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose doc_id is surely not among ``ids`` (doc_id, one row each; read three times), and the others.

    The others are all that are among them and one in FILTER_BITS of the rest or fewer, so joins that shuffle texts need
    only deal out these; an exact join must follow.  Rows with a null doc_id are among the first.  Beyond MOST_BITS more
    rows are taken for others; no row is lost.
    """
    bits = min(MOST_BITS, max(BUCKET, 1 << (FILTER_BITS * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(BUCKET - 1))
    marks = ids.select(bucket.alias("__marked"), bit.alias("__bit")).repartition("__marked").groupBy("__marked").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    byte = F.conv(F.hex(F.substr("__map", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.coalesce(F.col("doc_id").isNotNull() & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1), F.lit(False))
    marked = rows.withColumn("__bucket", bucket).join(F.broadcast(marks), F.col("__bucket") == F.col("__marked"), "left").withColumn("__seen", seen)
    return tuple(marked.where(F.col("__seen") == F.lit(which)).select(*(F.col(f"`{c}`") for c in rows.columns)) for which in (False, True))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, from which bucket counts follow the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id written as decimal text; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))


def crc_of_id_py(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(texts: list[str | int | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows (texts, or their lengths) with about ``limit`` characters each; a longer row is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = text if isinstance(text, int) else len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(b if b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else b if chr(b).isalnum() else 0x20 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and any non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    a, b, c = _MULTIPLIERS
    with np.errstate(over="ignore"):
        x = (x + a).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * b
        x = (x ^ (x >> np.uint64(27))) * c
        return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit word hashes, the last ``limit`` distinct words kept in a dictionary."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.one, self.limit, self.known = xxhash.xxh64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, one = self.known, self.one
        if len(known) > self.limit:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    v = known.get(w)
                    if v is None:
                        v = known[w] = one(w)
                    out[i] = v
        return np.array(out, np.uint64)


def release() -> None:
    """Give freed memory back to the system where Arrow and the C library can; idle workers then hold little."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches, at the end of which memory is given back; by then all that it held is freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return whole
