"""Document fingerprints by winnowing, with DataFrame functions alone.

Every run of ``k`` words has a polynomial hash (the value that a rolling hash has at that place).  Of every
``window`` successive hashes the smallest is kept, of equal ones the rightmost, with its position; so two texts
that share ``k + window - 1`` successive words share a fingerprint.  A text of fewer words than ``k`` is one run.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietsignal.llm.arrays import let
from quietsignal.llm.common import partitions, table

K, WINDOW = 5, 5
#: Word hashes have 28 bits and multipliers 31, so that a sum of up to 16 products stays below 2 ** 63.
WORD_BITS, PRIME, BASE = 28, (1 << 31) - 1, 1_103_515_245
PLACES = 1 << 31


def selected(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Kept runs as longs, hash * 2 ** 31 + (2 ** 31 - 1 - position), in order of position.  Null counts as empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << WORD_BITS) - 1)))
    powers = [pow(BASE, k - 1 - j, PRIME) for j in range(k)]

    def runs(h: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: packed(reduce(add, [F.get(h, i + j) * F.lit(powers[j]) for j in range(k)]), i))
        short = F.transform(F.slice(F.array(F.lit(0)), F.lit(1), F.least(F.size(h), F.lit(1))), lambda i: packed(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME), i))
        return F.when(F.size(h) >= k, full).otherwise(short)

    def packed(hash_: Column, i: Column) -> Column:
        return (hash_ % PRIME) * PLACES + (F.lit(PLACES - 1) - i)

    def least(p: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - window + 1, F.lit(1))), lambda i: F.array_min(F.slice(p, i, window)))
        return F.when(F.size(p) > 0, F.array_distinct(each)).otherwise(p)

    return let(hashes, lambda h: let(runs(h), least))


def written(kept: Column) -> Column:
    """``hash:position`` of each kept run, comma-joined; hashes in hexadecimal."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 31))), F.lit(":"), (F.lit(PLACES - 1) - v.bitwiseAND(F.lit(PLACES - 1))).cast("string"))
    return F.array_join(F.transform(kept, one), ",")


def hashes_of(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes of two hash sets; 1 if both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.coalesce(F.try_divide(n.cast("double"), F.size(a) + F.size(b) - n), F.lit(1.0)))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with a column ``fingerprint``.  Null, empty and blank texts have an empty one; equal texts, equal ones."""
    return docs.withColumn("fingerprint", written(selected(F.col("text"), k, window)))


def with_next(docs: DataFrame, buckets: int, made: Column | None = None) -> DataFrame:
    """doc_id, text, following (text of the next row by doc_id, then text; after the last comes the first).

    With ``made``, an expression over text, also its value for both texts: made, following_made.  It is worked out
    once for each row, after the rows are dealt and before they are sorted.

    Rows are dealt to ranges of ids whose limits are ids that occur.  The first rows of a range are also dealt
    to the range before it, and those of the first range to the last, so each range finds its successors alone.
    Null ids come first; a null text counts as empty; rows that share an id are one range, in order of text; a
    row alone is followed by itself; an empty table gives no rows.  Other columns are not read.
    """
    # Nulls come first; a null text counts as empty.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    low, high, limits, nulls = rows.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets)), F.count_if(F.col("doc_id").isNull())).first()
    low, high = (0, 0) if low is None else (low, high)
    limits = sorted(set(limits or ()) - {low})
    width = max(1.0, (float(high) - float(low)) / max(1, len(limits)))
    cell_of = lambda x: math.floor((float(x) - float(low)) / width)  # noqa: E731  as Spark divides
    cells: list[tuple[int, list[int]]] = []
    by_cell: dict[int, list[int]] = {}
    for x in limits:
        by_cell.setdefault(cell_of(x), []).append(x)
    before = 0
    for c in range(cell_of(high) + 1):
        cells.append((before, by_cell.get(c, [])))
        before += len(cells[-1][1])
    key = F.coalesce(F.col("doc_id"), F.lit(low))
    cell = F.floor((key.cast("double") - F.lit(float(low))) / F.lit(width)).cast("int")
    base = F.get(F.lit([c[0] for c in cells]), cell)
    inner = F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in c[1]]).cast("array<bigint>") for c in cells]), cell)
    dealt = rows.withColumn("bucket", (base + F.size(F.filter(inner, lambda x: x <= key))).cast("int"))
    is_limit = F.exists(inner, lambda x: x == key) if limits else F.lit(False)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == low
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("turn"), F.lit(True).alias("own"))
    earlier = F.when(is_limit, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(0).alias("turn"), F.lit(False).alias("own")))
    wrapped = F.when(first, F.struct(F.lit(len(limits)).alias("bucket"), F.lit(1).alias("turn"), F.lit(False).alias("own")))
    copies = dealt.select("doc_id", "text", F.explode(F.array_compact(F.array(own, earlier, wrapped))).alias("at")).select("doc_id", "text", "at.*")
    order = Window.partitionBy("bucket").orderBy("turn", "doc_id", "text")
    placed = copies.repartition("bucket")
    if made is None:
        return placed.withColumn("following", F.lead("text").over(order)).where("own").select("doc_id", "text", "following")
    placed = placed.withColumn("made", made).withColumn("following", F.lead("text").over(order)).withColumn("following_made", F.lead("made").over(order))
    return placed.where("own").select("doc_id", "text", "made", "following", "following_made")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"), 4 * partitions(spark), selected(F.col("text")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("following", F.lit(1), cut))
    # One lambda binds what is needed twice, so the edited text's fingerprint and the hash sets are computed once.
    sets = lambda b: F.struct(hashes_of(F.col("made")).alias("a"), hashes_of(b).alias("b"), hashes_of(F.col("following_made")).alias("c"))
    found = let(
        selected(F.col("edited")),
        lambda b: let(
            sets(b),
            lambda s: F.struct(written(F.col("made")).alias("fingerprint"), written(b).alias("edited_fingerprint"), likeness(s["a"], s["b"]).alias("near_edited"), likeness(s["a"], s["c"]).alias("near_next")),
        ),
    )
    out = pairs.withColumn("edited", edited).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), found.alias("f"))
    return out.select("doc_id", "n_chars", "edited_sha256", "f.*")
