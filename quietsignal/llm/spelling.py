"""Spelling variants by wildcard groups, without pairs.

Words are near if they differ by one inserted, deleted or replaced code point.

1. A word of L code points sends L wildcard keys: the word with one place left open, which stands for (position, prefix,
   suffix).  Words that share one differ at that place alone.  A group has at most as many words as there are letters;
   it keeps its size, and tells each member that size and the best of its top two words that is not the member.
2. A word also sends its distinct deletions.  One that is a word itself is near, and the other way round: the longer
   word is near to it by an insertion.  Deletions meet the vocabulary in one equality join.
3. Counts are summed and best words compared by word.  A near word is in one wildcard group or one deletion with the
   word and no more, so sums count each once, and no pair of a group is ever made.

Keys are 127-bit polynomial hashes, which an edit changes in one step; so a word of any length sends keys of 16 bytes
and no strings.  Words themselves are compared only where several near words are equally frequent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsignal.llm.common import released, shared_checkpoints, table

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words have so many code points and come up so often at least.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: The hash's modulus, a Mersenne prime, and its fixed base; the value of an open place.
MODULUS, BASE, OPEN = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15, 1
#: Rows of keys in an Arrow batch.
BATCH = 50_000


def counted(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """word, n: how often each distinct word comes up, added up in the tasks before anything is shuffled.

    A run's crc32 together with its document's id chooses the runs (one in ``one_in``) that lose a letter; such edits
    stand for typing errors that the tables lack.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, column in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begin = zlib.crc32(f"{'' if name is None else name}:".encode())
                # bytes.lower knows A-Z only.
                text = column.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(RUN.findall(text)).items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LETTERS:
                        total[word] += n
                if len(total) > HELD:
                    yield flushed(total)
        yield flushed(total)

    def flushed(total: Counter) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    rows = docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") > 0)
    return rows.mapInArrow(released(work), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys_of(word: str) -> tuple[int, Iterator[tuple[int, int]], Iterator[int]]:
    """The word's hash, its wildcard keys with the code point at the open place, and the hashes of its distinct deletions."""
    n = len(word)
    powers, before = [1] * n, [0]
    for i in range(1, n):
        powers[i] = powers[i - 1] * BASE % MODULUS
    for c in word:
        before.append((before[-1] * BASE + ord(c) + 2) % MODULUS)
    whole = before[n]
    opened = (((whole + (OPEN - ord(c) - 2) * powers[n - 1 - p]) % MODULUS, ord(c)) for p, c in enumerate(word))
    # Without place p what stood before it moves one place down.
    shorter = ((whole + (before[p] - before[p + 1]) * powers[n - 1 - p]) % MODULUS for p, c in enumerate(word) if not p or word[p - 1] != c)
    return whole, opened, shorter


def identified(words: DataFrame) -> DataFrame:
    """``words`` with id, the hash of the word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [keys_of(w)[0].to_bytes(16) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.binary())], ["word", "n", "id"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, id binary")


def wildcards(words: DataFrame) -> DataFrame:
    """key, letter (at the open place), id, n: a row for each place of each word."""
    return expanded(words, lambda word: keys_of(word)[1])


def deletions(words: DataFrame) -> DataFrame:
    """key, letter (null), id, n: a row for each distinct deletion of each word that leaves enough letters."""
    return expanded(words.where(F.length("word") > LEAST_LETTERS), lambda word: ((h, None) for h in keys_of(word)[2]))


def expanded(words: DataFrame, keys: Callable[[str], Iterator[tuple[int, int | None]]]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for word, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for h, letter in keys(word):
                    rows.append((h.to_bytes(16), letter, own, n))
                    if len(rows) == BATCH:
                        yield written(rows)
                        rows = []
        if rows:
            yield written(rows)

    def written(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "letter", "id", "n"])

    return words.select("word", "n", "id").mapInArrow(released(work), "key binary, letter int, id binary, n long")


def near(words: DataFrame) -> DataFrame:
    """id, found (near words in one group or by one deletion), other (the best of them), other_n.

    A wildcard group has one word for each letter at most, so the list of its members is bounded by the alphabet.
    """
    member = F.struct((-F.col("n")).alias("less"), "letter", "id")
    groups = wildcards(words).groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("ranked"))
    top = groups.where(F.size("ranked") > 1).select(F.size("ranked").alias("size"), F.slice("ranked", 1, 2).alias("two"), F.explode("ranked").alias("own"))
    best = F.when(F.col("own.id") == F.col("two")[0]["id"], F.col("two")[1]).otherwise(F.col("two")[0])
    replaced = top.select(F.col("own.id").alias("id"), (F.col("size") - 1).cast("long").alias("found"), best["id"].alias("other"), (-best["less"]).alias("other_n"))
    met = deletions(words).select("key", F.col("id").alias("a"), F.col("n").alias("a_n")).join(words.select(F.col("id").alias("key"), F.col("n").alias("b_n")), "key")
    side = lambda own, other: F.struct(F.col(own).alias("id"), F.lit(1).cast("long").alias("found"), F.col(other).alias("other"), F.col(f"{'b' if other == 'key' else other}_n").alias("other_n"))
    shifted = met.select(F.explode(F.array(side("a", "key"), side("key", "a"))).alias("s")).select("s.*")
    return replaced.unionByName(shifted)


def variants(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text), whatever other columns they have.

    A word's form is its most frequent near word (ties: the first by code points) if that is twice as frequent or more;
    else null.  Its root is the last word on the way from form to form, which ends because counts double.  Null and empty
    texts have no words; a null id counts as empty text where runs are chosen; repeated rows count as often as they come
    up.  No row gives no words.
    """
    shared_checkpoints(docs.sparkSession)
    words = identified(counted(docs, one_in).where(F.col("n") >= LEAST_COUNT)).checkpoint()
    # A word has a candidate for each place and letter at most; those as frequent as its best are compared as words.
    ranked = near(words).groupBy("id").agg(F.sum("found").alias("n_near"), F.max("other_n").alias("top"), F.collect_list(F.struct("other_n", "other")).alias("others"))
    tied = ranked.select("id", "n_near", "top", F.explode(F.filter("others", lambda o: o["other_n"] == F.col("top"))["other"]).alias("other"))
    named = tied.join(words.select(F.col("id").alias("other"), F.col("word").alias("name")), "other")
    best = named.groupBy("id").agg(F.first("n_near").alias("n_near"), F.first("top").alias("top"), F.min("name").alias("name"))
    enough = F.col("top") >= 2 * F.col("n")
    formed = words.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("name")).alias("form"), F.when(enough, F.col("top")).alias("form_n")).checkpoint()
    roots = rooted(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def rooted(steps: DataFrame) -> DataFrame:
    """word, root: where the steps (word, root: the next word) from each word end; each round doubles the steps taken."""
    steps = steps.checkpoint()
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = steps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")).checkpoint()
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return steps


OP11_SQL = """WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT i, run, count(*) AS k FROM r GROUP BY ALL),
b AS (SELECT run, k, flatten(list_transform(string_split(i || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c)::BIGINT >> 6), 128 + (ord(c)::BIGINT & 63)] END)) AS b FROM g),
h AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(8 * len(b)), lambda j: (b[j // 8 + 1] >> (j % 8)) & 1), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM b),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
p AS (SELECT word, n, unnest(range(length(word))) AS p FROM w),
o AS (SELECT word, n, substr(word, 1, p) || '*' || substr(word, p + 2) AS key FROM p),
d AS (SELECT DISTINCT word, n, substr(word, 1, p) || substr(word, p + 2) AS key FROM p),
m AS (SELECT a.word, b.word AS other, b.n FROM o a JOIN o b ON a.key = b.key AND a.word <> b.word UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON d.key = w.word UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON d.key = w.word),
t AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS top FROM m GROUP BY 1),
f AS (SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN other END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN t USING (word)),
u(word, here, form) AS (SELECT word, word, form FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON f.word = u.form)
SELECT f.word, f.n, n_near, f.form, form_n, u.here AS root FROM f JOIN u ON u.word = f.word AND u.form IS NULL"""


def op11_wildcard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
