"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of a bounded sample of its texts.  A text is cut into
pieces, every piece is compressed with each language's dictionary, and the language with the smallest total wins.
A text whose two best totals lie within ``margin`` of each other is marked as rejected; it keeps its best guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietsignal.llm.common import crc_of_id, table

#: The fit's bounded sample: so many rows of each language, and a slice of at most so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 600
PIECE = 2_000
LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, usable: Column) -> dict[str, bytes]:
    """A dictionary for each language, from rows with ``usable``, a language and a text with characters.

    Sampled are the SAMPLE_ROWS distinct texts of a language with the smallest hashes, and of each a slice from a
    place that the hash chooses; so repeated rows count once, and the driver gets at most that for each language.
    An empty table, or one without usable rows, gives no dictionary.
    """
    own = docs.where(usable & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.abs(F.xxhash64("text") % 1_000_000_007).alias("h"))
    place = F.col("h") % F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1) + 1
    cut = own.select("lang", "h", F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("s"))
    # About SAMPLE_ROWS small hashes of each language go through; a bound from the row count keeps the shuffle small.
    counts = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    bound = counts.select("lang", F.when(F.col("n") < 8 * SAMPLE_ROWS, 1_000_000_007).otherwise((F.lit(1_000_000_007.0) * 4 * SAMPLE_ROWS / F.col("n")).cast("long")).alias("most"))
    some = cut.join(F.broadcast(bound), "lang").where(F.col("h") <= F.col("most")).groupBy("lang", "h", "s").agg(F.lit(1).alias("one"))
    order = Window.partitionBy("lang").orderBy("h", "s")
    rows = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_ROWS).select("lang", "h", "s").collect()
    found: dict[str, list] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append((r["h"], r["s"]))
    return {x: "\n".join(s for _, s in sorted(own)).lower().encode("utf-8", "surrogatepass") for x, own in found.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, margin: float = 0.01, warmth: float = 24.0):
        import zstandard as z

        self.names, self.margin, self.warmth = sorted(dictionaries), margin, warmth
        self.coders = []
        for x in self.names:
            content = z.ZstdCompressionDict(dictionaries[x] + b" " * max(0, 8 - len(dictionaries[x])), dict_type=z.DICT_TYPE_RAWCONTENT)
            setting = z.ZstdCompressionParameters.from_level(level, min_match=3, strategy=z.STRATEGY_BTOPT, window_log=19, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.coders.append(z.ZstdCompressor(dict_data=content, compression_params=setting))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text in each language, piece by piece."""
        total = np.zeros(len(self.coders))
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE].lower().encode("utf-8", "surrogatepass")
            total += [len(c.compress(piece)) for c in self.coders]
        return total

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow.  Ties go to the first name; no letter gives ``und``."""
        if not self.names or not text or not LETTER.search(text):
            return "und", 0.0, True
        n = self.sizes(text)
        best = int(n.argmin())
        p = np.exp(-(n - n[best]) * np.log(2) * 8 / self.warmth)
        rest = np.delete(n, best)
        return self.names[best], float(p[best] / p.sum()), bool(len(rest) and rest.min() - n[best] < self.margin * n[best])


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    Null and empty texts, and texts without a letter (Unicode category L), are ``und``, 0, true; so is every text
    without a dictionary.  Rows are kept, repeated ones too; other columns are not read; very long texts are
    compressed piece by piece.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]  # one text at a time is a Python object
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_of_id("doc_id") % 5 == 0
    return classify(docs, fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
