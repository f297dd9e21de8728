"""The corpus pipeline: documents through five of the operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quietsignal.llm import decontaminate, jaccard, packing, pii, quality
from quietsignal.llm.common import crc_of_id, table

#: Words that a packing worker remembers here, where the executor still holds what earlier stages left in memory.
PACK_WORDS = 150_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of two thirds of the ids."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels"), crc_of_id("doc_id") % 3 != 1))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles alike by 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.STAGE)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents and their places in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=PACK_WORDS)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", cut_benchmark),
    ("PII", mask_personal),
    ("packing", pack_sequences),
]
#: The stages learn, search and tokenize; tests compare them with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
