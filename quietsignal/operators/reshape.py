"""Reshaping and filtering that workflows put before and between detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keep: list[str], attrs: list[str]) -> DataFrame:
    """keep, attr, value: one row for each attribute."""
    return df.select(*keep, *[F.col(a).cast("double").alias(a) for a in attrs]).unpivot(keep, attrs, "attr", "value")


def selected(df: DataFrame, condition: str) -> DataFrame:
    """Rows that a SQL expression chooses."""
    return df.where(condition)


def sorted_by(df: DataFrame, field: str, *ties: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in numeric order of a field, range-partitioned; with ``limit`` the first ones only, as top-k."""
    x = F.col(field).cast("double")
    out = df.orderBy(x.desc() if descending else x, *ties)
    return out if limit is None else out.limit(limit)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda w: w != "")


def word_count(df: DataFrame, text: str) -> DataFrame:
    """word, n: words of letters a-z."""
    return df.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def since(df: DataFrame, checkpoints: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows from each key's checkpoint on; keys without one keep all rows."""
    from quietsignal.operators.models import attach

    out = attach(df, checkpoints.select(*keys, "checkpoint"), keys)
    return out.where(F.col("checkpoint").isNull() | (F.col(seq) >= F.col("checkpoint"))).drop("checkpoint")
