"""Delimited text, schemas and models as files, in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

TYPES = {"string": StringType(), "categorical": StringType(), "text": StringType(), "id": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "float": DoubleType()}


def schema_from_json(text: str) -> StructType:
    """A JSON schema (attributes or fields with name, ordinal, dataType and more) as a Spark schema; the rest becomes metadata."""
    found = json.loads(text)
    fields = found.get("attributes") or found.get("fields") or []
    for i, f in enumerate(fields):
        f.setdefault("ordinal", i)
    return StructType([StructField(f["name"], TYPES[f.get("dataType", "string")], True, {k: v for k, v in f.items() if k not in ("name", "dataType")}) for f in sorted(fields, key=lambda f: f["ordinal"])])


def load_schema(spark: SparkSession, path: str) -> StructType:
    """``schema_from_json`` of a file in any store that Spark reads."""
    return schema_from_json(spark.read.text(path, wholetext=True).first()[0])


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Delimited text with trimmed fields; a separator of several characters is allowed; what cannot be cast is null."""
    return spark.read.csv(path, schema=schema, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")


def by_ordinal(df: DataFrame, ordinals: list[int]) -> list[str]:
    """Column names at places, for settings that know places only."""
    return [df.columns[i] for i in ordinals]


def write_delimited(df: DataFrame, path: str, sep: str = ",", digits: int = 3, save: bool = True) -> None:
    """Delimited text with doubles of fixed precision; nothing without ``save``."""
    if save:
        fixed = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
        df.select(*fixed).write.mode("overwrite").csv(path, sep=sep)


def write_all(parts: dict[str, DataFrame], folder: str) -> None:
    """Side outputs (clean data, statistics, checkpoints, models), each in a folder of its own."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """type, id, parentType, parentId, singleton from a JSON tree of streams (id, type, parentId, parentType, childrenId, singleton).

    Children listed under a parent get a row each; a stream with a parent of its own gets one.
    """
    raw = spark.read.json(path, multiLine=True)
    kinds = dict(raw.dtypes)
    root = next((c for c in raw.columns if kinds[c].startswith("array<struct")), None)
    each = raw.select(F.explode(root).alias("s")).select("s.*") if root else raw
    for c in ("id", "type", "parentId", "parentType", "singleton"):
        if c not in each.columns:
            each = each.withColumn(c, F.lit(None).cast("boolean" if c == "singleton" else "string"))
    own = each.where(F.col("parentType").isNotNull()).select("type", "id", "parentType", "parentId", F.coalesce(F.col("singleton").cast("boolean"), F.lit(False)).alias("singleton"))
    if "childrenId" in each.columns:
        down = each.where(F.size("childrenId") > 0)
        kind = F.col("childrenType") if "childrenType" in each.columns else F.lit(None).cast("string")
        below = down.select(kind.alias("type"), F.explode("childrenId").alias("id"), F.col("type").alias("parentType"), F.col("id").alias("parentId"), F.lit(False).alias("singleton"))
        own = own.unionByName(below.where(F.col("type").isNotNull()))
    return own.distinct()


def read_ranges(spark: SparkSession, path: str, keys: list[str], attrs: list[str], sep: str = ",") -> DataFrame:
    """keys, then low values, then high values, as ``{attr}_lo`` and ``{attr}_hi``."""
    fields = [f"{k} string" for k in keys] + [f"{a}_lo double" for a in attrs] + [f"{a}_hi double" for a in attrs]
    return read_delimited(spark, path, ", ".join(fields), sep)


def read_thresholds(spark: SparkSession, path: str, keys: list[str], sep: str = ",") -> DataFrame:
    return read_delimited(spark, path, ", ".join([*[f"{k} string" for k in keys], "threshold double"]), sep)


def read_checkpoints(spark: SparkSession, path: str, keys: list[str], sep: str = ",") -> DataFrame:
    return read_delimited(spark, path, ", ".join([*[f"{k} string" for k in keys], "checkpoint long"]), sep)


def read_transitions(spark: SparkSession, path: str, keys: list[str], states: list[str], sep: str = ",") -> DataFrame:
    """A compact matrix file (keys, then probabilities row by row) as keys, prev, cur, prob."""
    n = len(states)
    wide = read_delimited(spark, path, ", ".join([*[f"{k} string" for k in keys], *[f"c{i} double" for i in range(n * n)]]), sep)
    cells = F.explode(F.array(*[F.struct(F.lit(states[i // n]).alias("prev"), F.lit(states[i % n]).alias("cur"), F.col(f"c{i}").alias("prob")) for i in range(n * n)]))
    return wide.select(*keys, cells.alias("x")).select(*keys, "x.*")


def read_transition_lines(spark: SparkSession, path: str, keys: list[str], states: list[str], sep: str = ",") -> DataFrame:
    """A long matrix file, a line of keys followed by one line of probabilities for each state, as keys, prev, cur, prob.

    The file is one small model, so it is read whole.
    """
    lines = [x.strip() for x in spark.read.text(path, wholetext=True).first()[0].splitlines() if x.strip()]
    rows, step = [], len(states) + (1 if keys else 0)
    for at in range(0, len(lines), step):
        key = lines[at].split(sep)[: len(keys)] if keys else []
        for prev, line in zip(states, lines[at + (1 if keys else 0) : at + step], strict=True):
            rows += [(*key, prev, cur, float(p)) for cur, p in zip(states, line.split(sep), strict=True)]
    return spark.createDataFrame(rows, ", ".join([*[f"{k} string" for k in keys], "prev string", "cur string", "prob double"]))


def read_bucket_counts(spark: SparkSession, path: str, keys: list[str], sep: str = ",") -> DataFrame:
    return read_delimited(spark, path, ", ".join([*[f"{k} string" for k in keys], "bucket string", "n long"]), sep)


def union_tagged(first: DataFrame, second: DataFrame, name: str = "src") -> DataFrame:
    """Two inputs in one, told apart by 0 and 1."""
    return first.withColumn(name, F.lit(0)).unionByName(second.withColumn(name, F.lit(1)))


def peek(df: DataFrame, rows: int = 5) -> str:
    """The first rows as text; never the whole table."""
    return df._show_string(rows, 40)
