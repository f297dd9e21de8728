"""python -m quietsignal.cli DETECTOR --input PATH --output PATH --keys a,b --attrs v [--threshold 3] ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsignal.operators import alerts, drift, record, series
from quietsignal.operators.record import Settings


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quietsignal", description=__doc__)
    p.add_argument("job", choices=["zscore", "robustZscore", "extremeValue", "interPercentile", "mahalanobis", "count", "discord", "neighborhood", "changePoint", "forecast", "ddm", "eddm", "fhddm", "ecdd"])
    for name in ("--input", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--keys", default="")
    p.add_argument("--attrs", default="")
    p.add_argument("--seq", default="ts")
    p.add_argument("--window", type=int, default=5)
    p.add_argument("--threshold", type=float)
    p.add_argument("--polarity", default="high")
    p.add_argument("--exp-const", type=float, default=0.0)
    p.add_argument("--statistic", default="CVM")
    return p


def plan(args: argparse.Namespace, df: DataFrame) -> DataFrame:
    keys, attrs = ([x for x in v.split(",") if x] for v in (args.keys, args.attrs))
    at = (args.seq, args.seq)
    match args.job:
        case "count":
            return alerts.count_tags(df, keys)
        case "discord":
            return series.discord(df, keys, attrs[0], *at, args.window)
        case "neighborhood":
            return series.local_neighborhood(df, keys, attrs[0], *at, args.window, nearest=2)
        case "changePoint":
            return series.change_points(df, keys, attrs[0], *at, args.window, args.statistic, args.threshold or 0.0)
        case "forecast":
            return series.one_step_ahead(df, keys, attrs[0], *at, args.window)
        case "ddm":
            return drift.ddm(df, keys, attrs[0], *at, 30, args.threshold or 3.0)
        case "eddm":
            return drift.eddm(df, keys, attrs[0], *at, 30, args.threshold or 0.9)
        case "fhddm":
            return drift.fhddm(df, keys, attrs[0], *at, args.window, args.threshold or 0.01)
        case "ecdd":
            return drift.ecdd(df, keys, attrs[0], *at, 0.2, args.threshold or 2.0, 30)
        case _:
            return record.detect(df, args.job, Settings(keys, attrs, exp_const=args.exp_const, threshold=args.threshold, polarity=args.polarity))


def main(argv: list[str] | None = None) -> None:
    args = build().parse_args(argv)
    spark = SparkSession.builder.appName("quietsignal").getOrCreate()
    plan(args, read(spark, args.input)).withColumn("job", F.lit(args.job)).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
