"""Detectors for SQL users: scalar functions, and a table function for each user's own tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Scalar functions in SQL itself, so they stay inside generated code.
FUNCTIONS = {
    "exp_scale": "exp_scale(c DOUBLE, s DOUBLE) RETURNS DOUBLE RETURN 1.0D - exp(-c * s)",
    "logistic_scale": "logistic_scale(k DOUBLE, x DOUBLE) RETURNS DOUBLE RETURN 1.0D / (1.0D + exp(-k * x))",
    "zscore": "zscore(v DOUBLE, m DOUBLE, s DOUBLE) RETURNS DOUBLE RETURN try_divide(abs(v - m), s)",
    "outlier_tag": "outlier_tag(s DOUBLE, t DOUBLE) RETURNS STRING RETURN CASE WHEN s IS NULL THEN 'I' WHEN t IS NULL THEN 'A' WHEN s > t THEN 'O' ELSE 'N' END",
}


@udtf(returnType="seq bigint, value double, score double", useArrow=False)
class NeighborhoodScore:
    """TABLE(t) PARTITION BY key ORDER BY seq, with columns seq and value, then window (5) and k (2): mean distance of
    a window's middle row to its k nearest in the window.  Rows go to Python in pickled batches (with Arrow each window
    would be a batch of its own on its way back); a window is kept."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, row, window: int = 5, k: int = 2) -> None:
        self.rows.append((row["seq"], row["value"]))
        if len(self.rows) == window:
            at = window // 2
            seq, v = self.rows[at]
            gaps = sorted(abs(v - x) for i, (_, x) in enumerate(self.rows) if i != at)
            yield seq, v, sum(gaps[:k]) / k
            self.rows.pop(0)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session: SELECT exp_scale(1, zscore(v, m, s)), neighborhood_score(TABLE(...))."""
    for text in FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udtf.register("neighborhood_score", NeighborhoodScore)
