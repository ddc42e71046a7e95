"""Data checks that run as jobs and return the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: both counts and whether they agree."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s)) for s, df in (("left", left), ("right", right))]
    both = counted[0].unionByName(counted[1])

    def of(side: str):
        return F.max(F.when(F.col("side") == side, F.col("n")))

    return both.agg(of("left").alias("n_left"), of("right").alias("n_right")).withColumn(
        "equal", F.col("n_left") == F.col("n_right")
    )


def empty_splits(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (task, split) without a row."""
    return expected.join(df.select("task", "split").distinct(), ["task", "split"], "left_anti")


def missing_metrics(expected: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(metrics.select(*keys).distinct(), keys, "left_anti")
