"""Trial logs and generated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritas.operators.trials import last_per


def read_progress(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """All iterations of all trials; the folder of a file names its trial."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    trial = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select("*", trial.alias("trial_id"))


def last_iterations(df: DataFrame, by: tuple[str, ...] = ("trial_id",), step: str = "iteration") -> DataFrame:
    return last_per(df, list(by), [step])


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as JSON by step, split and task."""
    df.write.partitionBy("step", "split", "task").json(path)
