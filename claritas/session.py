"""Session helpers: suggested settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

SUGGESTED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "claritas", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SUGGESTED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for tables written between stages.

    The cluster names it in ``spark.checkpoint.dir``; otherwise it lies below the warehouse, which all
    executors share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/claritas/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """Cut the lineage of `df` by a table in the scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_counted(df, name: str):
    """`written`, and the number of rows, which the write itself counts."""
    seen = Observation()
    return written(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
