"""A versioned snapshot of vectors that only encodes what is new or changed.

    <path>/vectors/segment=<v>    key columns, row_hash, embedding: what version v encoded
    <path>/manifest/version=<v>   key columns, row_hash, segment: every live key of version v
    <path>/rows/version=<v>       one row with the number of live keys, written last

A version counts once its `rows` are written, so a run that breaks leaves the version before it in place,
and its files are overwritten by the next run. Segments and manifests are never changed: readers of an
older version keep what they read. One writer at a time. Keys are unique and not null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Refresh:
    """What a run found: the version now current, and the keys it kept, encoded and dropped."""

    version: int
    kept: int
    encoded: int
    gone: int


def row_hash(columns: list[str]) -> Column:
    """Hash of the named values and of which of them are null."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def current_version(spark: SparkSession, path: str) -> int:
    """The newest complete version, 0 if there is none."""
    try:
        return spark.read.schema("n long, version int").parquet(f"{path}/rows").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/version={version}")


def vectors(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Live vectors of a version (default: the current one), with the `segment` that holds each."""
    version = current_version(spark, path) if version is None else version
    if not version:
        raise ValueError(f"no complete version at {path}")
    live = manifest(spark, path, version)
    return spark.read.parquet(f"{path}/vectors").where(F.col("segment") <= version).join(live, live.columns)


def refresh(rows: DataFrame, path: str, keys: list[str], encode: Callable[[DataFrame], DataFrame], content: list[str] | None = None) -> Refresh:
    """Bring the index at `path` to `rows`: `encode` adds `embedding` to the rows it is given.

    It is given the rows whose key is new or whose `content` (default: all other columns) has another
    hash than in the current version; keys that `rows` lacks go. Nothing is written if nothing differs.
    """
    spark = rows.sparkSession
    content = [c for c in rows.columns if c not in keys] if content is None else content
    before = current_version(spark, path)
    now, match = rows.withColumn("row_hash", row_hash(content)), [*keys, "row_hash"]
    version = before + 1
    old = manifest(spark, path, before) if before else None
    changed = now if old is None else now.join(old.select(*match), match, "left_anti")
    encode(changed).select(*match, "embedding").write.mode("overwrite").parquet(f"{path}/vectors/segment={version}")
    fresh = spark.read.parquet(f"{path}/vectors/segment={version}").select(*match, F.lit(version).alias("segment"))
    encoded = fresh.count()
    n_old = old.count() if before else 0
    if before:
        kept = old.join(now.select(*match), match, "left_semi")
        n_kept = kept.count()
        if not encoded and n_kept == n_old:
            return Refresh(before, n_kept, 0, 0)
        fresh, replaced = kept.unionByName(fresh), old.select(*keys).join(fresh.select(*keys), keys, "left_semi").count()
    else:
        n_kept = replaced = 0
    fresh.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    spark.range(1).select(F.lit(n_kept + encoded).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/rows/version={version}")
    return Refresh(version, n_kept, encoded, n_old - n_kept - replaced)
