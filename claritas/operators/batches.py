"""Padded batches of token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claritas.functions.token_arrays import attention_mask, pad, truncate


def pad_batches(df: DataFrame, tokens: str, size: int, pad_id: int, side: str = "right", pos: str = "pos", by: list[str] = ()) -> DataFrame:
    """Pad every array to the longest of its batch of `size` neighbouring positions."""
    work = df.withColumn("batch", F.floor(F.col(pos) / size))
    width = F.max(F.size(tokens)).over(Window.partitionBy(*by, "batch"))
    work = work.withColumn("_width", width)
    return work.withColumns(
        {
            "attention_mask": attention_mask(F.col(tokens), F.col("_width"), side),
            "input_ids": pad(F.col(tokens), F.col("_width"), pad_id, side),
        }
    ).drop("_width")


def truncate_pairs(df: DataFrame, source: str, target: str, input_max_length: int, output_max_length: int) -> DataFrame:
    """Source tokens as `input_ids`, target tokens as `labels`, each cut to the length asked for."""
    return df.withColumns({"input_ids": truncate(F.col(source), input_max_length), "labels": truncate(F.col(target), output_max_length)})
