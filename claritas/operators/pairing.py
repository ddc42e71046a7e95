"""Source/target pairs: chat neighbours, row-aligned triples, joins on position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.operators.numbering import with_next


def pair_turns(turns: DataFrame, dense: bool = False) -> DataFrame:
    """A user turn as `src` with the next turn as `ref`, when that is the assistant's.

    `dense` says that `turn` counts the turns of a conversation without gaps.
    """
    both = with_next(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", ["role", "text"], dense)
    return both.where("role = 'user' AND next_role = 'assistant'").select(
        "conv_id",
        "turn",
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"),
        F.col("text").alias("src"),
        F.col("next_text").alias("ref"),
    )


def align(sources: DataFrame, references: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(src, ref, pred) rows by position; a key missing on any side is an error."""
    sides = sources.join(references, keys, "full_outer").join(predictions, keys, "full_outer")
    missing = F.col("src").isNull() | F.col("ref").isNull() | F.col("pred").isNull()
    failed = F.raise_error(F.concat(F.lit("unaligned row "), F.to_json(F.struct(*keys)))).cast("int")
    # in a filter: the check holds whichever columns are read
    return sides.where(F.when(missing, failed).otherwise(F.lit(1)) == 1)


def beside(base: DataFrame, columns: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Put one value column per named frame next to `base`, by key."""
    for name, frame in columns.items():
        base = base.join(frame.select(*keys, F.col(value).alias(name)), keys)
    return base
