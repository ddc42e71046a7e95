"""Long/wide changes of shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str, value: str) -> DataFrame:
    """Columns to rows; null cells stay."""
    return df.unpivot(ids, values, variable, value)


def widen(df: DataFrame, ids: list[str], variable: str, value: str, names: list[str]) -> DataFrame:
    """Rows to columns for a given list of names; the pivot column is unique per id. Another name is an error."""
    failed = F.raise_error(F.concat(F.lit(f"{variable} not listed: "), F.coalesce(F.col(variable).cast("string"), F.lit("null"))))
    # in a filter: the check holds whichever columns are read
    df = df.where(F.when(F.col(variable).isin(names), F.lit(1)).otherwise(failed.cast("int")) == 1)
    return df.groupBy(*ids).pivot(variable, names).agg(F.max(value))


def explode_together(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per position of several equally long arrays; unequal lengths are an error."""
    sizes = [F.size(c) for c in columns]
    equal = F.lit(True)
    for size in sizes[1:]:
        equal = equal & (size == sizes[0])
    zipped = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("arrays differ in length")))
    others = [c for c in df.columns if c not in columns]
    exploded = df.select(*others, F.posexplode(zipped).alias("pos", "_row"))
    return exploded.select(*others, F.col("pos").cast("long").alias("pos"), *[F.col("_row")[c].alias(c) for c in columns])


def aligned_lists(df: DataFrame, by: list[str], pos: str, columns: list[str], chunk: int = 1000) -> DataFrame:
    """Row-aligned arrays per group, in chunks of at most `chunk` positions.

    All rows are kept; a group longer than a chunk continues in the next row.
    """
    rows = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([pos, *columns]))))
    packed = df.withColumn("chunk", F.floor(F.col(pos) / chunk)).groupBy(*by, "chunk").agg(rows.alias("_rows"))
    return packed.select(*by, "chunk", *[F.col("_rows")[c].alias(c) for c in columns])


def records_to_lists(df: DataFrame, pos: str, record: str, keys: list[str], chunk: int = 1000) -> DataFrame:
    """Map-typed records to one array per key; a record without a key is an error."""
    for key in keys:
        missing = F.raise_error(F.lit(f"record lacks {key}")).cast(df.schema[record].dataType.valueType)
        got = F.try_element_at(F.col(record), F.lit(key))
        df = df.withColumn(key, F.when(F.map_contains_key(F.col(record), key), got).otherwise(missing))
    return aligned_lists(df, [], pos, keys, chunk)


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested records to `a/b` columns."""

    def leaves(schema: T.StructType, column: Column | None, prefix: str):
        for field in schema.fields:
            inner = F.col(f"`{field.name}`") if column is None else column[field.name]
            name = f"{prefix}{field.name}"
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, inner, name + separator)
            else:
                yield inner.alias(name)

    return df.select(*leaves(df.schema, None, ""))
