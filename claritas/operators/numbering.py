"""Row numbers and running sums that stay distributed when one group holds most rows.

A plain window sorts a whole group in one task. Here each group is cut into ordered
buckets of the sort key first: bucket sums are small, their running sum gives every bucket
its offset, and the window runs inside (group, bucket). Bucket borders are values, not
partition numbers, so a recomputed task puts every row in the same bucket again.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritas.operators.text_order import text_borders, text_bucket
from claritas.session import shuffle_width

HEX_DIGITS = 13  # 52 bits: exact in a double
_LEAD, _TIE, _B1, _B2, _W, _BEFORE = "_lead", "_tie", "_bucket", "_sub", "_weight", "_before"


def hash_order(seed, *keys) -> Column:
    """Reproducible random order: md5 of the seed and the keys, as hex text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))


def hex_lead(hash_col: str) -> Column:
    """Leading digits of a hex hash as a number that sorts alike."""
    return F.conv(F.substring(hash_col, 1, HEX_DIGITS), 16, 10).cast("double")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where a null key meets a null key; the columns of `right` that are no keys are added."""
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(k).alias(n) for k, n in named.items()], *[c for c in right.columns if c not in named])
    match = F.lit(True)
    for k, n in named.items():
        match = match & left[k].eqNullSafe(right[n])
    return left.join(right, match, how).drop(*named.values())


def sort_number(df: DataFrame, column: str) -> Column:
    """A number that sorts like the column. Local times are counted without any time zone. Texts have
    borders of their own (`text_order`); other types than these are an error."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"no order of {kind.simpleString()} column {column}; give `lead`")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def _borders(df: DataFrame, column: str, buckets: int) -> tuple[list[float], set[float]]:
    """At most `buckets` border values, and the values frequent enough to fill a bucket alone."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, 10 * buckets)).first()[0] or []
    found = [v for v in found if not (math.isnan(v) or math.isinf(v))]
    frequent = {v for v, n in Counter(found).items() if n > 1}
    borders = set(found) | {math.nextafter(v, math.inf) for v in frequent}
    return sorted(borders), frequent


def _bucketed(df: DataFrame, source: str, target: str, borders: list[float]) -> DataFrame:
    if not borders:
        return df.withColumn(target, F.lit(0.0))
    cut = Bucketizer(splits=[-math.inf, *borders, math.inf], inputCol=source, outputCol=target, handleInvalid="keep")
    return cut.transform(df)


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _by_text(df: DataFrame, column: str, target: str, buckets: int, where: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Buckets over the texts of a column (null first; all rows outside `where` come before them)."""
    borders, frequent = text_borders(df if where is None else df.where(where), column, buckets)
    number = F.coalesce(text_bucket(F.col(column), borders), F.lit(-1))
    return df.withColumn(target, (number if where is None else F.when(where, number).otherwise(F.lit(-2))).cast("double")), frequent


def bucket_count(df: DataFrame) -> int:
    return max(16, 4 * shuffle_width(df.sparkSession))


def value_buckets(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ordered buckets of about equal size over the values of a numeric column."""
    borders, _ = _borders(df, column, bucket_count(df))
    return _bucketed(df, column, name, borders)


def running_total(
    df: DataFrame,
    by: list[str],
    order: list[str],
    weight: Column | str | None = None,
    name: str = "running",
    lead: Column | None = None,
    uniform: tuple[float, float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sum of `weight` (default 1) inside each `by` group.

    `order` sorts ascending and must be unique inside a group. A null in a `by` column is a group of its own.
    `lead` is a number that sorts like the first order column (default: its cast). `uniform`
    gives the range of an evenly spread lead, such as a hash, and saves the pass for borders.
    """
    weight = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    buckets = buckets or bucket_count(df)
    if lead is None and _is_text(df, order[0]):
        work, frequent = _by_text(df.withColumn(_W, weight.cast("long")), order[0], _B1, buckets)
        alone = F.col(order[0]).isin(frequent)
    else:
        lead = sort_number(df, order[0]) if lead is None else lead
        work = df.withColumn(_LEAD, F.coalesce(lead, F.lit(-math.inf))).withColumn(_W, weight.cast("long"))
        if uniform:
            low, high = uniform
            borders, frequent = [low + (high - low) * i / buckets for i in range(1, buckets)], set()
        else:
            borders, frequent = _borders(work, _LEAD, buckets)
        work = _bucketed(work, _LEAD, _B1, borders)
        alone = F.col(_LEAD).isin(sorted(frequent))
    work = work.withColumn(_B2, F.lit(0.0))
    if frequent and len(order) > 1:
        # A frequent value owns its bucket, so the second key can split it and keep the order.
        work = work.drop(_B2)
        if _is_text(df, order[1]):
            work, _ = _by_text(work, order[1], _B2, buckets, alone)
        else:
            work = work.withColumn(_TIE, F.when(alone, sort_number(df, order[1])).otherwise(F.lit(-math.inf)))
            ties, _ = _borders(work.where(alone), _TIE, buckets)
            work = _bucketed(work, _TIE, _B2, ties).drop(_TIE)
    keys = [*by, _B1, _B2]
    outer = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = (
        work.groupBy(*keys)
        .agg(F.sum(_W).alias("_in_bucket"))
        .withColumn(_BEFORE, F.sum("_in_bucket").over(outer.orderBy(_B1, _B2).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, F.coalesce(_BEFORE, F.lit(0)).alias(_BEFORE))
    )
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        same_keys(work.withColumn("_local", F.sum(_W).over(inner)), offsets, keys)
        .withColumn(name, F.col(_BEFORE) + F.col("_local"))
        .select(*[c for c in df.columns if c != name], name)
    )


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str = "pos", start: int = 0, **options) -> DataFrame:
    """Row number from `start` in `order` inside each `by` group."""
    return running_total(df, by, order, name=name, **options).withColumn(name, F.col(name) + (start - 1))


def number_by_hash(df: DataFrame, by: list[str], seed, keys: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Row number in seeded random order; hashes spread evenly, so no pass for borders."""
    work = df.withColumn("_hash", hash_order(seed, *keys))
    out = number_rows(
        work, by, ["_hash", *keys], name=name, start=start, lead=hex_lead("_hash"), uniform=(0.0, float(16**HEX_DIGITS))
    )
    return out.drop("_hash")


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First `n` rows per group. Spark cuts each partition to n rows per group before the shuffle."""
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def with_next(df: DataFrame, by: list[str], order: str, columns: list[str], dense: bool = False) -> DataFrame:
    """Add `next_<column>` from the following row of the group (inner: last rows drop out).

    An equi-join on (group, position + 1), so a long group is spread over all tasks. With
    `dense` the order column itself is a gapless position and no numbering is needed.
    """
    work = df.withColumn("_at", F.col(order)) if dense else number_rows(df, by, [order], name="_at")
    following = work.select(*by, (F.col("_at") - 1).alias("_at"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return work.join(following, [*by, "_at"]).drop("_at")
