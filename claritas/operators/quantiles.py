"""Exact group statistics: percentiles by ranks, describe tables, box-plot numbers.

The built-in exact percentile keeps all distinct values of a group in one buffer. Here
values are counted once, stored, and cut into ordered buckets. Bucket totals tell which
buckets hold a wanted rank, and only those are sorted, so a group of any size stays spread
over the cluster and the input is read a single time. Where all stored counts together are few, they
need no buckets: each group is ranked by a window, in one job with one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claritas.operators.numbering import same_keys, value_buckets
from claritas.session import written, written_and_counted

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _ranks(share: float) -> tuple[Column, Column, Column]:
    """Zero-based ranks below and above the wanted place, and the place."""
    place = F.lit(float(share)) * (F.col("_size") - 1)
    return F.floor(place), F.ceil(place), place


def _covers(first: Column, n: Column, rank: Column) -> Column:
    return (first <= rank) & (rank < first + n)


GROUPS_TO_SHIP = 100_000


def _small(df: DataFrame) -> DataFrame:
    """A table of one row per group: sent to all tasks where it is small, so the other side stays in place."""
    kept = written(df, "groups")
    return F.broadcast(kept) if kept.count() <= GROUPS_TO_SHIP else kept


FEW_COUNTS = 1 << 19  # rows (group, value, count) that one task can sort


def _value_counts(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, int]:
    """Counts of the values, one row with a null value for unknown ones; and the number of rows."""
    number = F.col(value).cast("double")
    counted = df.groupBy(*by, F.when(~F.isnan(number), number).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return written_and_counted(counted, "value-counts")


def _cut(counted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bucketed counts of the known values, and the groups (also those without a known value)."""
    return value_buckets(counted.where("_v IS NOT NULL"), "_v", "_bucket"), counted.select(*by).distinct()


def _ranked(counted: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Every value with the size, mean and percentiles of its group, by windows over one partitioning."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = counted.withColumn("_n", F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    size = F.sum("_n").over(group)
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_size": size, "mean": F.sum(F.col("_v") * F.col("_n")).over(group) / F.nullif(size, F.lit(0)), "_first": upto - F.col("_n")})
    return _between(rows.withColumns({name: c.over(group) for name, c in _picks(shares).items()}), shares)


def _bucket_table(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per (group, bucket): rows before and inside; per group: size, sum, range. Small: buckets are few."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    preceding = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(*by, "_bucket").agg(
        F.sum("_n").alias("_inside"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    return buckets.withColumns(
        {
            "_before": F.coalesce(F.sum("_inside").over(preceding), F.lit(0)),
            "_size": F.sum("_inside").over(group),
            "mean": F.sum("_sum").over(group) / F.sum("_inside").over(group),
            "min": F.min("_low").over(group),
            "max": F.max("_high").over(group),
        }
    )


def _at_ranks(counts: DataFrame, buckets: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles from the buckets that hold a wanted rank; the other values are not sorted."""
    hit = F.lit(False)
    for share in shares.values():
        low, high, _ = _ranks(share)
        hit = hit | _covers(F.col("_before"), F.col("_inside"), low) | _covers(F.col("_before"), F.col("_inside"), high)
    wanted = buckets.where(hit).select(*by, "_bucket", "_before", "_size")
    inner = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = same_keys(counts, wanted, [*by, "_bucket"])
    ranked = ranked.withColumn("_first", F.col("_before") + F.sum("_n").over(inner) - F.col("_n"))
    found = ranked.groupBy(*by).agg(F.max("_size").alias("_size"), *[c.alias(name) for name, c in _picks(shares).items()])
    return _between(found, shares).select(*by, *shares)


def _picks(shares: dict[str, float]) -> dict[str, Column]:
    """Aggregates that give the values at the ranks around each wanted place."""
    out = {}
    for name, share in shares.items():
        low, high, _ = _ranks(share)
        for side, rank in (("lo", low), ("hi", high)):
            out[f"_{side}_{name}"] = F.max(F.when(_covers(F.col("_first"), F.col("_n"), rank), F.col("_v")))
    return out


def _between(found: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Interpolate linearly between the picked values."""
    for name, share in shares.items():
        low, _, place = _ranks(share)
        step = F.col(f"_hi_{name}") - F.col(f"_lo_{name}")
        found = found.withColumn(name, F.col(f"_lo_{name}") + step * (place - low))
    return found


def _every_group(groups: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    return same_keys(groups, found, by, "left") if by else found


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles; `shares` maps output name to share in [0, 1].

    A null key is a group; a group without a known value has null percentiles.
    """
    counted, n = _value_counts(df, by, value)
    if n <= FEW_COUNTS:
        return _ranked(counted, by, shares).groupBy(*by).agg(*[F.max(name).alias(name) for name in shares])
    counts, groups = _cut(counted, by)
    return _every_group(groups, _at_ranks(counts, _bucket_table(counts, by), by, shares), by)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of `value` per group.

    A null key is a group; a group without a known value has n = 0 and nulls.
    """
    counted, n = _value_counts(df, by, value)
    if n <= FEW_COUNTS:
        return _described(_ranked(counted, by, QUARTILES), by)
    counts, groups = _cut(counted, by)
    buckets = _bucket_table(counts, by)
    totals = _small(buckets.select(*by, "_size", "mean", "min", "max").distinct())
    distance = F.col("_v") - F.col("mean")
    moments = (
        same_keys(counts, totals, by)
        .groupBy(*by)
        .agg(
            F.max("_size").alias("n"),
            F.max("mean").alias("mean"),
            F.sum(distance * distance * F.col("_n")).alias("_squares"),
            F.max("min").alias("min"),
            F.max("max").alias("max"),
        )
    )
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1)))
    quartiles = _at_ranks(counts, buckets, by, QUARTILES)
    joined = same_keys(moments.withColumn("std", std), quartiles, by)
    joined = _every_group(groups, joined, by).withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(*by, "n", "mean", "std", "min", "q25", "median", "q75", "max")


def _described(ranked: DataFrame, by: list[str]) -> DataFrame:
    distance = F.col("_v") - F.col("mean")
    found = ranked.groupBy(*by).agg(
        F.coalesce(F.max("_size"), F.lit(0)).alias("n"),
        F.max("mean").alias("mean"),
        F.sum(distance * distance * F.col("_n")).alias("_squares"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        *[F.max(name).alias(name) for name in QUARTILES],
    )
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1)))
    return found.withColumn("std", std).select(*by, "n", "mean", "std", "min", "q25", "median", "q75", "max")


BOX = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _fenced(quartiles: DataFrame) -> DataFrame:
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.withColumn("fence_low", F.col("q1") - reach).withColumn("fence_high", F.col("q3") + reach)


def box_fences(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and the 1.5 x IQR fences per group."""
    return _fenced(percentiles(df, by, value, BOX))


def box_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers (outermost values inside the fences), outlier count.

    All from the value counts, in one pass over the rows. A null key is a group; a group without a known
    value has nulls and no outliers.
    """
    counted, n = _value_counts(df, by, value)
    if n <= FEW_COUNTS:
        return _boxes(_fenced(_ranked(counted, by, BOX)), by)
    counts, groups = _cut(counted, by)
    fences = _small(_fenced(_at_ranks(counts, _bucket_table(counts, by), by, BOX)))
    found = _boxes(same_keys(counts, fences, by), by)
    return _every_group(groups, found, by).withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))


def _boxes(fenced: DataFrame, by: list[str]) -> DataFrame:
    """From values with the quartiles and fences of their group."""
    inside = F.col("_v").between(F.col("fence_low"), F.col("fence_high"))
    return fenced.groupBy(*by).agg(
        *[F.max(name).alias(name) for name in BOX],
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(inside | F.col("_v").isNull(), F.lit(0)).otherwise(F.col("_n"))), F.lit(0)).alias("n_outliers"),
    )


def outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows outside the fences of their group."""
    fenced = same_keys(df, _small(box_fences(df, by, value)), by)
    return fenced.where(~F.col(value).between(F.col("fence_low"), F.col("fence_high"))).select(*df.columns)
