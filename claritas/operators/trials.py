"""Experiment logs: long rows (run, step, metric, value) and run constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritas.operators.numbering import sort_number, top_rows


def number(c) -> Column:
    """NaN counts as missing: Spark would rank it above every number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def sortable(value, mode: str = "max") -> Column:
    """`value` so that larger is better."""
    return number(value) if mode == "max" else -number(value)


def with_constants(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def last_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest full row per group."""
    rest = [c for c in df.columns if c not in by]
    newest = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*by, "_row.*")


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    oldest = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return oldest.select(*by, "_row.*")


def fold_last(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Merge a history of records: later entries win."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def mean_std(df: DataFrame, by: list[str], value: str, digits: int | None = 2) -> DataFrame:
    """Mean and sample deviation; one row alone has no deviation.

    Nine digits first: a sum in another order must not fall on the other side of a half.
    """
    mean, std = F.avg(number(value)), F.stddev_samp(number(value))
    if digits is not None:
        mean, std = F.round(F.round(mean, 9), digits), F.round(F.round(std, 9), digits)
    return df.groupBy(*by).agg(F.count(number(value)).alias("n"), mean.alias("mean"), std.alias("std"))


def arg_best(df: DataFrame, by: list[str], keys: list[str], value: str, mode: str = "max") -> DataFrame:
    """The `keys` of the best value per group; the smaller keys win ties, missing values never win."""
    scored = df.where(number(value).isNotNull())
    best = F.min_by(F.struct(*keys, F.col(value).alias("best")), F.struct((-sortable(value, mode)).alias("_s"), *keys))
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(best.alias("_best")).where("_best is not null").select(*by, "_best.*")


def best_or_first(df: DataFrame, by: list[str], score: str, pos: str) -> DataFrame:
    """The best row per group; its first row when no row has a score."""
    value = number(score)
    order = F.struct(value.isNull().alias("_missing"), (-value).alias("_score"), F.col(pos))
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*by, "_row.*")


def same_config(df: DataFrame, config: list[str], score: str, pos: str, mode: str = "max") -> DataFrame:
    """Trials whose every config column equals the best trial's; null equals null."""
    best = arg_best(df.withColumn("_config", F.struct(*config)), [], [pos, "_config"], score, mode)
    best = best.select(*[F.col("_config")[c].alias(f"_best_{c}") for c in config])
    condition = F.lit(True)
    for c in config:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_best_{c}"))
    return df.join(best, condition, "left_semi")


def keep_best(df: DataFrame, by: list[str], score: str, n: int, ties: list[str], mode: str = "max") -> DataFrame:
    order = [sortable(score, mode).desc_nulls_last(), *[F.col(t) for t in ties]]
    return top_rows(df, by, order, n)


def best_row(df: DataFrame, score: str, ties: list[str], mode: str = "max") -> DataFrame:
    """The top row overall: a top-k sort, no full sort."""
    return df.orderBy(sortable(score, mode).desc_nulls_last(), *ties).limit(1)


def mark_best(df: DataFrame, metric: str, model: str, value: str, ties: list[str]) -> DataFrame:
    """Flags: best row of the metric over all models, best row of the metric in its model.

    Winners come from two aggregates; no window has to sort a whole metric.
    """
    out = df
    for flag, by in (("best_overall", [metric]), ("best_in_model", [metric, model])):
        row = F.struct(*[F.col(t).alias(t) for t in ties])
        best = arg_best(df.withColumn("_key", row), by, ["_key"], value).select(*by, F.col("_key").alias("_winner"))
        out = out.join(best, by, "left")
        hit = number(value).isNotNull()
        for t in ties:
            hit = hit & F.col(t).eqNullSafe(F.col("_winner")[t])
        out = out.withColumn(flag, hit & F.col("_winner").isNotNull()).drop("_winner")
    return out


def mark_top_two(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`mark` 1 on rows that equal the maximum, 2 on rows that equal the largest value below it."""
    distinct = df.where(number(value).isNotNull()).select(*by, F.col(value).alias("_v")).distinct()
    ranked = top_rows(distinct, by, [F.col("_v").desc()], 2, name="mark").withColumnRenamed("_v", value)
    return df.join(ranked, [*by, value], "left")


def ordered(df: DataFrame, column: Column | str, wanted: list, name: str, keep_others: bool = True) -> DataFrame:
    """Rank by place in a list; values outside the list sort last or are dropped."""
    column = F.col(column) if isinstance(column, str) else column
    rank = F.array_position(F.array(*[F.lit(w) for w in wanted]), column).cast("int")
    df = df.withColumn(name, F.when(rank > 0, rank - 1))
    return df if keep_others else df.where(F.col(name).isNotNull())


def grid(df: DataFrame, axes: dict[str, list], repeats: int = 1) -> DataFrame:
    """Attach every grid point (and repeat) to every row, by explode of literal lists."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) if repeats > 1 else df


def missing_runs(expected: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(trials.select(*keys).distinct(), keys, "left_anti")


def expected_runs(models: DataFrame, method_tasks: DataFrame, on: str = "kind") -> DataFrame:
    """Valid (model, method, tasks): the task lists depend on the method a model allows."""
    return models.join(method_tasks, on)


def throughput(df: DataFrame, by: list[str], start: str, end: str, batch: int) -> DataFrame:
    """Samples and steps per second of each group from time stamps; a step handles `batch` rows."""
    rows = F.count(F.lit(1))
    seconds = (F.max(sort_number(df, end)) - F.min(sort_number(df, start))) / 1e6
    totals = df.groupBy(*by).agg(rows.alias("n_samples"), F.ceil(rows / batch).alias("n_steps"), seconds.alias("seconds"))
    return totals.withColumns(
        {
            "samples_per_second": F.try_divide(F.col("n_samples").cast("double"), F.col("seconds")),
            "steps_per_second": F.try_divide(F.col("n_steps").cast("double"), F.col("seconds")),
        }
    )


def parameter_names(name: Column, info: Column) -> Column:
    """`params_summary_{name}_{info}`, lower case, blanks to underscores."""
    return F.replace(F.lower(F.concat_ws("_", F.lit("params_summary"), name, info)), F.lit(" "), F.lit("_"))
