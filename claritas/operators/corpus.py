"""Pair corpora: canonical columns, task ids, task and split selection, scans in order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritas.functions.text import clean_brackets
from claritas.operators.numbering import number_rows

SPLITS = ("train", "validation", "test")


def canonical(df: DataFrame, rename: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Rename to `src`/`dst` and drop columns that may or may not be there."""
    return df.drop(*drop).withColumnsRenamed(rename)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def matching(df: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns whose name matches `pattern`, after the `keep` columns."""
    return df.select(*keep, *[F.col(f"`{c}`") for c in df.columns if c not in keep and re.search(pattern, c)])


def other_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in df.columns if c not in set(columns)]


def rename_part(df: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a piece of text in all column names."""
    return df.toDF(*[c.replace(old, new) for c in df.columns])


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean_brackets(F.col(c)) for c in columns})


def assign_positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return number_rows(df, by, order)


def assign_task_ids(df: DataFrame, tasks: list[str] | None = None, mapping: dict[str, int] | None = None) -> DataFrame:
    """`task_id` by place in `tasks`, or by `mapping`; null when unmapped."""
    ids = mapping if mapping is not None else {t: i for i, t in enumerate(tasks or [])}
    pairs = [F.lit(x) for pair in ids.items() for x in pair]
    lookup = F.try_element_at(F.create_map(*pairs), F.col("task")) if pairs else F.lit(None)
    return df.withColumn("task_id", lookup.cast("int"))


def in_tasks(chosen: dict[str, list[str]]) -> Column:
    """Rows whose task is listed for their split; plain filters, so partitions are pruned."""
    parts = [(F.col("split") == s) & F.col("task").isin(list(t)) for s, t in chosen.items() if t]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def select_tasks(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    return df.where(in_tasks(chosen))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("pos") < n)


def all_tasks(*lists: list[str]) -> list[str]:
    """Union of task lists, first mention first."""
    return list(dict.fromkeys(t for tasks in lists for t in tasks))


def task_union(train: Column, validation: Column, test: Column) -> Column:
    return F.array_distinct(F.concat(train, validation, test))


def test_files_first(df: DataFrame, file: str, pos: str) -> DataFrame:
    """Scan order: files named after the test part, then the others."""
    return df.withColumn("scan_group", F.when(F.col(file).contains("test"), 0).otherwise(1)).orderBy("scan_group", file, pos)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"))


def smallest_task(df: DataFrame) -> DataFrame:
    return df.groupBy("task").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n_min"))
