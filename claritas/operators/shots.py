"""Order and number the examples of a prompt. A query has at most k examples per task, so
windows and lists per query stay small however many queries there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claritas.functions import fixed
from claritas.operators.human import lookup
from claritas.operators.numbering import hash_order

METHODS = ("shuffle", "sort_similarity_ascending", "sort_similarity_descending", "alternating_tasks", "successive_tasks")
_LATE = 1 << 30


def _place(tasks: list[str] | None) -> Column:
    """Place of the task in the list, null when not listed."""
    if not tasks:
        return F.lit(None).cast("int")
    listed = F.array_position(F.array(*[F.lit(t) for t in tasks]), F.col("task"))
    return F.nullif(listed, F.lit(0)).cast("int")


def retrieval_order(found: DataFrame, tasks: list[str]) -> DataFrame:
    """Examples as retrieved: task by task in the listed order, best first."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce(_place(tasks), F.lit(_LATE)), "task", "rank")
    return found.withColumn("retrieved", F.row_number().over(order))


def order_shots(df: DataFrame, method: str, tasks: list[str] | None = None, seed=0) -> DataFrame:
    """Add the 1-based place `shot` by one of the ordering methods; rows carry `retrieved`."""
    if method not in METHODS:
        raise ValueError(f"unknown ordering method {method}")
    if method == "successive_tasks" and tasks is None:
        raise ValueError("successive_tasks needs a task order")
    per_query = Window.partitionBy("query_id")
    late = F.lit(_LATE)
    if method == "shuffle":
        keys = [hash_order(seed, "query_id", "item_id"), F.col("retrieved")]
    elif method == "sort_similarity_ascending":
        keys = [F.col("similarity"), F.col("retrieved")]
    elif method == "sort_similarity_descending":
        keys = [F.col("similarity").desc(), F.col("retrieved")]
    elif method == "successive_tasks":
        keys = [F.coalesce(_place(tasks), late), F.col("retrieved")]
    else:
        in_task = Window.partitionBy("query_id", "task")
        # Tasks outside the list take their turn after the listed ones, first seen first.
        df = df.withColumn("_turn", F.row_number().over(in_task.orderBy("retrieved"))).withColumn(
            "_task", F.coalesce(_place(tasks), late + F.min("retrieved").over(in_task))
        )
        untold = F.col("task").isNull()
        keys = [untold, F.when(untold, F.col("retrieved")).otherwise(F.col("_turn")), F.col("_task")]
    out = df.withColumn("shot", F.row_number().over(per_query.orderBy(*keys)))
    return out.drop("_turn", "_task")


def rename_tasks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Display names; a task without one keeps its own. Runs after ordering."""
    return df.withColumn("task", F.coalesce(lookup(names, "task"), F.col("task")))


def renamed_order(tasks: list[str], names: dict[str, str]) -> list[str]:
    return list(dict.fromkeys(names.get(t, t) for t in tasks))


def shot_text(number: Column, task: Column, source: Column, target: Column) -> Column:
    mark = fixed.ANSWER_MARK
    return F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.SHOT_HEADING), number.cast("string")),
        F.concat(F.lit(fixed.TASK_LABEL), F.coalesce(task, F.lit("None"))),
        F.concat(F.lit(fixed.INPUT_LABEL), source),
        F.concat(F.lit(f"{fixed.OUTPUT_LABEL}{mark}"), target, F.lit(mark)),
    )


def early_shot_text(number: Column, source: Column, target: Column) -> Column:
    """Prototype wording; `number` starts at 0."""
    mark = fixed.ANSWER_MARK
    return F.concat(
        F.lit(fixed.EARLY_HEADING), number.cast("string"), F.lit("\n" + fixed.EARLY_SOURCE_LABEL + '"'), source,
        F.lit('"\n' + fixed.EARLY_TARGET_LABEL + mark), target, F.lit(mark + "\n\n"),
    )


def render_shots(df: DataFrame, separator: str = "\n") -> DataFrame:
    """One text per query from rows with (shot, shot_text)."""
    ordered = F.array_sort(F.collect_list(F.struct("shot", "shot_text")))
    return df.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["shot_text"]), separator).alias("shots"))


def with_content(found: DataFrame, texts: DataFrame, keys: list[str], needed: list[str]) -> DataFrame:
    """Retrieved examples with their texts; an example without one is an error, not a missing row."""
    joined = found.join(texts, keys, "left")
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in needed], F.lit(0)) == 1
    failed = F.raise_error(F.concat(F.lit("no text for example "), F.to_json(F.struct(*keys)))).cast("int")
    # in a filter: the check holds whichever columns are read
    return joined.where(F.when(missing, failed).otherwise(F.lit(1)) == 1)
