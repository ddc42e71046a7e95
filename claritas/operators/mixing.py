"""Multi-task mixes. Input rows carry (task, pos) with pos = 0, 1, ... inside each task.

The place of every row in the mix follows from its position and the task sizes, so a mix is
a filter and arithmetic. Only the sizes of the listed tasks reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("balanced", "concatenate", "first_exhausted", "all_exhausted")
ROUNDS_PER_ROW = 4096


def task_sizes(df: DataFrame, tasks: list[str]) -> dict[str, int]:
    counts = df.where(F.col("task").isin(tasks)).groupBy("task").count().collect()
    found = {r["task"]: r["count"] for r in counts}
    return {t: found.get(t, 0) for t in tasks}


def mix(df: DataFrame, tasks: list[str], strategy: str = "balanced") -> DataFrame:
    """Rows of the mix with their place `mix_pos`."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    sizes = task_sizes(df, tasks)
    by_task = {t: i for i, t in enumerate(tasks)}

    def per_task(values: dict[str, int]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("task"))

    rows = df.where(F.col("task").isin(tasks))
    place, width, smallest = per_task(by_task), len(tasks), min(sizes.values())
    if strategy == "concatenate":
        starts, total = {}, 0
        for t in tasks:
            starts[t], total = total, total + sizes[t]
        return rows.withColumn("mix_pos", per_task(starts).cast("long") + F.col("pos"))
    if strategy == "balanced":
        return rows.where(F.col("pos") < smallest).withColumn("mix_pos", place.cast("long") * smallest + F.col("pos"))
    if strategy == "first_exhausted":
        return rows.where(F.col("pos") < smallest).withColumn("mix_pos", F.col("pos") * width + place)
    return _all_exhausted(rows, sizes, per_task, place, width)


def _all_exhausted(rows: DataFrame, sizes: dict[str, int], per_task, place, width: int) -> DataFrame:
    """Round-robin until the longest task ends; row `pos` comes back every `size` rounds.

    A row of a tiny task may return very often, so its rounds are listed in chunks and the
    chunks are spread before they unfold.
    """
    longest, shortest = max(sizes.values()), min(sizes.values())
    if shortest == 0:
        raise ValueError("a task without rows cannot be interleaved")
    times = F.floor((F.lit(longest - 1).cast("long") - F.col("pos")) / F.col("_size")) + 1
    work = rows.withColumn("_size", per_task(sizes).cast("long")).withColumn("_times", times)
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / ROUNDS_PER_ROW))
    work = work.withColumn("_chunk", F.explode(chunks))
    if longest // shortest >= ROUNDS_PER_ROW:
        work = work.repartition(F.col("task"), F.col("pos"), F.col("_chunk"))
    first = F.col("_chunk") * ROUNDS_PER_ROW
    last = F.least(first + ROUNDS_PER_ROW, F.col("_times")) - 1
    work = work.withColumn("_turn", F.explode(F.sequence(first, last)))
    rounds = F.col("pos") + F.col("_turn") * F.col("_size")
    return work.withColumn("mix_pos", rounds * width + place).drop("_size", "_times", "_chunk", "_turn")
