"""Live tables over a stream of log events (run, metric, ts, step, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claritas.operators.trials import sortable
from claritas.session import scratch_path


def as_instant(c: Column) -> Column:
    """A local time read as UTC, whatever the session zone: watermarks need instants."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c))


def as_local(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01").cast("timestamp_ntz"))


def metric_board(log: DataFrame, delay: str = "1 day", period: str | None = None) -> DataFrame:
    """Newest value per (run, metric), and per period when one is given.

    State: with a `period`, periods older than the watermark are dropped. Without one the state is one row
    per (run, metric) and grows with the number of runs; `ended_runs_leave` drops runs that have ended.
    """
    return _latest(log, delay, period, F.max_by("value", F.struct("ts", "step")).alias("value"))


def best_so_far(log: DataFrame, delay: str = "1 day", period: str | None = None, mode: str = "max") -> DataFrame:
    """Best value and its step per (run, metric); the earliest step wins ties.

    With a period, state older than the watermark is dropped and later events no longer count.
    """
    best = F.max_by(F.struct("value", "step"), F.struct(sortable("value", mode), -F.col("step"))).alias("_best")
    out = _latest(log, delay, period, best)
    return out.withColumns({"value": F.col("_best.value"), "step": F.col("_best.step")}).drop("_best")


STATE = "micros long, step long, value double"
RUN_STATE = "metric array<string>, micros array<long>, step array<long>, value array<double>, newest array<long>, until array<long>"


def ended_runs_leave(log: DataFrame, ttl: str, delay: str = "1 day", mode: str | None = None) -> DataFrame:
    """(run, metric, ts, step, value) as a keyed state with time to live: the newest value, or with `mode`
    "max" or "min" the best one so far (the earliest step wins ties).

    An entry leaves the state once the watermark has passed its key's newest event by `ttl`, so the state
    holds the runs that are alive, however many there were. Events older than the watermark are dropped, so
    a late one never revives an ended run; a run that comes back starts anew. A table that is no stream
    gives the same rows by an aggregate. Events without a time take no part.

    The state of a run holds its metrics side by side: a group costs far more than an entry.
    """
    local, kinds = isinstance(log.schema["ts"].dataType, T.TimestampNTZType), dict(log.dtypes)
    log = log.where("ts IS NOT NULL").withColumn("ts", as_instant(F.col("ts")) if local else F.col("ts"))
    log = log.select("run", "metric", "ts", F.unix_micros("ts").alias("micros"), F.coalesce(F.col("step").cast("long"), F.lit(0)).alias("step"), F.col("value").cast("double"))
    if log.isStreaming:
        millis = log.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {ttl})")).first()[0]
        sign = {None: 0.0, "max": 1.0, "min": -1.0}[mode]
        grouped = log.withColumn("metric", F.col("metric").cast("string")).withWatermark("ts", delay).groupBy("run")
        columns = f"run {kinds['run']}, metric string, {STATE}"
        out = grouped.applyInPandasWithState(_kept_alive(millis, sign), columns, RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)
        out = out.withColumn("metric", F.col("metric").cast(kinds["metric"]))
    else:
        key = F.struct("micros", "step") if mode is None else F.struct(sortable("value", mode), -F.col("step"))
        out = log.groupBy("run", "metric").agg(F.max_by(F.struct("micros", "step", "value"), key).alias("_row")).select("run", "metric", "_row.*")
    instant = F.timestamp_micros("micros")
    return out.select("run", "metric", (as_local(instant) if local else instant).alias("ts"), "step", "value")


def _kept_alive(millis: int, sign: float):
    def better(a: tuple, b: tuple) -> bool:
        """Whether (micros, step, value) a replaces b."""
        if not sign:
            return a[:2] > b[:2]
        known = [x[2] is not None and x[2] == x[2] for x in (a, b)]
        if known[0] != known[1]:
            return known[0]
        return (sign * a[2], -a[1]) > (sign * b[2], -b[1]) if known[0] else a[1] < b[1]

    def keep(held: dict, state: GroupState) -> None:
        """`held`: metric to (micros, step, value, newest, until)."""
        if not held:
            state.remove()
            return
        state.update((list(held), *[list(column) for column in zip(*held.values())]))
        # a timeout must lie after the watermark
        state.setTimeoutTimestamp(max(min(entry[4] for entry in held.values()), state.getCurrentWatermarkMs() + 1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        old = {metric: entry for metric, *entry in zip(*state.get)} if state.exists else {}
        if state.hasTimedOut:
            keep({metric: entry for metric, entry in old.items() if entry[4] >= watermark}, state)
            return
        seen: dict = {}
        for part in batches:
            for metric, *row in zip(part["metric"].tolist(), part["micros"].tolist(), part["step"].tolist(), part["value"].tolist()):
                if metric not in seen:
                    seen[metric] = (tuple(old[metric][:3]), old[metric][3]) if metric in old else (tuple(row), row[0])
                best, newest = seen[metric]
                seen[metric] = (tuple(row) if better(tuple(row), best) else best, max(newest, row[0]))
        now = {metric: (*best, newest, max(newest // 1000 + millis, watermark + 1)) for metric, (best, newest) in seen.items()}
        keep({**{metric: entry for metric, entry in old.items() if entry[4] >= watermark}, **now}, state)
        micros, steps, values = zip(*[entry[:3] for entry in now.values()])
        yield pd.DataFrame({"run": [key[0]] * len(now), "metric": list(now), "micros": micros, "step": steps, "value": values})

    return step


def _latest(log: DataFrame, delay: str, period: str | None, *aggregates) -> DataFrame:
    local = isinstance(log.schema["ts"].dataType, T.TimestampNTZType)
    if local:
        log = log.withColumn("ts", as_instant(F.col("ts")))
    if log.isStreaming:
        log = log.withWatermark("ts", delay)
    keys = [F.col("run"), F.col("metric")]
    if period:
        keys.insert(0, F.window("ts", period).alias("period"))
    out = log.groupBy(*keys).agg(*aggregates)
    if period:
        start = F.col("period.start")
        out = out.withColumn("period", as_local(start) if local else start)
    return out


def run_to_table(board: DataFrame, keys: list[str], name: str = "board") -> DataFrame:
    """Run a board over what its source holds now and return the final table.

    Each micro-batch writes its changed rows to a folder of its own, so a repeated batch
    replaces itself; the row of the newest batch counts. Rows never pass the driver.
    """
    spark = board.sparkSession
    base = scratch_path(spark, name)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/rows/part={batch}")

    running = (
        board.writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    running.awaitTermination()
    rows = spark.read.parquet(f"{base}/rows").drop("part")
    rest = [c for c in board.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return newest.select(*keys, "_row.*")
