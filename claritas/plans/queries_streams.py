"""Live boards: the stream runs over what the folder holds and must equal the batch plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritas.plans.registry import query, table
from claritas.streaming import boards


def _log(df):
    return df.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("step"), "value")


def _stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return _log(spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet"))


@query("x1_metric_board", "SELECT user_id AS run, event_type AS metric, max_by(value, ts) AS value FROM events GROUP BY ALL")
def x1(spark, folder):
    return boards.run_to_table(boards.metric_board(_stream(spark, folder)), ["run", "metric"], "x1")


@query(
    "x2_best_so_far",
    """SELECT date_trunc('day', ts) AS period, user_id AS run, event_type AS metric, value, event_id AS step FROM events
       QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), user_id, event_type ORDER BY value DESC, event_id) = 1""",
)
def x2(spark, folder):
    board = boards.best_so_far(_stream(spark, folder), period="1 day")
    return boards.run_to_table(board, ["period", "run", "metric"], "x2")


@query("x1_live_runs", "SELECT user_id AS run, event_type AS metric, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS step, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def x1_live(spark, folder):
    return boards.run_to_table(boards.ended_runs_leave(_stream(spark, folder), ttl="3650 days"), ["run", "metric"], "x1-live")
