"""The metric suite: every metric per group in one long table (by..., metric, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritas.functions.text import metric_key
from claritas.operators.bertscore import bertscore
from claritas.operators.corpus import union_all
from claritas.operators.pair_scores import summary
from claritas.operators.readability import STOP_WORDS

MetricJob = Callable[[DataFrame, list[str]], DataFrame]


def harmonic_mean(*columns: Column) -> Column:
    """0 as soon as one value is not positive."""
    total = sum((1 / F.when(c > 0, c) for c in columns), F.lit(0.0))
    return F.when(F.least(*columns) <= 0, F.lit(0.0)).otherwise(len(columns) / total)


def long_form(wide: DataFrame, by: list[str]) -> DataFrame:
    values = [c for c in wide.columns if c not in by]
    cast = wide.select(*by, *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(by, values, "metric", "value")


def with_srb(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Add the harmonic mean of SARI, ROUGE-L and BERTScore F1 to a long metric table.

    A group's metrics fit one map, so the table is computed once and not joined to itself.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("metric", "value")))
    packed = metrics.groupBy(*by).agg(entries.alias("_m"))
    parts = [F.try_element_at("_m", F.lit(m)) for m in ("sari", "rougeL", "bertscore_f1")]
    whole = F.map_concat("_m", F.create_map(F.lit("srb"), harmonic_mean(*parts)))
    return packed.select(*by, F.explode(whole).alias("metric", "value"))


def merge(*metrics: DataFrame, by: list[str]) -> DataFrame:
    """Union of long metric tables; on an equal key the later table wins."""
    ranked = [m.withColumn("_turn", F.lit(i)) for i, m in enumerate(metrics)]
    return union_all(ranked).groupBy(*by, "metric").agg(F.max_by("value", "_turn").alias("value"))


def suite(
    df: DataFrame,
    by: list[str],
    tokens: DataFrame | None = None,
    stems: bool = True,
    baseline: dict[str, float] | None = None,
    stop_words: list[str] = STOP_WORDS,
    extra: dict[str, MetricJob] | None = None,
    subsequences: bool | tuple[str, ...] = True,
    digits: int = 4,
) -> DataFrame:
    """All metrics of `df` (pair_id, by..., src, ref, pred); `tokens` adds BERTScore and SRB.

    The text metrics are one job with one shuffle of the texts; each function in `extra` (pairs and keys to
    one row per group) is a job of its own. `subsequences=False` leaves out ROUGE-L and ROUGE-Lsum; a
    tuple names those wanted.
    """
    wanted = ("rougeL", "rougeLsum") if subsequences is True else tuple(subsequences or ())
    jobs = [summary(df, by, stems, stop_words, wanted), *[job(df, by) for job in (extra or {}).values()]]
    if tokens is not None:
        jobs.append(bertscore(tokens, by, baseline, pairs=df))
    table = union_all([long_form(job, by) for job in jobs])
    if tokens is not None:
        table = with_srb(table, by)
    return table.withColumn("value", F.round("value", digits))


def keyed(metrics: DataFrame) -> DataFrame:
    """`{split}_{task}_{metric}` names from (split, task, metric)."""
    return metrics.withColumn("key", metric_key("split", "task", "metric"))
