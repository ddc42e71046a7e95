"""Seeded Poisson bootstrap of group means: all replicates in one pass, as a partial aggregate.

A row takes part in a replicate as often as a Poisson variable of mean one says; the variable comes from
a hash of the row's key, so nothing is resampled or stored and a recomputed task draws the same numbers.
Weighted sums of a group leave each task before the shuffle: groups x replicates numbers in all, whatever
the number of rows. Rows of one key have one weight, so systems scored on the same pairs are compared on
the same resamples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 1000
PER_HASH = 8  # an md5 has eight numbers of four hex digits


def thresholds() -> list[str]:
    """Four hex digits from which on a number stands for a weight of 1, 2, ...: the Poisson distribution in 65,536ths."""
    out, share, total, weight = [], math.exp(-1), 0.0, 0
    while True:
        total += share
        edge = round(total * 65_536)
        if edge >= 65_536:
            return out
        out.append(f"{edge:04x}")
        weight += 1
        share /= weight


def weight_of(digits: Column) -> Column:
    return sum(((digits >= t).cast("int") for t in thresholds()), F.lit(0))


def bootstrap(rows: DataFrame, by: list[str], key: list[str], value: str = "value", replicates: int = REPLICATES, seed=0, interval: float = 0.95) -> DataFrame:
    """(by..., n, mean, low, mid, high): the plain mean, and percentiles of the resampled means.

    `replicates` is a multiple of eight. Rows with a null value are left out; a replicate that draws no
    row of a group has no mean; a group without a known value has n = 0 and nulls.
    """
    if replicates % PER_HASH:
        raise ValueError(f"replicates must be a multiple of {PER_HASH}")
    drawn = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    known = rows.select(*by, F.col(value).cast("double").alias("_v"), drawn.alias("_key"))
    spread = known.select(*by, "_v", "_key", F.explode(F.sequence(F.lit(0), F.lit(replicates // PER_HASH - 1))).alias("_block"))
    spread = spread.select(*by, "_v", "_block", F.md5(F.concat("_key", F.lit(":"), F.col("_block").cast("string"))).alias("_hash"))
    weights = {k: weight_of(F.substring("_hash", 4 * k + 1, 4)) for k in range(PER_HASH)}
    spread = spread.select(*by, "_v", "_block", *[w.alias(f"_w{k}") for k, w in weights.items()])
    has = F.col("_v").isNotNull()
    sums = [F.struct(F.sum(F.when(has, F.col(f"_w{k}"))).alias("w"), F.sum(F.col(f"_w{k}") * F.col("_v")).alias("wv")) for k in weights]
    blocks = spread.groupBy(*by, "_block").agg(F.array(*sums).alias("_sums"), F.count("_v").alias("_n"), F.sum("_v").alias("_total"))
    means = F.transform("_sums", lambda s: s.wv / F.nullif(s.w, F.lit(0)))
    each = blocks.select(*by, "_n", F.when(F.col("_block") == 0, F.col("_total")).alias("_total"), F.explode(means).alias("_mean"))
    edge = (1 - interval) / 2
    parts = F.percentile("_mean", F.array(*[F.lit(p) for p in (edge, 0.5, 1 - edge)]))
    out = each.groupBy(*by).agg(F.max("_n").alias("n"), F.max("_total").alias("_total"), parts.alias("_parts"))
    named = [F.get("_parts", F.lit(i)).alias(c) for i, c in enumerate(("low", "mid", "high"))]
    return out.select(*by, "n", (F.col("_total") / F.nullif("n", F.lit(0))).alias("mean"), *named)
