"""All text metrics of a pair table as one job.

The texts are hash-partitioned by pair and group once. Token lists of ROUGE, BLEU and SARI become tagged
gram rows of one stage, and measures of whole texts (readability, subsequences) travel as tagged rows of
the same stage, so every metric comes out of one chain of groupings that never leaves that partitioning;
only one row per group and task crosses the network again. Grams that no text of a pair holds twice are
counted inside the row by set functions; the others, and all grams of rows that share `pair_id` and `by`,
are unfolded. The size of the texts decides the number of partitions, so groupings fit memory.

With stems, which need Python anyway, the partitions of texts go through Arrow instead (`text_batches`) and come
back as one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritas.functions.text import replaced_13a, strip, tokens_13a
from claritas.operators import ngrams, readability, subsequence, text_batches
from claritas.operators.arrow_groups import with_first

MEASURES = ("kmre", "lix", "compression_ratio", "novelty")
LISTS = {"rouge": (1, 2), "bleu": ngrams.ORDERS, "sari": ngrams.ORDERS}
BLEU_SUMS = [*[f"correct_{n}" for n in ngrams.ORDERS], *[f"total_{n}" for n in ngrams.ORDERS], "ref_length"]


def _token_columns(stems: bool) -> dict[tuple[str, str], Column]:
    """Tokens per (tag, side)."""
    out = {("rouge", s): ngrams.rouge_tokens(F.col(s), stems) for s in ("pred", "ref")}
    out |= {("bleu", s): tokens_13a(strip(F.col(s))) for s in ("pred", "ref")}
    return out | {("sari", s): tokens_13a(strip(F.col(s)), lower=True) for s in ("src", "pred", "ref")}


def _tagged(tag: str, n: int, c: Column, value: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), F.lit(n).alias("n"), *[c[name].alias(name) for name in ("sides", "times", "list")], value.alias("value"))


def pair_sums(df: DataFrame, by: list[str], stems: bool, stop_words: list[str], subsequences: tuple[str, ...]) -> DataFrame:
    """(pair_id, by..., tag, n, sums...): the sums of each gram order, or the value of a measure."""
    keys, tokens = ["pair_id", *by], _token_columns(stems)
    longest = subsequence.longest_shorter(df) if "rougeL" in subsequences and not stems else 0
    measures = {}
    for name in subsequences:
        summary = name == "rougeLsum"
        measures[name] = ngrams.f_score(subsequence.hits_column(longest, stems, summary), *subsequence.sizes_columns(summary))
    split = _spread(df, keys).withColumn("_again", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)
    scored = readability.row_scores(split, stop_words)
    work = scored.select(
        *keys,
        "_again",
        *[c.alias(f"_{tag}_{side}") for (tag, side), c in tokens.items()],
        *[F.col(m).alias(f"_{m}") for m in MEASURES],
        *[c.alias(f"_{m}") for m, c in measures.items()],
    )
    none, lists = F.lit(None).cast("double"), []
    for tag, orders in LISTS.items():
        for n in orders:
            grams = {side: ngrams.grams(F.col(f"_{tag}_{side}"), n) for t, side in tokens if t == tag}
            lists.append(F.transform(ngrams.gram_classes(grams, F.col("_again")), lambda c: _tagged(tag, n, c, none)))
    nothing = F.struct(F.lit(0).alias("sides"), F.lit(0).cast("bigint").alias("times"), F.lit(None).cast("array<string>").alias("list"))
    whole = F.array(*[_tagged(m, 0, nothing, F.col(f"_{m}").cast("double")) for m in [*MEASURES, *measures]])
    # outer unfolding keeps an empty list as one null gram, which no side may count
    rows = work.select(*keys, F.inline(F.concat(*lists, whole)))
    rows = rows.select(*keys, "tag", "n", "sides", "times", "value", F.when(F.col("times") > 0, F.col("sides")).otherwise(0).alias("class"), F.explode_outer("list").alias("gram"))
    counts = [F.count(F.when(F.col("sides") == bit, F.col("gram"))).alias(f"c_{s}") for s, bit in ngrams.SIDE_BITS.items()]
    counted = rows.groupBy(*keys, "tag", "n", "class", "gram").agg(*counts, F.max("times").alias("times"), F.max("value").alias("value"))
    classed = F.col("class") > 0
    sides = {f"c_{s}": F.when(classed, (F.col("class").bitwiseAND(bit) > 0).cast("bigint")).otherwise(F.col(f"c_{s}")) for s, bit in ngrams.SIDE_BITS.items()}
    counted = counted.withColumns({**sides, "times": F.when(classed, F.col("times")).otherwise(1)})
    times = F.col("times")
    return counted.groupBy(*keys, "tag", "n").agg(*ngrams.overlap_sums(times), *ngrams.sari_sums(times), F.max("value").alias("value"))


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "src", "ref", "pred").repartition(ngrams.text_width(df, ("src", "ref", "pred")), *keys)


def _rows_of_sums(df: DataFrame, by: list[str], stop_words: list[str], subsequences: tuple[str, ...], stems: bool = False) -> DataFrame:
    """One row per pair from `pair_sums`."""
    sums = pair_sums(df, by, stems, stop_words, subsequences)

    def of(tag: str, n: int | None, value: Column) -> Column:
        here = F.col("tag") == tag if n is None else (F.col("tag") == tag) & (F.col("n") == n)
        return F.when(here, value)

    f = ngrams.f_score(F.col("hits"), F.col("n_pred"), F.col("n_ref"))
    bleu = {}
    for n in ngrams.ORDERS:
        bleu[f"correct_{n}"], bleu[f"total_{n}"] = of("bleu", n, F.col("hits")), of("bleu", n, F.col("n_pred"))
    bleu["ref_length"] = of("bleu", 1, F.col("n_ref"))
    return sums.groupBy("pair_id", *by).agg(
        *[F.max(of("rouge", n, f)).alias(f"rouge{n}") for n in LISTS["rouge"]],
        *[F.max(c).alias(name) for name, c in bleu.items()],
        F.avg(of("sari", None, sum(ngrams.sari_parts()[1:], ngrams.sari_parts()[0]) / 3)).alias("sari"),
        *[F.max(of(m, None, F.col("value"))).alias(m) for m in [*MEASURES, *subsequences]],
    )


def _rows_of_batches(df: DataFrame, by: list[str], stop_words: list[str], subsequences: tuple[str, ...]) -> DataFrame:
    """One row per pair from Arrow batches of whole pairs, with stems."""
    keys = ["pair_id", *by]
    scored = readability.row_scores(with_first(_spread(df, keys), keys), stop_words)
    texts = {f"rouge_{s}": F.lower(s) for s in ("pred", "ref")}
    texts |= {f"bleu_{s}": replaced_13a(strip(F.col(s))) for s in ("pred", "ref")}
    texts |= {f"sari_{s}": replaced_13a(strip(F.col(s)), lower=True) for s in ("src", "pred", "ref")}
    ready = scored.select(*keys, "_first", *[F.col(m).cast("double").alias(m) for m in MEASURES], *[c.alias(name) for name, c in texts.items()])
    means = [*[f"rouge{n}" for n in LISTS["rouge"]], "sari", *subsequences]
    fields = [df.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in (*MEASURES, *means)] + [T.StructField(c, T.LongType()) for c in BLEU_SUMS]
    return ready.mapInArrow(text_batches.scorer(keys, MEASURES, [*means, *BLEU_SUMS]), T.StructType(fields))


def summary(
    df: DataFrame, by: list[str], stems: bool = True, stop_words: list[str] = readability.STOP_WORDS, subsequences: tuple[str, ...] = ("rougeL", "rougeLsum")
) -> DataFrame:
    """One row per group: every metric of `df` (pair_id, by..., src, ref, pred), and n_samples."""
    pairs = (_rows_of_batches if stems else _rows_of_sums)(df, by, stop_words, subsequences)
    shares = [*[f"rouge{n}" for n in LISTS["rouge"]], *subsequences, "sari"]
    groups = pairs.groupBy(*by).agg(
        *[(F.avg(c) * 100).alias(c) for c in shares],
        *[F.sum(c).alias(c) for c in BLEU_SUMS],
        *[F.avg(m).alias(m) for m in MEASURES],
        F.count(F.lit(1)).alias("n_samples"),
    )
    return groups.select(*by, *shares, ngrams.bleu_score().alias("bleu"), *MEASURES, "n_samples")
