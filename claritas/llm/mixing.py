"""Source mixing to target weights by weighted reservoir keys (Efraimidis and Spirakis, 2006).

Every document draws u from a hash of its id and text; with weight w its key is -ln(u)/w, an
exponential variable with rate w. The documents of a source ordered by key are a weighted sample
without replacement at every prefix. A source takes floor(budget / size) complete epochs first; the
rest of its budget is a prefix of that order, and the document at the border is cut to the words that
still fit. So each source takes exactly its budget (its target, rounded).

No source is sorted in one task: equal ranges of the key's logarithm are buckets. The logarithm of an
exponential variable has a density of at most 1/e whatever its rate, so a source of n documents cut into
ranges of width 1/r has at most about n / (e * r) of them in one, however its weights are spread. Bucket
totals give the words before a bucket, a window inside it the rest. The table of sources (one row each)
and the bucket totals of a source are the only things ordered as a whole.

Nulls: a null source is a source of its own, last in order; a null text has size 0 and takes 0; a
null id is an id like any other. Repeated rows count each; equal keys go by id, then by text hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claritas.session import shuffle_width, written

OUTPUT = ["size", "source_size", "target", "taken"]
SEED = 20240607


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def text_quality(text: Column) -> Column:
    """A cheap weight in [0.05, 1]: the share of characters that are no symbols, sharpened."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.char_length(F.translate(text, "#%$*&|!<>{}[]\\^~=_", ""))
    return F.greatest(F.lit(0.05), F.pow(plain / F.greatest(F.char_length(text), F.lit(1)), F.lit(4.0)))


def _keyed(docs: DataFrame, weight: Column, keep: list[str]) -> DataFrame:
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    draw = F.xxhash64(F.lit(SEED), F.col("doc_id"), tie)
    u = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)  # exact, never 0 or 1
    return docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("_kept"),
        F.col("source").alias("_source"),
        F.col("doc_id").alias("_id"),
        tie.alias("_tie"),
        n_words(F.col("text")).alias("size"),
        (-F.ln(u) / weight).alias("_v"),
    )


def source_targets(sizes: DataFrame, shares: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """(_source, source_size, n, target) from (_source, source_size, n).

    The capped shares are min(cap * size, level * share) for the one level at which they sum to
    ratio * total; with sources ordered by cap * size / share, that level is the largest of
    (ratio * total - caps of the first k) / (shares of the others).
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (place - 1) % len(shares) + 1)
    rows = sizes.withColumn("_share", share).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    rows = rows.withColumn("_full", F.lit(float(ratio)) * F.sum("source_size").over(everything))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_share"), F.col("_source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_full") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_share").over(after)
    rows = rows.withColumn("_level", level)
    target = F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_share"))
    return rows.select("_source", "source_size", "n", target.alias("target"))


def mix(
    docs: DataFrame,
    keep: list[str],
    weight: Column | None = None,
    shares: tuple[float, ...] = (3, 1, 2),
    ratio: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Columns `keep` of `docs`, then size, source_size, target (of the source) and taken (words), one row per document.

    Sources in code point order (null last) get `shares` in turn of `ratio` times all words; no source
    takes more than `cap` times its words, the excess goes to the others by share. A kept column with
    the name of an output gives way to it.
    """
    keep = [c for c in keep if c.lower() not in OUTPUT]
    spark = docs.sparkSession
    weight = text_quality(F.col("text")) if weight is None else F.greatest(F.coalesce(weight, F.lit(1.0)).cast("double"), F.lit(1e-3))
    slim = [c for c in keep if c in ("doc_id", "source")]
    narrow = written(_keyed(docs, weight, slim), "mix-keys")
    sizes = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = written(source_targets(sizes, shares, ratio, cap), "mix-sources")
    rows_all = narrow.count()
    budget = F.round("target").cast("bigint")
    sources = sources.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    sources = sources.withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    # the fullest bucket holds about a fourth of a shuffle partition's share of the documents
    per_bucket = max(1.0, rows_all / (4.0 * shuffle_width(spark)))
    sources = sources.withColumn("_cuts", F.ceil(F.col("n") / (math.e * per_bucket))).withColumnRenamed("_source", "_of")

    def placed(rows: DataFrame) -> DataFrame:
        out = rows.join(sources, rows["_source"].eqNullSafe(sources["_of"])).drop("_of")
        return out.withColumn("_bucket", F.floor(F.ln("_v") * F.col("_cuts")))

    totals = placed(narrow).groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    order = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0))), "mix-buckets")
    totals = totals.select(F.col("_source").alias("_of"), F.col("_bucket").alias("_b"), "_before")
    rows = placed(narrow if slim == keep else _keyed(docs, weight, keep))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_v", F.col("_id").asc_nulls_last(), "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, rows["_source"].eqNullSafe(totals["_of"]) & (rows["_bucket"] == totals["_b"]))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before") - F.col("_within")))
    return rows.select(*[F.col("_kept").getField(c).alias(c) for c in keep], "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("bigint").alias("taken"))
