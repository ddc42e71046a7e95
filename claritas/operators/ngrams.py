"""Metrics from n-gram counts: ROUGE-1/2, corpus BLEU, SARI.

Texts are hash-partitioned by their key (pair and group) once. Tokens, n-grams and both aggregations then stay in
that partitioning: grams are several times larger than the text and never cross the network,
and no key is a gram alone, so frequent words cannot form a hot key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritas.functions.stem import stem
from claritas.functions.text import ASCII_WORD, ascii_tokens, find_all, strip, tokens_13a
from claritas.session import shuffle_width

ORDERS = (1, 2, 3, 4)
SIDE_BITS = {"src": 1, "pred": 2, "ref": 4}
TEXT_BYTES = 2 << 20  # of text in a partition: its repeated grams, or its token vectors, fit the memory of a task


def text_width(df: DataFrame, columns: tuple[str, ...]) -> int:
    """Partitions that hold at most about TEXT_BYTES of `columns`; grams outgrow the text, so the texts decide."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0).cast("bigint"))
    return max(shuffle_width(df.sparkSession), -(-(df.agg(F.sum(size)).first()[0] or 0) // TEXT_BYTES))


def token_stemmer() -> Callable[[list[str]], list[str]]:
    """Stems of tokens longer than three characters; other tokens as they are.

    Words repeat, so stems are kept, and by process: every task unpickles this module anew.
    """
    kept = sys.modules.setdefault("claritas_kept", ModuleType("claritas_kept"))
    if not hasattr(kept, "stem"):
        kept.stem = lru_cache(maxsize=1 << 16)(stem)
    known = kept.stem
    return lambda tokens: [known(t) if len(t) > 3 else t for t in tokens]


@F.pandas_udf(T.StringType())
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of blank-separated tokens; plain text crosses to Python faster than arrays."""
    stems = token_stemmer()
    for text in batches:
        yield text.map(lambda t: " ".join(stems(t.split())), na_action="ignore")


def rouge_tokens(c: Column, stems: bool) -> Column:
    tokens = ascii_tokens(c)
    return find_all(stemmed(F.array_join(tokens, " ")), ASCII_WORD) if stems else tokens


def grams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by blanks."""
    if n == 1:
        return tokens
    count = F.size(tokens) - (n - 1)
    joined = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(count > 0, joined).otherwise(F.array().cast("array<string>"))


def repeats(c: Column) -> Column:
    """Every occurrence but the first of the values of an array."""

    def after_equal(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: F.get(ordered, i - 1) == x)

    def of(values: Column) -> Column:
        found = F.get(F.transform(F.array(F.sort_array(values)), after_equal), F.lit(0))
        return F.when(F.size(F.array_distinct(values)) < F.size(values), found).otherwise(F.array().cast("array<string>"))

    return of(c)


def gram_classes(lists: dict[str, Column], again: Column) -> Column:
    """ARRAY<STRUCT<sides, times, list>> that says how often each gram stands on each side, in few rows.

    Grams that no side holds twice are only counted: `times` of them stand once on each of `sides` (bits of
    SIDE_BITS) and nowhere else. The occurrences of all others are listed per side. Where `again` is true, all are.
    """
    none = F.array().cast("array<string>")
    whole = F.struct(*[F.coalesce(c, none).alias(s) for s, c in lists.items()])

    def with_lists(x: Column) -> Column:
        return F.struct(*[x[s].alias(s) for s in lists], *[F.when(again, none).otherwise(repeats(x[s])).alias(f"_{s}") for s in lists])

    def with_common(x: Column) -> Column:
        common = F.array_distinct(F.concat(*[x[f"_{s}"] for s in lists]))
        return F.struct(
            *[F.when(again, none).otherwise(F.array_except(x[s], common)).alias(s) for s in lists],
            *[F.when(again, x[s]).otherwise(F.concat(x[f"_{s}"], F.array_intersect(x[s], common))).alias(f"_{s}") for s in lists],
        )

    choices = [bits for bits in range(1, 8) if sum(SIDE_BITS[s] for s in lists if SIDE_BITS[s] & bits) == bits]

    def with_sizes(x: Column) -> Column:
        # how many grams stand on all sides of a choice, whatever the others hold
        met = {bits: reduce(F.array_intersect, [x[s] for s in lists if SIDE_BITS[s] & bits]) for bits in choices}
        return F.struct(*[F.size(m).alias(f"n{bits}") for bits, m in met.items()], *[x[f"_{s}"].alias(f"_{s}") for s in lists])

    def rows(x: Column) -> Column:
        def only(bits: int) -> Column:
            wider = [(b, -1 if (b ^ bits).bit_count() % 2 else 1) for b in choices if b & bits == bits and b != bits]
            return sum((x[f"n{b}"] * sign for b, sign in wider), x[f"n{bits}"])

        counted = F.filter(F.array(*[_class(bits, only(bits), F.lit(None).cast("array<string>")) for bits in choices]), lambda c: c["times"] > 0)
        return F.concat(counted, F.array(*[_class(SIDE_BITS[s], F.lit(0), x[f"_{s}"]) for s in lists]))

    for step in (with_lists, with_common, with_sizes, rows):
        whole = F.get(F.transform(F.array(whole), step), F.lit(0))
    return whole


def _class(bits: int, times: Column, listed: Column) -> Column:
    return F.struct(F.lit(bits).alias("sides"), times.cast("bigint").alias("times"), listed.alias("list"))


def gram_counts(df: DataFrame, keys: list[str], tokens: dict[str, Column], orders=ORDERS) -> DataFrame:
    """(keys, n, gram, c_<side>...) with the count of every gram on every side.

    `keys` starts with the pair id. A pair without any n-gram keeps a row with a null gram.
    """
    sides = list(tokens)
    # A fixed width: the grams outgrow the text, so sizes measured on the text would leave few tasks.
    split = df.repartition(shuffle_width(df.sparkSession), *keys).select(*keys, *[t.alias(f"_{s}") for s, t in tokens.items()])

    lists = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.lit(n).alias("n"), grams(F.col(f"_{s}"), n).alias("list"))
            for n in orders
            for s in sides
        ]
    )
    # Outer unfolding keeps an empty list as one null gram, which no side may count.
    rows = split.select(*keys, F.inline_outer(lists)).select(*keys, "side", "n", F.explode_outer("list").alias("gram"))
    counts = [F.count(F.when(F.col("side") == s, F.col("gram"))).alias(f"c_{s}") for s in sides]
    return rows.groupBy(*keys, "n", "gram").agg(*counts)


def f_score(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of hits/n_pred and hits/n_ref; 0 when either side is empty."""
    p, r = F.try_divide(hits.cast("double"), n_pred), F.try_divide(hits.cast("double"), n_ref)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def overlap_sums(times: Column | int = 1) -> list[Column]:
    """Clipped matches and totals of the counted grams; a row stands for `times` grams."""
    sums = {"hits": F.least("c_pred", "c_ref"), "n_pred": F.col("c_pred"), "n_ref": F.col("c_ref")}
    return [F.sum(c * times).alias(name) for name, c in sums.items()]


def rouge_pairs(df: DataFrame, by: list[str], orders=(1, 2), stems: bool = True) -> DataFrame:
    """Clipped overlap, totals and F per pair and order."""
    tokens = {"pred": rouge_tokens(F.col("pred"), stems), "ref": rouge_tokens(F.col("ref"), stems)}
    keys = ["pair_id", *by]
    counts = gram_counts(df, keys, tokens, orders)
    sums = counts.groupBy(*keys, "n").agg(*overlap_sums())
    return sums.withColumn("f", f_score(F.col("hits"), F.col("n_pred"), F.col("n_ref")))


def rouge(df: DataFrame, by: list[str], orders=(1, 2), stems: bool = True) -> DataFrame:
    """Mean F per group in percent, one column per order."""
    means = [(F.avg(F.when(F.col("n") == n, F.col("f"))) * 100).alias(f"rouge{n}") for n in orders]
    return rouge_pairs(df, by, orders, stems).groupBy(*by).agg(*means)


def bleu_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Corpus sums per group: matches and totals per order, and both lengths."""
    tokens = {s: tokens_13a(strip(F.col(s))) for s in ("pred", "ref")}
    counts = gram_counts(df, ["pair_id", *by], tokens)
    sums = []
    for n in ORDERS:
        here = F.col("n") == n
        sums.append(F.sum(F.when(here, F.least("c_pred", "c_ref")).otherwise(0)).alias(f"correct_{n}"))
        sums.append(F.sum(F.when(here, F.col("c_pred")).otherwise(0)).alias(f"total_{n}"))
    ref_length = F.sum(F.when(F.col("n") == 1, F.col("c_ref")).otherwise(0)).alias("ref_length")
    return counts.groupBy(*by).agg(*sums, ref_length)


def bleu_score() -> Column:
    """Corpus BLEU with exponential smoothing, from the columns of `bleu_counts`."""
    halvings, logs = F.lit(1.0), F.lit(0.0)
    for n in ORDERS:
        correct, total = F.col(f"correct_{n}"), F.col(f"total_{n}").cast("double")
        halvings = F.when(correct == 0, halvings * 2).otherwise(halvings)
        smoothed = F.when(correct == 0, 100.0 / (halvings * total)).otherwise(100.0 * correct / total)
        logs = logs + F.ln(smoothed)
    brevity = F.when(F.col("total_1") >= F.col("ref_length"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_length") / F.col("total_1"))
    )
    empty = F.least(*[F.col(f"total_{n}") for n in ORDERS]) == 0
    unmatched = F.greatest(*[F.col(f"correct_{n}") for n in ORDERS]) == 0
    return F.when(empty | unmatched, F.lit(0.0)).otherwise(brevity * F.exp(logs / len(ORDERS)))


def bleu(df: DataFrame, by: list[str]) -> DataFrame:
    return bleu_counts(df, by).select(*by, bleu_score().alias("bleu"))


def _ratio(top: Column, bottom: Column) -> Column:
    """0/0 counts as 1."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(1.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def sari_sums(times: Column | int = 1) -> list[Column]:
    """Precision and recall of kept, deleted and added grams of one order; a row stands for `times` grams."""
    s, c, r = F.col("c_src"), F.col("c_pred"), F.col("c_ref")
    zero = F.lit(0)
    kept, kept_all = F.least(s, c), F.least(s, r)
    kept_good = F.least(kept, r)
    gone = F.greatest(s - c, zero)
    gone_good = F.greatest(gone - r, zero)
    new, new_all = (c > 0) & (s == 0), (r > 0) & (s == 0)

    def share(top: Column, bottom: Column) -> Column:
        return F.sum(F.when(bottom > 0, top / bottom * times).otherwise(0.0))

    def how_many(condition: Column) -> Column:
        return F.sum(F.when(condition, times).otherwise(0))

    return [
        _ratio(share(kept_good, kept), how_many(kept > 0)).alias("keep_p"),
        _ratio(F.sum(kept_good * times), F.sum(kept_all * times)).alias("keep_r"),
        _ratio(share(gone_good, gone), how_many(gone > 0)).alias("del_p"),
        _ratio(how_many(new & (r > 0)), how_many(new)).alias("add_p"),
        _ratio(how_many(new & (r > 0)), how_many(new_all)).alias("add_r"),
    ]


def sari_parts() -> tuple[Column, Column, Column]:
    """Keep, delete and add score of one order."""
    return _f1(F.col("keep_p"), F.col("keep_r")), F.col("del_p"), _f1(F.col("add_p"), F.col("add_r"))


def sari_pairs(df: DataFrame, by: list[str]) -> DataFrame:
    """Keep, delete and add score per pair, each the mean over n = 1..4."""
    keys = ["pair_id", *by]
    tokens = {s: tokens_13a(strip(F.col(s)), lower=True) for s in ("src", "pred", "ref")}
    sums = gram_counts(df, keys, tokens).groupBy(*keys, "n").agg(*sari_sums())
    return sums.groupBy(*keys).agg(*[F.avg(part).alias(name) for name, part in zip(("keep", "delete", "add"), sari_parts())])


def sari(df: DataFrame, by: list[str]) -> DataFrame:
    parts = [F.col("keep"), F.col("delete"), F.col("add")]
    mean = reduce(lambda a, b: a + b, parts) / 3
    return sari_pairs(df, by).groupBy(*by).agg((F.avg(mean) * 100).alias("sari"))
