"""Human evaluation: sampling for annotators, answer sheets, scores, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claritas.functions import fixed
from claritas.operators.numbering import hash_order, number_rows, same_keys, top_rows
from claritas.operators.reshape import melt


def lookup(values: dict, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


THEMES = {code: theme for theme, codes in fixed.CRITERIA_BY_THEME.items() for code in codes}
TYPES = {c: fixed.QUALITY_TYPE if t == fixed.QUALITY_THEME else fixed.RULE_TYPE for c, t in THEMES.items()}
RULE_CODES = [c for c in fixed.CRITERIA if TYPES[c] == fixed.RULE_TYPE]


def melt_answers(df: DataFrame, ids: list[str], criteria: list[str] = fixed.CRITERIA) -> DataFrame:
    return melt(df, ids, criteria, "criterion", "answer")


def answer_or_null(c: Column | str, sentinel: str = fixed.NOT_APPLICABLE) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(sentinel))


def answer_score(c: Column | str, scores: dict[str, int] = fixed.ANSWER_SCORES) -> Column:
    return lookup(scores, c)


def with_criteria(df: DataFrame) -> DataFrame:
    """Theme, type and weight of a criterion; a code without an entry keeps the code."""
    code = F.col("criterion")
    return df.withColumns(
        {
            "criteria_theme": F.coalesce(lookup(THEMES, code), code),
            "criteria_type": F.coalesce(lookup(TYPES, code), code),
            "weight": lookup(fixed.CRITERION_WEIGHTS, code),
        }
    )


def recode(df: DataFrame, rule_codes: list[str] | None = None) -> DataFrame:
    """`score` of the rule criteria; not applicable, blank and other criteria are null."""
    codes = RULE_CODES if rule_codes is None else rule_codes
    scored = answer_score(answer_or_null("answer"))
    return df.withColumn("score", F.when(F.col("criterion").isin(codes), scored))


def fulfilment(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of fulfilled rule criteria per sheet, over the answered ones."""
    return df.groupBy(*by).agg(F.avg("score").alias("rate"))


def weighted_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted share of fulfilled criteria per sheet."""
    answered = F.col("score").isNotNull() & F.col("weight").isNotNull()
    gained = F.sum(F.when(answered, F.col("weight") * F.col("score")))
    return df.groupBy(*by).agg(F.try_divide(gained.cast("double"), F.sum(F.when(answered, F.col("weight")))).alias("total"))


def pseudonyms(df: DataFrame, column: str, names: dict[str, str] | None = None, prefix: str = "coder_") -> DataFrame:
    """Replace annotator ids: by a given mapping, else by place in sorted order."""
    if names is not None:
        return df.withColumn(column, F.coalesce(lookup(names, F.col(column).cast("string")), F.col(column).cast("string")))
    known = df.select(F.col(column).cast("string").alias("_id")).distinct()
    coded = number_rows(known, [], ["_id"], name="_n", start=1)
    joined = df.withColumn("_id", F.col(column).cast("string")).join(coded, "_id", "left")
    return joined.withColumn(column, F.concat(F.lit(prefix), F.col("_n"))).drop("_id", "_n")


def sample_batches(df: DataFrame, n: int, k: int, seed, stratum: str = "test_set", item: str = "input_id") -> DataFrame:
    """Draw n*k distinct inputs per stratum and deal n to each of k annotators (`batch`)."""
    inputs = df.select(stratum, item).distinct().withColumn("_hash", hash_order(seed, item))
    drawn = top_rows(inputs, [stratum], [F.col("_hash"), F.col(item)], n * k, name="draw")
    # At most n*k rows per stratum are left for this window.
    enough = F.count(F.lit(1)).over(Window.partitionBy(stratum)) == n * k
    failed = F.raise_error(F.concat(F.lit("too few inputs in "), F.col(stratum).cast("string"))).cast("int")
    # in a filter: the check holds whichever columns are read
    drawn = drawn.withColumn("_enough", enough).where(F.when(F.col("_enough"), F.lit(1)).otherwise(failed) == 1).drop("_enough")
    return drawn.withColumn("batch", F.floor((F.col("draw") - 1) / n)).drop("_hash")


def batch_rows(texts: DataFrame, batches: DataFrame, models: list[str]) -> DataFrame:
    """All chosen models' rows of the drawn inputs, with their batch."""
    keys = [c for c in ("test_set", "input_id") if c in batches.columns]
    return texts.where(F.col("model").isin(models)).join(batches.select(*keys, "batch"), keys)


def one_random(df: DataFrame, by: list[str], seed, keys: list[str]) -> DataFrame:
    """One row per group, the same for the same seed."""
    rest = [c for c in df.columns if c not in by]
    picked = F.min_by(F.struct(*rest), F.struct(hash_order(seed, *keys).alias("_h"), *keys))
    return df.groupBy(*by).agg(picked.alias("_row")).select(*by, "_row.*")


def _answer_counts(df: DataFrame, by: list[str], item: list[str], answer: str) -> DataFrame:
    """x answers of a kind among the m of an item; an item has one row per kind of answer."""
    counts = df.where(F.col(answer).isNotNull()).groupBy(*by, *item, answer).agg(F.count(F.lit(1)).alias("x"))
    return counts.withColumn("m", F.sum("x").over(Window.partitionBy(*by, *item)))


def _marginals(counts: DataFrame, by: list[str], answer: str, term: Column) -> DataFrame:
    """Per group: answers n, sum of squared answer totals, sum of `term` over the count rows."""
    per_answer = counts.groupBy(*by, answer).agg(F.sum("x").cast("double").alias("n_c"), F.sum(term).alias("_term"))
    return per_answer.groupBy(*by).agg(
        F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("n_c")).alias("squares"), F.sum("_term").alias("term")
    )


def krippendorff(df: DataFrame, by: list[str], item: list[str], answer: str = "answer") -> DataFrame:
    """Nominal alpha from answer counts.

    x answers of a kind among m form x (m - x) / (m - 1) weighted unequal pairs, and the
    marginal of a kind is its number of answers, so no pair is ever listed.
    """
    counts = _answer_counts(df, by, item, answer).where("m >= 2")
    unequal = F.col("x") * (F.col("m") - F.col("x")) / (F.col("m") - 1)
    sums = _marginals(counts, by, answer, unequal)
    expected = F.col("n") * F.col("n") - F.col("squares")
    return sums.select(*by, (1 - F.try_divide((F.col("n") - 1) * F.col("term"), expected)).alias("alpha"))


def krippendorff_spread(df: DataFrame, by: list[str], item: list[str], answer: str = "answer") -> DataFrame:
    """(by..., alpha, std_error, n_items, n_left_out): nominal alpha and its jackknife over the items.

    Alpha without one item follows from that item's counts and the sums over all items: an answer total n_c
    falls by the item's x_c, so the squares of the totals fall by 2 * n_c * x_c - x_c * x_c. The answers are
    counted once; no item is scanned again. Items with fewer than two answers are left out and counted.
    Items may have any number of raters. `std_error` is null below two items, or where leaving one item
    out leaves a single kind of answer.
    """
    if not by:
        return krippendorff_spread(df.withColumn("_all", F.lit(0)), ["_all"], item, answer).drop("_all")
    every = _answer_counts(df, by, item, answer)
    counts = every.where("m >= 2")
    unequal = F.col("x") * (F.col("m") - F.col("x")) / (F.col("m") - 1)
    per_answer = counts.groupBy(*by, answer).agg(F.sum("x").cast("double").alias("_n_c"))
    sums = _marginals(counts, by, answer, unequal)
    own = same_keys(counts, per_answer, [*by, answer])
    own = own.groupBy(*by, *item).agg(
        F.sum("x").cast("double").alias("_m"),
        F.sum(unequal).alias("_term"),
        F.sum(2 * F.col("_n_c") * F.col("x") - F.col("x") * F.col("x")).alias("_squares"),
    )

    def alpha(n: Column, squares: Column, term: Column) -> Column:
        return 1 - F.try_divide((n - 1) * term, n * n - squares)

    without = same_keys(own, sums, by).withColumn("_alpha", alpha(F.col("n") - F.col("_m"), F.col("squares") - F.col("_squares"), F.col("term") - F.col("_term")))
    spread = without.groupBy(*by).agg(
        F.max(alpha(F.col("n"), F.col("squares"), F.col("term"))).alias("alpha"),
        F.count(F.lit(1)).alias("n_items"),
        F.var_pop("_alpha").alias("_var"),
        F.count("_alpha").alias("_known"),
    )
    whole = (F.col("_known") == F.col("n_items")) & (F.col("n_items") > 1)
    spread = spread.withColumn("std_error", F.when(whole, F.sqrt((F.col("n_items") - 1) * F.col("_var"))))
    left_out = every.groupBy(*by).agg(F.sum(F.when(F.col("m") < 2, 1).otherwise(0)).alias("n_left_out"))
    out = same_keys(left_out, spread, by, "left")
    return out.select(*by, "alpha", "std_error", F.coalesce("n_items", F.lit(0)).alias("n_items"), "n_left_out")


def fleiss(df: DataFrame, by: list[str], item: list[str], raters: int, answer: str = "answer") -> DataFrame:
    """Kappa over the items answered by exactly `raters` annotators (it is defined for these only)."""
    counts = _answer_counts(df, by, item, answer).where(F.col("m") == raters)
    equal = F.col("x") * (F.col("x") - 1) / (raters * (raters - 1.0))
    sums = _marginals(counts, by, answer, equal).withColumn("n_items", (F.col("n") / raters).cast("long"))
    chance = F.col("squares") / (F.col("n") * F.col("n"))
    kappa = F.try_divide(F.col("term") / F.col("n_items") - chance, 1 - chance)
    return sums.select(*by, "n_items", kappa.alias("kappa"))


def criteria_table(spark) -> DataFrame:
    """The fixed criteria as rows (criterion, theme, kind, weight)."""
    rows = [(c, THEMES[c], TYPES[c], fixed.CRITERION_WEIGHTS.get(c)) for c in fixed.CRITERIA]
    return spark.createDataFrame(rows, "criterion string, theme string, kind string, weight int")
