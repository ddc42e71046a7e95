"""Row-wise text measures and their means: reading ease, LIX, compression, novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritas.functions.text import LONG_WORD, NUMBER, VOWELS, compression, find_all, fold_accents, sentences, strip, word_tokens

# Default function words, compared without accents.
STOP_WORDS = [
    "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "elles", "en", "et", "eux",
    "il", "ils", "je", "la", "le", "les", "leur", "leurs", "lui", "ma", "mais", "me", "mes", "moi",
    "mon", "ne", "nos", "notre", "nous", "on", "ou", "par", "pas", "pour", "qu", "que", "qui", "sa",
    "se", "ses", "son", "sur", "ta", "te", "tes", "toi", "ton", "tu", "un", "une", "vos", "votre", "vous",
]


def words_per(c: Column) -> tuple[Column, Column]:
    return F.size(word_tokens(c)), F.size(sentences(c))


def reading_ease(c: Column) -> Column:
    """Kandel-Moles: 207 - 1.015 words/sentence - 73.6 syllables/word; null without words."""
    n_words, n_sentences = words_per(c)
    syllables = F.size(find_all(F.lower(c), VOWELS))
    per_sentence = F.try_divide(n_words.cast("double"), n_sentences.cast("double"))
    per_word = F.try_divide(syllables.cast("double"), n_words.cast("double"))
    return F.lit(207.0) - 1.015 * per_sentence - 73.6 * per_word


def lix(c: Column) -> Column:
    """Words per sentence plus the percentage of words longer than six letters."""
    n_words, n_sentences = words_per(c)
    n_long = F.size(find_all(c, LONG_WORD))
    return F.try_divide(n_words.cast("double"), n_sentences.cast("double")) + F.try_divide(
        100.0 * n_long, n_words.cast("double")
    )


def unigrams(c: Column, stop_words: list[str]) -> Column:
    """Distinct words without accents, numbers and stop words."""
    words = F.filter(word_tokens(fold_accents(c)), lambda w: ~w.rlike(NUMBER))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words]).cast("array<string>"))


def novelty(src: Column, pred: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Percentage of prediction unigrams absent from the source; 0 for an empty prediction."""
    said = unigrams(pred, stop_words)
    new = F.array_except(said, unigrams(src, stop_words))
    return F.coalesce(F.try_divide(100.0 * F.size(new), F.size(said).cast("double")), F.lit(0.0))


def row_scores(df: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    src, pred = strip(F.col("src")), strip(F.col("pred"))
    return df.withColumns(
        {
            "kmre": reading_ease(pred),
            "lix": lix(pred),
            "compression_ratio": compression(F.size(word_tokens(src)), F.size(word_tokens(pred))),
            "novelty": novelty(F.col("src"), F.col("pred"), stop_words),
        }
    )


def readability(df: DataFrame, by: list[str], stop_words: list[str] = STOP_WORDS) -> DataFrame:
    scores = row_scores(df, stop_words)
    means = [F.avg(c).alias(c) for c in ("kmre", "lix", "compression_ratio", "novelty")]
    return scores.groupBy(*by).agg(*means)
