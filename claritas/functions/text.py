"""Column functions on text. Patterns keep to constructs that other regex engines share."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritas.functions.fixed import ANSWER_MARK, BRACKET_TOKENS, INPUT_PREFIX, OUTPUT_PREFIX

WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
WHITE_CHARACTERS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"[\p{L}\p{N}]+"
LONG_WORD = r"[\p{L}\p{N}]{7,}"
SENTENCE = r"[^.!?]*[\p{L}\p{N}][^.!?]*"
ASCII_WORD = r"[a-z0-9]+"
VOWELS = "[aeiouyàâäéèêëïîôöùûüÿœæ]+"
NUMBER = r"^[\p{N}]+$"
FIRST_SENTENCE = r"^[^.!?]*[.!?]*"


def accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and their base letters (by canonical decomposition)."""
    marked = [chr(c) for c in range(0x00E0, 0x0250)]
    bases = [unicodedata.normalize("NFKD", c) for c in marked]
    kept = [(m, b[0]) for m, b in zip(marked, bases) if len(b) > 1 and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(m for m, _ in kept), "".join(b for _, b in kept)


ACCENTED, PLAIN = accent_table()


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (`trim` removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_CHARACTERS))


def clean_brackets(c: Column) -> Column:
    """Delete bracket tokens left by a treebank; `(?d)` makes the dot stop at newlines only."""
    present = c.contains("LRB") | c.contains("RRB")
    return F.when(present, F.regexp_replace(c, f"(?d){BRACKET_TOKENS}", "")).otherwise(c)


def fold_accents(c: Column) -> Column:
    """Lower-case and drop diacritics, also those written as separate marks."""
    lower = F.lower(c)
    folded = F.regexp_replace(F.translate(lower, ACCENTED, PLAIN), r"\p{Mn}", "")
    return F.when(lower.rlike(r"[^\x00-\x7f]"), folded).otherwise(lower)


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9; every other character splits."""
    return find_all(F.lower(c), ASCII_WORD)


def word_tokens(c: Column) -> Column:
    return find_all(c, WORD)


def sentences(c: Column) -> Column:
    """Stretches between sentence marks that hold a letter or digit."""
    return find_all(c, SENTENCE)


def first_sentence(c: Column) -> Column:
    return F.regexp_extract(c, FIRST_SENTENCE, 0)


# Fixed patterns of the "13a" tokeniser, applied in this order.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
PUNCTUATION = r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"  # as published
SPLITS_13A = [
    (PUNCTUATION, (" ", 1, " ")),
    (r"([^0-9])([.,])", (1, " ", 2, " ")),
    (r"([.,])([^0-9])", (" ", 1, " ", 2)),
    (r"([0-9])(-)", (1, " ", 2, " ")),
]
NOT_WHITE = r"[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"


def replaced_13a(c: Column, lower: bool = False) -> Column:
    """Text with the replacements that corpus BLEU makes before it splits."""
    c = F.replace(F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    c = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, c)
    return F.lower(c) if lower else c


def tokens_13a(c: Column, lower: bool = False) -> Column:
    """Tokens as corpus BLEU counts them."""
    c = F.concat(F.lit(" "), replaced_13a(c, lower), F.lit(" "))
    for pattern, parts in SPLITS_13A:
        c = F.regexp_replace(c, pattern, "".join(f"${p}" if isinstance(p, int) else p for p in parts))
    return find_all(c, NOT_WHITE)


def marked_answer(c: Column, mark: str = ANSWER_MARK) -> Column:
    """Text inside the first pair of marks; without a pair, the text with all marks removed."""
    pair = rf"(?s)\Q{mark}\E(.*?)\Q{mark}\E"
    return F.when(c.rlike(pair), F.regexp_extract(c, pair, 1)).otherwise(F.replace(c, F.lit(mark), F.lit("")))


def chat_text(messages: Column, eos: str, generation: bool = False) -> Column:
    """Render ARRAY<STRUCT<role, content>>: prefixes per role, end mark after answers."""

    def turn(m: Column) -> Column:
        body = (
            F.when(m["role"] == "user", F.concat(F.lit(f"{INPUT_PREFIX} "), m["content"]))
            .when(m["role"] == "assistant", F.concat(F.lit(f" {OUTPUT_PREFIX} "), m["content"], F.lit(f" {eos}")))
            .otherwise(F.lit(""))
        )
        return F.concat(body, F.lit(f" {OUTPUT_PREFIX}")) if generation else body

    return strip(F.array_join(F.transform(messages, turn), ""))


def pair_messages(src: Column, dst: Column | None = None) -> Column:
    """The one- or two-message chat of a text pair."""
    turns = [F.struct(F.lit("user").alias("role"), src.alias("content"))]
    if dst is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), dst.alias("content")))
    return F.array(*turns)


def chat_output(c: Column) -> Column:
    """What follows the first output prefix; the whole text if there is none."""
    at = F.instr(c, OUTPUT_PREFIX)
    return strip(F.when(at > 0, F.substring(c, at + F.lit(len(OUTPUT_PREFIX)), F.length(c))).otherwise(c))


def chat_input(c: Column) -> Column:
    """What precedes the first output prefix, without input prefixes."""
    return strip(F.replace(F.substring_index(c, OUTPUT_PREFIX, 1), F.lit(INPUT_PREFIX), F.lit("")))


def last_part(c: Column, separator: str) -> Column:
    return F.element_at(F.split(c, rf"\Q{separator}\E"), -1)


def model_key(c: Column) -> Column:
    """Parse the text of a (model, method, train_tasks) tuple; other text becomes the model alone."""
    parts = F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1))
    is_tuple = c.startswith("(")
    return F.struct(
        F.when(is_tuple, F.try_element_at(parts, F.lit(1))).otherwise(c).alias("model"),
        F.when(is_tuple, F.try_element_at(parts, F.lit(2))).alias("method"),
        F.when(is_tuple, F.try_element_at(parts, F.lit(3))).alias("train_tasks"),
    )


def metric_key(*parts) -> Column:
    """`{split}_{task}_{metric}`."""
    return F.concat_ws("_", *parts)


def split_by_prefix(c: Column, prefixes: list[str], separator: str = "_") -> Column:
    """Longest listed prefix as `group` (else `other`), the rest as `short`."""
    group, short = F.lit("other"), c
    for prefix in sorted(prefixes, key=len):
        hit = c.startswith(prefix + separator)
        group = F.when(hit, F.lit(prefix)).otherwise(group)
        short = F.when(hit, F.substring(c, len(prefix + separator) + 1, 1 << 20)).otherwise(short)
    return F.struct(group.alias("group"), short.alias("short"))


def task_flags(c: Column, tasks: list[str]) -> dict[str, Column]:
    """One boolean per task of a `+` list."""
    listed = F.split(c, r"\+")
    return {f"has_{task}": F.array_contains(listed, task) for task in tasks}


def compression(n_src: Column, n_pred: Column) -> Column:
    """Percent saved: 100 - pred / src * 100; null when the source is empty."""
    return F.lit(100.0) - F.try_divide(n_pred.cast("double"), n_src.cast("double")) * 100.0
