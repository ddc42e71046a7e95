"""Column functions on ARRAY<INT> token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritas.functions.fixed import IGNORE_INDEX
from claritas.functions.vectors import once


def replace_ignored(tokens: Column, pad_id: int, ignore: int = IGNORE_INDEX) -> Column:
    return F.transform(tokens, lambda x: F.when(x == ignore, F.lit(pad_id)).otherwise(x))


def truncate(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def pad(tokens: Column, width: Column, pad_id, side: str = "right") -> Column:
    filler = F.array_repeat(F.lit(pad_id), (width - F.size(tokens)).cast("int"))
    return F.concat(tokens, filler) if side == "right" else F.concat(filler, tokens)


def attention_mask(tokens: Column, width: Column, side: str = "right") -> Column:
    return pad(F.transform(tokens, lambda x: F.lit(1)), width, 0, side)


def completion_labels(tokens: Column, marker: list, ignore: int = IGNORE_INDEX, pad_id: int | None = None) -> Column:
    """Ignore everything up to the end of the first marker (everything if it is absent), and padding."""
    n = len(marker)

    def starts_here(t: Column, i: Column) -> Column:
        hit = F.lit(True)
        for k, m in enumerate(marker):
            hit = hit & F.coalesce(F.get(t, i + k) == m, F.lit(False))
        return hit

    def labelled(t: Column, end: Column) -> Column:
        def label(x: Column, i: Column) -> Column:
            dropped = end.isNull() | (i < end)
            if pad_id is not None:
                dropped = dropped | (x == pad_id)
            return F.when(dropped, F.lit(ignore)).otherwise(x)

        return F.transform(t, label)

    def with_tokens(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0)))
        first = F.get(F.filter(places, lambda i: starts_here(t, i)), F.lit(0))
        return once(first + n, lambda end: labelled(t, end))

    return once(tokens, with_tokens)
