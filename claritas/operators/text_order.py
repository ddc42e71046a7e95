"""Ordered buckets of texts: a sorted array of borders from a sample of whole texts, searched by halves.

Texts are compared as UTF-8 bytes, as Spark sorts them. A border is the shortest start of a sampled text
that tells it from the sampled text before it, so long common starts cost nothing but their own length
and never fold many texts into one bucket. A text drawn again and again gets a bucket of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_BUCKET = 32  # sampled texts per bucket: a bucket of twice its share is then very unlikely
SAMPLE_BYTES = 64 << 20  # of all sampled texts; fewer are drawn where texts are long


def _key(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def shortest_border(before: str, text: str) -> str:
    """The shortest start of `text` that sorts after `before`, which sorts before `text`."""
    same = next((i for i, (a, b) in enumerate(zip(before, text)) if a != b), min(len(before), len(text)))
    return text[: same + 1]


def borders_of(sample: list[str], buckets: int) -> tuple[list[str], list[str]]:
    """Borders (ascending) of about equal shares of `sample`, and the texts that fill a share alone.

    Such a text has its bucket: a border at the text, and one at the next text there can be.
    """
    sample = sorted(sample, key=_key)
    picked = [sample[i * len(sample) // buckets] for i in range(1, buckets)] if sample else []
    frequent = sorted({v for i, v in enumerate(picked[1:]) if v == picked[i]}, key=_key)
    out = {b for v in frequent for b in (v, v + "\0")}
    first: dict[str, int] = {}
    for i, v in enumerate(sample):
        first.setdefault(v, i)
    for v in set(picked) - set(frequent):
        out.add(shortest_border(sample[first[v] - 1], v) if first[v] else v[:1])
    return sorted(out - {""}, key=_key), frequent


def text_borders(df: DataFrame, column: str, buckets: int, seed: int = 7) -> tuple[list[str], list[str]]:
    """`borders_of` a bounded random sample of the known texts of a column; the borders are literals from
    then on, so a recomputed task puts a row where it was."""
    known = df.where(F.col(column).isNotNull()).select(column)
    n, size = known.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    if not n:
        return [], []
    share = min(1.0, PER_BUCKET * buckets / n, SAMPLE_BYTES / max(size, 1))
    drawn = known if share == 1.0 else known.where(F.rand(seed) < share)
    return borders_of([r[0] for r in drawn.collect()], buckets)


def text_bucket(column: Column, borders: list[str]) -> Column:
    """Number of borders at or before a text: 0 to len(borders); null for a null text."""
    if not borders:
        return F.when(column.isNotNull(), F.lit(0))
    steps = [1 << k for k in range(len(borders).bit_length() - 1, -1, -1)]
    sorted_, halves = F.array(*[F.lit(b) for b in borders]), F.array(*[F.lit(s) for s in steps])

    def step(low: Column, half: Column) -> Column:
        return F.when(F.get(sorted_, low + half - 1) <= column, low + half).otherwise(low)

    return F.when(column.isNotNull(), F.aggregate(halves, F.lit(0), step))
