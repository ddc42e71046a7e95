"""BERTScore from given token vectors (pair_id, side, tok_pos, vec).

The tokens of a pair meet as neighbouring rows of Arrow batches, sorted within the partition, so vectors are
neither packed in the JVM nor joined side to side; products are made in tiles of CHUNK tokens, no token pair
is ever a row, and a pair whose vectors outgrow memory waits in a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritas.operators.arrow_groups import HELD_BYTES, firsts, whole_groups, with_first

CHUNK = 512


def _flat(vec: pa.ChunkedArray) -> np.ndarray:
    if not len(vec):
        return np.zeros((0, 1))
    sizes = np.concatenate([np.asarray(c.value_lengths().fill_null(-1)) for c in vec.chunks])
    if sizes.min() != sizes.max() or sizes[0] < 1:
        raise ValueError("token vectors are null, empty or of different lengths")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vec.chunks]).reshape(len(vec), -1)


def _unit(vec: pa.ChunkedArray) -> np.ndarray:
    matrix = _flat(vec).astype(np.float64)
    size = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return matrix / np.where(size > 0, size, 1.0)


def _best(rows: Callable[[int, int], np.ndarray], begin: int, middle: int, end: int) -> np.ndarray:
    """Best cosine of every token; predictions lie before `middle`, references from there on."""
    best = np.full(end - begin, -np.inf)
    for p in range(begin, middle, CHUNK):
        pred, at = rows(p, min(p + CHUNK, middle)), slice(p - begin, min(p + CHUNK, middle) - begin)
        for r in range(middle, end, CHUNK):
            cosine, to = pred @ rows(r, min(r + CHUNK, end)).T, slice(r - begin, min(r + CHUNK, end) - begin)
            best[at] = np.maximum(best[at], cosine.max(axis=1))
            best[to] = np.maximum(best[to], cosine.max(axis=0))
    return best


def _scored(table: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(begin, middle, end, best cosines) of every pair that has tokens on both sides."""
    begins = firsts(table)
    ends = np.append(begins[1:], table.num_rows)
    middles = begins + np.add.reduceat(~np.asarray(table.column("_ref")), begins)
    vec = table.column("vec")
    whole = _unit(vec) if table.nbytes <= HELD_BYTES else None

    def rows(i: int, j: int) -> np.ndarray:
        return _unit(vec.slice(i, j - i)) if whole is None else whole[i:j]

    for begin, middle, end in zip(begins.tolist(), middles.tolist(), ends.tolist()):
        if begin < middle < end:
            yield begin, middle, end, _best(rows, begin, middle, end)


def _positions(table: pa.Table) -> np.ndarray:
    """Where a position begins; rows that repeat one (of a pair and side) count as one token."""
    place = table.column("tok_pos").combine_chunks()
    number, null = np.asarray(place.fill_null(0)), np.asarray(place.is_null())
    new = np.append(True, (np.diff(number) != 0) | (null[1:] != null[:-1]) | np.diff(np.asarray(table.column("_ref"))))
    new[firsts(table)] = True
    return new


def _token_rows(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            new = _positions(table)
            for begin, _, end, best in _scored(table):
                starts = np.flatnonzero(new[begin:end])
                key = [table.column(k).take(pa.array(np.full(len(starts), begin))).combine_chunks() for k in keys]
                place = [table.column(c).take(pa.array(begin + starts)).combine_chunks() for c in ("_ref", "tok_pos")]
                yield pa.RecordBatch.from_arrays([*key, *place, pa.array(np.maximum.reduceat(best, starts))], [*keys, "_ref", "tok_pos", "best"])

    return rows


def _pair_rows(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            new, at, means = _positions(table), [], []
            for begin, middle, end, best in _scored(table):
                starts = np.flatnonzero(new[begin:end])
                if len(starts) < end - begin:
                    best = np.maximum.reduceat(best, starts)
                n = int(np.searchsorted(starts, middle - begin))
                at.append(begin)
                means.append((best[:n].mean(), best[n:].mean()))
            if at:
                taken = [table.column(k).take(pa.array(at)).combine_chunks() for k in keys]
                yield pa.RecordBatch.from_arrays([*taken, *[pa.array(m) for m in zip(*means)]], [*keys, "precision", "recall"])

    return rows


def _side_by_side(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The tokens of each pair in order, predictions first. A null key is no pair."""
    known = tokens.where(F.col("side").isin("pred", "ref")).dropna(subset=keys)
    columns = known.select(*keys, (F.col("side") == "ref").alias("_ref"), "tok_pos", "vec")
    first = with_first(columns, keys, ["_ref", "tok_pos"])
    # only the first row of a pair is asked for its key
    return first.select(*[F.when(F.col("_first"), F.col(k)).alias(k) for k in keys], "_first", "_ref", "tok_pos", "vec")


def token_best(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Best cosine of every token with a token of the other side."""
    fields = [tokens.schema[k] for k in keys] + [T.StructField("_ref", T.BooleanType()), tokens.schema["tok_pos"], T.StructField("best", T.DoubleType())]
    rows = _side_by_side(tokens, keys).mapInArrow(_token_rows(keys), T.StructType(fields))
    return rows.select(*keys, F.when(F.col("_ref"), "ref").otherwise("pred").alias("side"), "tok_pos", "best")


def bertscore_pairs(tokens: DataFrame, keys: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """precision, recall, f1 per pair; 0 when either side has no tokens.

    `pairs` lists all pairs (columns `keys`): one without any token scores 0 too.
    """
    fields = [tokens.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in ("precision", "recall")]
    found = _side_by_side(tokens, keys).mapInArrow(_pair_rows(keys), T.StructType(fields))
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    listed = tokens.select(*keys).distinct() if pairs is None else pairs.select(*keys)
    return listed.join(found, keys, "left").select(*keys, p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    )


def bertscore(
    tokens: DataFrame, by: list[str], baseline: dict[str, float] | None = None, keys: list[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Means in percent per group over all `pairs`; with a `baseline` also rescaled as (x - b) / (1 - b)."""
    pairs = bertscore_pairs(tokens, keys or ["pair_id", *by], pairs)
    columns = []
    for name in ("f1", "recall", "precision"):
        columns.append((F.avg(name) * 100).alias(f"bertscore_{name}"))
        if baseline is not None:
            b = baseline[name]
            columns.append((F.avg((F.col(name) - b) / (1 - b)) * 100).alias(f"bertscore_{name}_rescaled"))
    return pairs.groupBy(*by).agg(*columns)
