"""Vectors of Arrow list columns as numpy matrices, inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LARGEST = 2.0**62


@dataclass
class Lists:
    """`length` is -1 where the vector is null or holds a null or non-finite entry."""

    length: np.ndarray
    start: np.ndarray
    values: np.ndarray

    def of_width(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, matrix) of the whole vectors of that width."""
        at = np.flatnonzero(self.length == width)
        return at, self.values[self.start[at][:, None] + np.arange(width)]


def lists(column: pa.Array) -> Lists:
    """`column` holds lists of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return Lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    length = np.diff(offsets)
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    return Lists(np.where(whole, length, -1), offsets[:-1], values)


def floored(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as long; an error where a long cannot hold it."""
    out = np.floor(scale * values)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"an entry times {scale} does not fit a long")
    return out.astype(np.int64)


def decimals(values: np.ndarray) -> pa.Array:
    """Integers (int64, or Python integers in an object array) as decimal(38,0)."""
    if values.dtype == object:
        from decimal import Context

        wide = Context(prec=60)
        return pa.array([wide.create_decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))
