"""Embedding whitening: leading eigenvectors of an exact covariance by spectrum slicing.

Entries become integers (floor(scale * entry) + shift). One scan sums them by dimension, a second one
sums the products of entries centred at the rounded mean; both are exact sums of integers, made in
tasks first and then in a grouping by cell, so the driver gets width * (width + 1) / 2 numbers, whatever
the number of rows. From these the covariance is exact before it is rounded to doubles once.

Slicing: the LDLᵀ factors of the covariance minus a shift have as many positive pivots as there are
eigenvalues above the shift (Sylvester's law of inertia). Bisection by these counts isolates each
leading eigenvalue; Rayleigh quotient iteration inside its interval converges cubically; counts on both
sides of the result certify its number. Eigenvalues that no double separates are one cluster: their
vectors come from inverse iteration, each made orthogonal to those before.

Rows whose vector is null or holds a null or non-finite entry take no part and get no row. So do empty
vectors and, where widths differ, all but those of the commonest width (a tie: the longer). Components
whose variance is below NOUGHT of the whole are zero within double precision and cannot be whitened: no
rows for them, and none at all for a single vector, for equal vectors or for an empty table. Repeated
rows count each time; a null id stays. Names in `keep` must not be names of results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import vectors as V
from claritas.session import written

NOUGHT = 1e-10
EPS = float(np.finfo(float).eps)
ALPHA = (1 + 17**0.5) / 8
SMALL = 1 << 21
BLOCK = 1 << 11  # rows of a float product: SMALL * SMALL * BLOCK stays below 2**53
BLOCKS = 256  # float products summed in 64-bit integers before they are given out
OUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- eigenvalues of a symmetric matrix


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: positive pivots of LDLᵀ with 1x1 and 2x2 pivots (Bunch and Parlett)."""
    b = a - shift * np.eye(len(a))
    count = 0
    while len(b):
        diagonal = np.abs(np.diagonal(b))
        p = int(diagonal.argmax())
        off = np.abs(b)
        np.fill_diagonal(off, 0.0)
        r, c = divmod(int(off.argmax()), len(b))
        if diagonal[p] >= ALPHA * off[r, c]:
            pivot = b[p, p]
            if pivot == 0.0:
                break
            count += pivot > 0
            rest = np.delete(np.arange(len(b)), p)
            column = b[rest, p]
            b = b[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:  # such a pair has one eigenvalue of each sign
            count += 1
            rest = np.delete(np.arange(len(b)), [r, c])
            pair = b[np.ix_([r, c], [r, c])]
            columns = b[np.ix_(rest, [r, c])]
            b = b[np.ix_(rest, rest)] - columns @ np.linalg.solve(pair, columns.T)
        b = (b + b.T) / 2
    return int(count)


def _solve(a: np.ndarray, shift: float, v: np.ndarray, size: float) -> np.ndarray:
    for nudge in (0.0, EPS * size, 4 * EPS * size, 64 * EPS * size):
        try:
            w = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and np.abs(w).max() > 0:
            w = w / np.abs(w).max()
            return w / np.sqrt(w @ w)
    return v


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.sqrt(v @ v)


class Slices:
    """Counts at shifts already factored; brackets of the k-th largest eigenvalue."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.size = float(np.abs(a).sum(1).max())
        edge = self.size * (1 + 1e-6)
        self.known = {-edge: len(a), edge: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.a, shift)
        return self.known[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        low = max(s for s, c in self.known.items() if c >= k)
        return low, min(s for s, c in self.known.items() if c < k and s > low)

    def isolate(self, k: int, width: float) -> tuple[float, float]:
        """A bracket that holds the k-th eigenvalue alone, or one no wider than `width`."""
        low, high = self.bracket(k)
        while (self.count(low) != k or self.count(high) != k - 1) and high - low > width:
            self.count((low + high) / 2)
            low, high = self.bracket(k)
        return low, high

    def halve(self, k: int) -> tuple[float, float]:
        low, high = self.bracket(k)
        self.count((low + high) / 2)
        return self.bracket(k)


def _rayleigh(a: np.ndarray, low: float, high: float, size: float, seed: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
    v = _apart(np.random.default_rng(seed).standard_normal(len(a)), found)
    for _ in range(2):  # inverse iteration at the middle first, then the quotient is the shift
        v = _solve(a, (low + high) / 2, v, size)
    value = float(v @ a @ v)
    for _ in range(16):
        off = a @ v - value * v
        if float(np.sqrt(off @ off)) <= 8 * EPS * size:
            break
        v = _solve(a, value, v, size)
        value = float(v @ a @ v)
    return value, v


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric `a`, falling, and their unit vectors as columns.

    The largest entry of a vector is positive. Raises if the counts do not certify a number.
    """
    slices = Slices(a)
    size = slices.size
    if size == 0.0:
        return np.zeros(k), np.eye(len(a), k)
    tight = 32 * max(len(a), 16) * EPS * size  # well above the rounding of a factorisation
    values, found = [], []
    for i in range(1, k + 1):
        low, high = slices.isolate(i, tight)
        alone = slices.count(low) == i and slices.count(high) == i - 1
        value, v = _rayleigh(a, low, high, size, i, found)

        def certified() -> bool:
            off = a @ v - value * v  # noqa: B023
            near = float(np.sqrt(off @ off)) <= tight
            return near and slices.count(value - tight) >= i and slices.count(value + tight) <= i - 1  # noqa: B023

        # the iteration may run to another eigenvalue: a narrower bracket starts it nearer
        while alone and not certified() and high - low > tight:
            low, high = slices.halve(i)
            value, v = _rayleigh(a, low, high, size, i, found)
        if not alone or not certified():
            # a cluster: any orthogonal vectors of its space will do
            v = _apart(np.random.default_rng(i).standard_normal(len(a)), found)
            for _ in range(8):
                v = _apart(_solve(a, (low + high) / 2, v, size), found)
        else:
            v = _apart(v, found)
        value = float(v @ a @ v)
        if not certified():
            raise ArithmeticError(f"eigenvalue {i} is not certified")
        v = v if v[np.abs(v).argmax()] > 0 else -v
        values.append(value)
        found.append(v)
    return np.array(values), np.stack(found, 1) if found else np.zeros((len(a), 0))


# --- exact sums in tasks


def _integers(values: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return V.floored(values, scale) + shift


def _sums(batches: Iterator[pa.RecordBatch], scale: float, shift: int) -> Iterator[pa.RecordBatch]:
    """(width, dim, n, total) of this task."""
    totals: dict[int, list] = {}
    for batch in batches:
        read = V.lists(batch.column(0))
        for width in np.unique(read.length[read.length > 0]):
            at, values = read.of_width(int(width))
            x = _integers(values, scale, shift)
            wide = np.abs(x).max() > (1 << 62) // len(x)
            held = totals.setdefault(int(width), [0, np.zeros(int(width), object)])
            held[0] += len(at)
            held[1] = held[1] + (x.astype(object) if wide else x).sum(0).astype(object)
    for width, (n, total) in totals.items():
        columns = [pa.array(np.full(width, width), pa.int32()), pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, n), pa.int64()), V.decimals(total)]
        yield pa.RecordBatch.from_arrays(columns, ["width", "dim", "n", "total"])


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray, scale: float, shift: int) -> Iterator[pa.RecordBatch]:
    """(i, j, total) with i <= j: sums of products of centred entries in this task."""
    width = len(centre)
    i, j = np.triu_indices(width)

    def given(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), V.decimals(total[i, j])], ["i", "j", "total"])

    held, blocks = np.zeros((width, width), np.int64), 0
    for batch in batches:
        _, values = V.lists(batch.column(0)).of_width(width)
        z = _integers(values, scale, shift) - centre
        for k in range(0, len(z), BLOCK):
            part = z[k : k + BLOCK]
            if np.abs(part).max() >= SMALL:
                wide = part.astype(object)
                yield given(wide.T @ wide)
                continue
            exact = part.astype(np.float64)
            held += (exact.T @ exact).astype(np.int64)
            blocks += 1
            if blocks == BLOCKS:
                yield given(held)
                held, blocks = np.zeros((width, width), np.int64), 0
    if blocks:
        yield given(held)


@dataclass
class Whitening:
    """`vectors` has a column per component; `centre` + `rest` / `n` is the mean."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    scale: float
    shift: int


def fit(table: DataFrame, column: str = "embedding", components: int = 8, scale: float = 1.0, shift: int = 0) -> Whitening | None:
    """Leading components of the vectors of `table`; None where it has no vector."""
    spark = table.sparkSession
    listed = table.select(F.col(column).cast("array<double>").alias("v"))
    sums = listed.mapInArrow(lambda batches: _sums(batches, scale, shift), "width int, dim int, n bigint, total decimal(38,0)")
    sums = written(sums.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")), "whitening-sums")
    first = sums.where("dim = 0").orderBy(F.col("n").desc(), F.col("width").desc()).first()
    if first is None:
        return None
    width, n = first["width"], first["n"]
    total = [int(r["total"]) for r in sums.where(F.col("width") == width).orderBy("dim").collect()]
    centre = np.array([t // n for t in total], np.int64)
    rest = [t - n * int(c) for t, c in zip(total, centre)]
    products = listed.mapInArrow(lambda batches: _products(batches, centre, scale, shift), "i int, j int, total decimal(38,0)")
    cells = products.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    exact = np.zeros((width, width), object)
    for r in cells:
        exact[r["i"], r["j"]] = exact[r["j"], r["i"]] = n * int(r["total"]) - rest[r["i"]] * rest[r["j"]]
    covariance = np.array([[int(x) / (n * n) for x in row] for row in exact])
    trace = sum(int(x) for x in np.diagonal(exact)) / (n * n)
    values, found = leading(covariance, min(components, width))
    kept = int((values > NOUGHT * trace).sum())
    values, found = values[:kept], found[:, :kept]
    unit = found / np.sqrt(values)
    error = float(np.abs(unit.T @ covariance @ unit - np.eye(kept)).max()) if kept else 0.0
    return Whitening(n, centre, rest, values, found, trace, error, scale, shift)


# --- rows


def _deviation(z: np.ndarray, n: int, rest: list[int]) -> np.ndarray:
    """sum((n * x - S)**2) by row, exact."""
    bound = n * max(int(z.max()), -int(z.min())) + max(abs(r) for r in rest) if z.size else 0
    if bound * bound * z.shape[1] < 1 << 63:
        away = n * z - np.array(rest, np.int64)
    else:
        away = z.astype(object) * n - np.array(rest, object)
    return (away * away).sum(1)


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening, names: list[str]) -> Iterator[pa.RecordBatch]:
    count = len(model.values)
    mean = np.array([r / model.n for r in model.rest])
    unit = model.vectors / np.sqrt(model.values)
    for batch in batches:
        at, values = V.lists(batch.column(0)).of_width(len(model.centre))
        if not len(at):
            continue
        z = _integers(values, model.scale, model.shift) - model.centre
        white = (z - mean) @ unit
        size = len(at) * count
        take = pa.array(np.repeat(at, count))
        each = np.repeat(np.arange(len(at)), count)
        made = [
            pa.array(np.tile(np.arange(1, count + 1), len(at)), pa.int32()),
            pa.array(np.full(size, model.n), pa.int64()),
            V.decimals(_deviation(z, model.n, model.rest)).take(pa.array(each)),
            pa.array(white.ravel()),
            pa.array(np.tile(model.values / model.trace, len(at))),
            pa.array(np.full(size, model.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(1, batch.num_columns)], *made], names)


def whiten(table: DataFrame, model: Whitening | None, keep: list[str], column: str = "embedding") -> DataFrame:
    """Columns `keep` of `table` and a row for each component of its vector."""
    kinds = dict(table.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], OUT])
    names = [*keep, *[c.split()[0] for c in OUT.split(", ")]]
    if len({c.lower() for c in names}) < len(names):
        raise ValueError("a kept column has the name of a result")
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], schema)
    listed = table.select(F.col(column).cast("array<double>").alias("_vector"), *keep)
    return listed.mapInArrow(lambda batches: _rows(batches, model, names), schema)
