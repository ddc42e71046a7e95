"""Column functions on ARRAY<FLOAT> vectors; sums run in DOUBLE and in array order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed one time per row: lambdas would compute it per element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Divide by the L2 length; a zero vector stays zero."""

    def scaled(size: Column) -> Column:
        return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))

    return once(length(a), scaled)
