"""Connected components of a graph given by edges, all in Spark tables.

Each task first replaces its edges by a spanning forest of stars; then rounds of large-star and
small-star (Kiveris et al., 2014) run until nothing changes. Every round is a written table, so a lost
executor repeats one round at most. Only counts and check sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.session import written


class Forest:
    """Union-find over hashable nodes; the root of a tree is its least node."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def stars(self) -> list[tuple]:
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.join(a, b)
        if len(held.up) > 500_000:  # bounded memory: give out what is known and start afresh
            yield _edges(held.stars())
            held = Forest()
    yield _edges(held.stars())


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a bigint, b bigint) that is not the least of its component.

    Empty edges give no rows; loops and repeated edges change nothing; null ends are not allowed.
    """
    now = written(edges.where("a <> b").mapInArrow(_forest, "a bigint, b bigint"), "stars")
    state = _state(now)
    while state[0]:
        new = written(_small_star(_large_star(now)), "stars")
        before, state, now = state, _state(new), new
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
