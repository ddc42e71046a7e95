"""Exact inner-product search, k nearest items per query and task, with bounds.

A bounded sample of the corpus, the pilot, is scored first: its k-th best similarity per query and task is
a threshold that the true k-th best never lies below. Items are then met in blocks around the pilot's
centres. No item of a block is more similar than (query . centre) + |query| * radius, nor than
|query| * (largest norm); a block below a query's threshold is never multiplied with it, and nothing below
the threshold leaves a task. The pilot only decides how much is skipped, never what is found.

Three ways, chosen by measured size:

* queries fit the limit: ship them, in shares, and stream the corpus past each share;
* corpus fits the limit: ship it, in shares, and stream the queries past each share;
* neither fits: cut both sides into blocks; block pairs whose bound reaches a threshold meet in an
  equi-join, the others are never copied.

A task holds one share (at most SHARE bytes) and the rows of one batch, or one block pair; products are made in
tiles of TILE numbers and results leave in parts. So the memory of a Python worker does not follow the tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritas.operators.numbering import top_rows
from claritas.session import scratch_path, written

SHIP_LIMIT = 64 << 20
SHARE = 16 << 20  # of what is shipped, how much one task holds
BLOCK_ROWS = 2048
MIN_BLOCK = 256
TILE = 1 << 17  # numbers of a matrix product that stand at once
PART = 16_384  # queries whose results leave a task together
PILOT = 4096  # rows of the corpus that set the thresholds
CENTRES = 64
DIGITS = 9  # equal vectors must tie whatever order a matrix product adds in
SLACK = 3e-9  # of a bound against a threshold: more than rounding to DIGITS can move either
OUT = "query_id long, item_id long, task string, similarity double"
OUT_TYPES = {"query_id": "int64", "item_id": "int64", "task": "object", "similarity": "float64"}


# --- inside a task


def _matrix(vectors) -> np.ndarray:
    """Single precision stays as it is until it is multiplied: half the memory, the same numbers."""
    rows = list(vectors)
    narrow = all(isinstance(v, np.ndarray) and v.dtype == np.float32 for v in rows)
    return np.stack(rows) if narrow else np.stack([np.asarray(v, dtype=np.float64) for v in rows])


def _slices(n: int, width: int) -> Iterator[slice]:
    """0..n-1 in runs of rows that hold at most TILE numbers of `width` a row."""
    step = max(1, TILE // max(1, width))
    for start in range(0, n, step):
        yield slice(start, start + step)


def _rowwise(vectors: np.ndarray, of) -> np.ndarray:
    """`of` (rows in double precision) over all rows, some at a time."""
    parts = [of(vectors[some].astype(np.float64, copy=False)) for some in _slices(*vectors.shape)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _norms(vectors: np.ndarray) -> np.ndarray:
    return _rowwise(vectors, lambda v: np.sqrt((v * v).sum(1)))


def _scores(asked: np.ndarray, items: np.ndarray) -> np.ndarray:
    scores = asked.astype(np.float64, copy=False) @ items.T
    return np.round(scores, DIGITS, out=scores)


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    turned = np.negative(scores)
    turned.partition(k - 1, axis=1)
    return -turned[:, k - 1]


@dataclass
class Asked:
    """Queries and what each must reach per task (`least`, minus infinity where nothing is known)."""

    ids: np.ndarray
    vectors: np.ndarray
    least: dict = field(default_factory=dict)

    def __post_init__(self):
        self.norms = _norms(self.vectors)


@dataclass
class Block:
    """Items of one task around one centre, ids ascending."""

    task: str | None
    ids: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.centre = self.vectors.mean(0, dtype=np.float64)
        self.radius = float(_norms(self.vectors - self.centre).max())
        self.far = float(_norms(self.vectors).max())

    def bound(self, asked: Asked) -> np.ndarray:
        around = _rowwise(asked.vectors, lambda v: v @ self.centre) + asked.norms * self.radius
        most = np.minimum(around, asked.norms * self.far)
        return most + SLACK * (1.0 + asked.norms * self.far)


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros(len(vectors), np.int64)
    sizes = (centres * centres).sum(1)[None, :]
    return np.concatenate([(sizes - 2 * (vectors[some] @ centres.T)).argmin(1) for some in _slices(len(vectors), len(centres))])


def blocks_of(items: pd.DataFrame, centres: np.ndarray) -> Iterator[Block]:
    """`items` (item_id, embedding, task) by task and nearest centre, at most BLOCK_ROWS in a block."""
    for task, part in items.groupby("task", sort=False, dropna=False):
        vectors, ids = _matrix(part["embedding"]), part["item_id"].to_numpy()
        near = nearest_centre(vectors, centres)
        order = np.lexsort((ids, near))
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        for run in np.split(order, cuts):
            for start in range(0, len(run), BLOCK_ROWS):
                at = run[start : start + BLOCK_ROWS]
                yield Block(None if pd.isna(task) else task, ids[at], vectors[at])


class Search:
    """The k best items per query and task over the blocks given so far."""

    def __init__(self, asked: Asked, k: int, skip_self: bool):
        self.asked, self.k, self.skip_self = asked, k, skip_self
        self.kept: dict = {}
        self.met = self.opened = 0  # (block, query) pairs, and those that were multiplied

    def _state(self, task) -> tuple[np.ndarray, np.ndarray]:
        if task not in self.kept:
            shape = (len(self.asked.ids), self.k)
            self.kept[task] = (np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max))
        return self.kept[task]

    def floor(self, task) -> np.ndarray:
        least = self.asked.least.get(task)
        now = self._state(task)[0][:, -1]
        return now if least is None else np.maximum(now, least - SLACK * (1.0 + np.abs(least)))

    def add(self, block: Block) -> None:
        open_ = np.flatnonzero(block.bound(self.asked) >= self.floor(block.task))
        self.met += len(self.asked.ids)
        self.opened += len(open_)
        if len(open_):
            items = block.vectors.astype(np.float64, copy=False)
            for some in _slices(len(open_), max(items.shape)):
                self._multiply(block, items, open_[some])

    def _multiply(self, block: Block, items: np.ndarray, rows: np.ndarray) -> None:
        scores = _scores(self.asked.vectors[rows], items)
        scores += 0.0
        if self.skip_self:
            scores[self.asked.ids[rows][:, None] == block.ids[None, :]] = -np.inf
        edge = self.floor(block.task)[rows][:, None]
        if self.k < scores.shape[1]:
            # everything at least as good as the k-th value, so that ties are settled by id
            edge = np.maximum(edge, _kth_best(scores, self.k)[:, None])
        i, j = np.nonzero((scores >= edge) & np.isfinite(scores))
        if not len(i):
            return
        best, ids = self._state(block.task)
        touched = np.unique(i)
        slot = np.concatenate([i, np.repeat(touched, self.k)])
        value = np.concatenate([scores[i, j], best[rows[touched]].ravel()])
        item = np.concatenate([block.ids[j], ids[rows[touched]].ravel()])
        order = np.lexsort((item, -value, slot))
        slot, value, item = slot[order], value[order], item[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        best[rows[slot[kept]], place[kept]], ids[rows[slot[kept]], place[kept]] = value[kept], item[kept]

    def _found(self, task, some: slice) -> pd.DataFrame:
        best, ids = (x[some] for x in self.kept[task])
        row, place = np.nonzero(np.isfinite(best))
        named = pd.Series([task] * len(row), dtype=object)
        return pd.DataFrame({"query_id": self.asked.ids[some][row], "item_id": ids[row, place], "task": named, "similarity": best[row, place]})

    def parts(self) -> Iterator[pd.DataFrame]:
        """What was found, at most PART queries of a task at a time."""
        step = max(1, PART // self.k)
        for task in self.kept:
            for start in range(0, len(self.asked.ids), step):
                yield self._found(task, slice(start, start + step))

    def found(self) -> pd.DataFrame:
        out = list(self.parts())
        # the types of no rows must be right too: a scan may meet no item, a block pair give nothing
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series([], dtype=t) for c, t in OUT_TYPES.items()})


# --- pilot and thresholds


@dataclass
class Pilot:
    """A sample of the corpus by task, and centres among it."""

    tasks: list
    ids: list[np.ndarray]
    vectors: list[np.ndarray]
    centres: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> "Pilot":
        if not len(rows):
            return cls([], [], [], np.zeros((0, 0)))
        rows = rows.sort_values(["item_id"], kind="stable")
        parts = [(None if pd.isna(t) else t, p) for t, p in rows.groupby("task", sort=True, dropna=False)]
        every = _matrix(rows["embedding"]).astype(np.float64, copy=False)
        centres = every[np.random.default_rng(0).permutation(len(every))[:CENTRES]]
        for _ in range(4):
            near = nearest_centre(every, centres)
            centres = np.stack([every[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return cls([t for t, _ in parts], [p["item_id"].to_numpy() for _, p in parts], [_matrix(p["embedding"]) for _, p in parts], centres)

    def least(self, ids: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
        """(queries, tasks): the k-th best similarity within the pilot."""
        out = np.full((len(ids), len(self.tasks)), -np.inf)
        for t, (own, items) in enumerate(zip(self.ids, self.vectors)):
            if len(own) < k:
                continue
            items = items.astype(np.float64, copy=False)
            for some in _slices(len(ids), max(items.shape)):
                scores = _scores(vectors[some], items)
                if skip_self:
                    scores[ids[some][:, None] == own[None, :]] = -np.inf
                out[some, t] = _kth_best(scores, k)
        return out


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, int, set]:
    """`df` written once (an encoder upstream runs a single time), its rows, and the lengths of its vectors."""
    seen, size = Observation(), F.coalesce(F.size("embedding"), F.lit(-1))
    path = scratch_path(df.sparkSession, name)
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).write.parquet(path)
    found = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), found["n"], {found["low"], found["high"]} - {None}


def _pilot(corpus: DataFrame, n: int) -> Pilot:
    share = min(1.0, PILOT / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit("pilot"), "item_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = corpus if share == 1.0 else corpus.where(drawn).limit(2 * PILOT)
    return Pilot.of(picked.toPandas())


def _with_least(queries: DataFrame, pilot: Pilot, k: int, skip_self: bool, width: int) -> DataFrame:
    """`queries` with their thresholds, in the order of the pilot's tasks."""
    shared = queries.sparkSession.sparkContext.broadcast(pilot)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            good = len(part) and all(v is not None and len(v) == width for v in part["embedding"])
            # a bad vector is found by the caller, who sees the lengths of all
            least = shared.value.least(part["query_id"].to_numpy(), _matrix(part["embedding"]), k, skip_self) if good else np.zeros((len(part), 0))
            yield part.assign(least=list(least))

    return queries.mapInPandas(add, T.StructType([*queries.schema.fields, T.StructField("least", T.ArrayType(T.DoubleType()))]))


def _asked(rows: pd.DataFrame, tasks: list) -> Asked:
    least = np.stack([np.asarray(x, np.float64) for x in rows["least"]]) if "least" in rows and tasks else np.zeros((len(rows), 0))
    return Asked(rows["query_id"].to_numpy(), _matrix(rows["embedding"]), {t: least[:, i] for i, t in enumerate(tasks)} if tasks and "least" in rows else {})


# --- over tables


def top_k(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, limit: int = SHIP_LIMIT) -> DataFrame:
    """(query_id, embedding) x (item_id, embedding, task) to (query_id, item_id, task, similarity, rank)."""
    found = candidates(queries, corpus, k, exclude_self, limit)
    return top_rows(found, ["query_id", "task"], [F.col("similarity").desc(), F.col("item_id")], k)


def candidates(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, limit: int = SHIP_LIMIT) -> DataFrame:
    """What leaves the tasks: for every query and task its k best items, and few others."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    corpus = corpus.select(F.col("item_id").cast("long").alias("item_id"), "embedding", F.col("task").cast("string").alias("task"))
    corpus, n_items, lengths = _stored(corpus, "corpus")
    if len(lengths) > 1 or lengths & {-1}:
        raise ValueError(f"vectors must not be null and must have one length; found lengths {sorted(lengths)}")
    pilot = _pilot(corpus, n_items)
    queries, n_queries, more = _stored(_with_least(queries, pilot, k, exclude_self, max(lengths, default=0)), "queries")
    if len(lengths | more) > 1 or more & {-1}:
        raise ValueError(f"vectors must not be null and must have one length; found lengths {sorted(lengths | more)}")
    if not n_queries or not n_items:
        return queries.sparkSession.createDataFrame([], T._parse_datatype_string(OUT))
    width = max(lengths)
    row = 8 * (width + 2)
    kept = len(pilot.tasks) * (8 + 16 * k)  # a query's thresholds, and its best items and their similarities
    if n_queries * (row + kept) <= limit:
        return _ship_queries(queries, corpus, k, exclude_self, pilot, max(1, SHARE // (row + kept)))
    if n_items * row <= limit:
        return _ship_corpus(queries, corpus, k, exclude_self, pilot, max(1, SHARE // row))
    return _meet_blocks(queries, corpus, k, exclude_self, width, limit, pilot)


def _shares(blocks: Iterable[Block], rows: int) -> Iterator[list[Block]]:
    """Neighbouring blocks, about `rows` rows together; a task's blocks are neighbours, so most meet in one share."""
    share, held = [], 0
    for block in blocks:
        if share and held + len(block.ids) > rows:
            yield share
            share, held = [], 0
        share.append(block)
        held += len(block.ids)
    if share:
        yield share


def _ship_queries(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, pilot: Pilot, rows: int) -> DataFrame:
    every = queries.toPandas()

    def past(some: pd.DataFrame) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast((_asked(some, pilot.tasks), pilot.centres))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, centres = shared.value
            search = Search(asked, k, skip_self)
            for part in batches:
                for block in blocks_of(part, centres):
                    search.add(block)
            yield from search.parts()

        return corpus.mapInPandas(scan, OUT)

    return reduce(DataFrame.union, [past(every.iloc[start : start + rows]) for start in range(0, len(every), rows)])


def _ship_corpus(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, pilot: Pilot, rows: int) -> DataFrame:
    def past(share: list[Block]) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast((share, pilot.tasks))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks, tasks = shared.value
            for part in batches:
                if len(part):
                    search = Search(_asked(part, tasks), k, skip_self)
                    for block in blocks:
                        search.add(block)
                    yield from search.parts()

        return queries.mapInPandas(scan, OUT)

    return reduce(DataFrame.union, [past(share) for share in _shares(blocks_of(corpus.toPandas(), pilot.centres), rows)])


def _placed(df: DataFrame, key: str, centres: np.ndarray, rows: int) -> tuple[DataFrame, int]:
    """`df` with a block number: a nearest centre, salted by id where it has more than `rows` rows; and how many."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(_near=nearest_centre(_matrix(part["embedding"]), centres) if len(part) else [])

    placed = written(df.mapInPandas(near, T.StructType([*df.schema.fields, T.StructField("_near", T.IntegerType())])), "placed")
    sizes = {r["_near"]: r["count"] for r in placed.groupBy("_near").count().collect()}  # a row per centre
    salts = [-(-sizes.get(c, 0) // rows) for c in range(max(1, len(centres)))]
    first = np.concatenate([[0], np.cumsum(salts)]).tolist()
    look = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_near") + 1)
    number = look(first[:-1]) + F.pmod(F.xxhash64(key), look(salts)).cast("int")
    return placed.withColumn("_block", number.cast("int")).drop("_near"), first[-1]


def _summary(df: DataFrame, name: str) -> DataFrame:
    """(name, centre, norm, radius, least) of each block; `least` is the smallest threshold of its queries."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(rows["embedding"])
        centre = vectors.mean(0, dtype=np.float64)
        least = min((float(np.min(x)) if len(x) else -np.inf for x in rows["least"]), default=-np.inf) if "least" in rows else -np.inf
        radius = float(_rowwise(vectors, lambda v: _norms(v - centre)).max())
        return pd.DataFrame({name: [int(rows["_block"].iloc[0])], "centre": [centre], "norm": [float(np.sqrt(centre @ centre))], "radius": [radius], "least": [least]})

    return df.groupBy("_block").applyInPandas(one, f"{name} int, centre array<double>, norm double, radius double, least double")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def block_pairs(queries: DataFrame, corpus: DataFrame, n_items: int, bounded: bool) -> DataFrame:
    """(_q, _c): blocks of queries and of items of which some pair may reach the queries' least threshold."""
    left = _summary(queries, "_q").withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
    right = _summary(corpus, "_c").drop("least").select("_c", *[F.col(c).alias(f"_{c}") for c in ("centre", "norm", "radius")])
    most = _dot(F.col("centre"), F.col("_centre")) + F.col("radius") * F.col("_norm") + F.col("norm") * F.col("_radius") + F.col("radius") * F.col("_radius")
    slack = SLACK * (1.0 + (F.col("norm") + F.col("radius")) * (F.col("_norm") + F.col("_radius")) + F.abs("least"))
    met = left.join(right, "_c")
    return (met.where(F.isnull("least") | (F.col("least") == float("-inf")) | (most + slack >= F.col("least"))) if bounded else met).select("_q", "_c")


def _meet_blocks(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, width: int, limit: int, pilot: Pilot | None = None) -> DataFrame:
    """Blocks around centres on both sides; only block pairs within reach are copied, each pair one small task."""
    pilot = Pilot([], [], [], np.zeros((0, 0))) if pilot is None else pilot
    rows = max(MIN_BLOCK, min(limit // (16 * width) if limit else BLOCK_ROWS, 16 * BLOCK_ROWS))
    asked, _ = _placed(queries, "query_id", pilot.centres, rows)
    items, n_items = _placed(corpus, "item_id", pilot.centres, rows)
    # thresholds say nothing on tasks that the pilot lacks or holds less than k times
    known = corpus.select("task").distinct().count() == len(pilot.tasks) and all(len(i) >= k + skip_self for i in pilot.ids)
    pairs = written(block_pairs(asked, items, n_items, known), "block-pairs")
    left = asked.withColumnRenamed("_block", "_q").join(pairs, "_q")
    right = items.withColumnRenamed("_block", "_c").join(pairs, "_c")
    centres, tasks = pilot.centres, pilot.tasks

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        search = Search(_asked(q, tasks), k, skip_self)
        for block in blocks_of(c, centres):
            search.add(block)
        return search.found()

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInPandas(cell, OUT)


def neighbours(vectors: DataFrame, k: int, of: DataFrame | None = None, limit: int = SHIP_LIMIT) -> DataFrame:
    """The k nearest stored rows of stored rows (`item_id`, `embedding`), never the row itself."""
    queries = (vectors if of is None else of).select(F.col("item_id").alias("query_id"), "embedding")
    everything = vectors.select("item_id", "embedding", F.lit("all").alias("task"))
    return top_k(queries, everything, k, exclude_self=True, limit=limit).drop("task")


def index_gaps(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only; an embedding snapshot is valid when this is empty."""
    without_vector = rows.select(*keys).join(vectors.select(*keys), keys, "left_anti").withColumn("missing", F.lit("vector"))
    without_row = vectors.select(*keys).join(rows.select(*keys), keys, "left_anti").withColumn("missing", F.lit("row"))
    return without_vector.unionByName(without_row)
