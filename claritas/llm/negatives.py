"""Hard-negative mining by segment summaries: exact search that skips rows by bounds.

A vector is cut into segments, in levels of 1, 4, 16, ... of them; each segment stores its mean and its
deviation. The inner product over a segment of length L lies in L * (product of means -/+ product of
deviations), by Cauchy and Schwarz, so the summed bounds hold for the whole vectors. A pair is refined
level by level and scored exactly only while its bounds still allow it a place.

Rows become integer vectors (floor(scale * entry)) with their summaries, written once in the scratch
folder. Anchors come in blocks of `block` rows (files of at most that many records), which bounds what
is sent to the tasks. For each block one scan finds the best positives: a task keeps the best `top` of
each anchor, so it gives out block * top rows at most, and a second scan finds the negatives inside the
window of each anchor and positive in the same way. Anchors meet all rows, in blocks; no pair of rows
leaves a task without a place among that task's best.

Higher scores come first, ties by smaller id. Rows with a null id or label, or a vector that is null,
empty or holds a null or non-finite entry, take no part; rows of another width than an anchor's are
never its candidates. An anchor's candidates have another id than the anchor. Repeated rows are rows of
their own: each takes a place, and a repeated anchor repeats its results. An empty table gives no rows.
Other columns are not read. An error where inner products could leave a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claritas.llm import vectors as V
from claritas.session import scratch_path, written

BLOCK = 16_384  # anchors sent to the tasks at once
ROWS = 4_096  # rows scored at once in a task
ANCHORS = 512  # anchors scored at once in a task
OPEN = 0.25  # share of surviving pairs above which a level is one matrix product
STORED = "id bigint, label bigint, width int, x binary, summary binary, peak bigint"
FOUND = "anchor int, slot int, id bigint, score bigint"
LEAST = np.iinfo(np.int64).min


# --- summaries


def levels(width: int) -> list[int]:
    """Numbers of segments: 1, 4, 16, ... while a segment has two entries at least."""
    out = [1]
    while out[-1] * 8 <= width:
        out.append(out[-1] * 4)
    return out


def summaries(x: np.ndarray) -> np.ndarray:
    """Mean and deviation of each segment, times the root of its length, level after level."""
    out = []
    for count in levels(x.shape[1]):
        edges = np.linspace(0, x.shape[1], count + 1).astype(int)
        size = np.diff(edges)
        total = np.add.reduceat(x, edges[:-1], axis=1)
        mean = total / size
        away = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1)
        out += [mean * np.sqrt(size), np.sqrt(away)]
    return np.concatenate(out, axis=1)


def parts(width: int) -> list[tuple[slice, slice]]:
    """Where the means and the deviations of each level stand in a summary."""
    out, at = [], 0
    for count in levels(width):
        out.append((slice(at, at + count), slice(at + count, at + 2 * count)))
        at += 2 * count
    return out


def _stored(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = V.lists(batch.column(2))
        for width in np.unique(read.length[read.length > 0]):
            at, values = read.of_width(int(width))
            x = V.floored(values, scale)
            peak = np.abs(x).max(1)
            if len(x) and int(peak.max()) ** 2 * int(width) >= 1 << 62:
                raise ValueError("inner products do not fit a long")
            short = summaries(x.astype(np.float64)).astype(np.float32)
            take = pa.array(at)
            made = [pa.array(np.full(len(at), width), pa.int32()), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in short]), pa.array(peak)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *made], ["id", "label", "width", "x", "summary", "peak"])


def stored(rows: DataFrame, scale: float, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """The table of `STORED` rows, written."""
    known = rows.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    plain = known.select(F.col(id_).cast("bigint"), F.col(label).cast("bigint"), F.col(vector).cast("array<double>"))
    return written(plain.mapInArrow(lambda batches: _stored(batches, scale), STORED), "negatives")


# --- search inside a task


class Side:
    """Rows of one width: ids, labels, integer vectors and summaries."""

    def __init__(self, ids, labels, x, short):
        self.ids, self.labels, self.x, self.short = ids, labels, x, short

    def some(self, at) -> "Side":
        return Side(self.ids[at], self.labels[at], self.x[at], self.short[at])


def sides(batch: pa.RecordBatch) -> Iterator[Side]:
    ids, labels, widths = (batch.column(k).to_numpy() for k in range(3))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        at = at[np.argsort(ids[at], kind="stable")]
        read = lambda column, kind: np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1)  # noqa: B023, E731
        yield Side(ids[at], labels[at], read(batch.column(3), np.int64), read(batch.column(4), np.float32))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where no sum leaves 2**53, longs otherwise."""
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if high < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounded(a: Side, b: Side, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs whose bounds allow a score from least to most (by anchor): refined level by level."""
    x, y = a.short.astype(np.float64), b.short.astype(np.float64)
    # summaries are single precision: a slack well above their rounding keeps every pair that may count
    slack = 1e-5 * (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]) + 1.0
    for mean, deviation in parts(a.x.shape[1]):
        share = np.count_nonzero(alive) / max(alive.size, 1)
        if share == 0.0:
            break
        if share > OPEN:
            middle, off = x[:, mean] @ y[:, mean].T, x[:, deviation] @ y[:, deviation].T
            alive &= (middle + off + slack >= least[:, None]) & (middle - off - slack <= most[:, None])
        else:
            i, j = np.nonzero(alive)
            middle = np.einsum("ij,ij->i", x[i][:, mean], y[j][:, mean])
            off = np.einsum("ij,ij->i", x[i][:, deviation], y[j][:, deviation])
            kept = (middle + off + slack[i, j] >= least[i]) & (middle - off - slack[i, j] <= most[i])
            alive[i[~kept], j[~kept]] = False
    return alive


class Best:
    """The best `top` (score, id) of each slot so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, top: int):
        self.score = np.full((slots, top), LEAST, np.int64)
        self.id = np.full((slots, top), np.iinfo(np.int64).max, np.int64)

    def floor(self) -> np.ndarray:
        """The score a newcomer must reach (an equal one may win by its id)."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Candidates in any order; slots may repeat."""
        touched = np.unique(slot)
        if not len(touched):
            return
        top = self.score.shape[1]
        every = np.concatenate([slot, np.repeat(touched, top)])
        score = np.concatenate([score, self.score[touched].ravel()])
        id_ = np.concatenate([id_, self.id[touched].ravel()])
        order = np.lexsort((id_, ~score, every))
        every, score, id_ = every[order], score[order], id_[order]
        start = np.searchsorted(every, touched)
        place = np.arange(len(every)) - np.repeat(start, np.diff(np.append(start, len(every))))
        kept = place < top
        self.score[every[kept], place[kept]] = score[kept]
        self.id[every[kept], place[kept]] = id_[kept]

    def rows(self, anchors: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
        at, place = np.nonzero(self.score > LEAST)
        columns = [pa.array(anchors[at], pa.int32()), pa.array(slots[at], pa.int32()), pa.array(self.id[at, place]), pa.array(self.score[at, place])]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Side]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield from sides(batch.slice(k, ROWS))


def _positives(batches: Iterator[pa.RecordBatch], sent, top: int) -> Iterator[pa.RecordBatch]:
    groups, size, _ = sent.value
    best, met, opened = Best(size, top), 0, 0
    for rows in _blocks(batches):
        for at, anchors in groups.get(rows.x.shape[1], []):
            alive = (anchors.labels[:, None] == rows.labels[None, :]) & (anchors.ids[:, None] != rows.ids[None, :])
            met += np.count_nonzero(alive)
            floor = best.floor()[at].astype(np.float64)
            alive = bounded(anchors, rows, alive, floor, np.full(len(at), np.inf))
            i, j, score = opened_scores(anchors, rows, alive)
            opened += len(i)
            kept = score >= best.floor()[at][i]
            best.add(at[i[kept]], score[kept], rows.ids[j[kept]])
    yield best.rows(np.arange(size), np.zeros(size, np.int64))
    yield _tally(met, opened)


def _negatives(batches: Iterator[pa.RecordBatch], sent, top: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    groups, size, found = sent.value
    wanted, known = found  # (anchors, positives) scores and which of them exist
    slots = wanted.shape[1]
    least = -((-num * wanted.astype(object)) // den) if wanted.size else wanted
    least = least.astype(np.int64)
    best, met, opened = Best(size * slots, top), 0, 0
    for rows in _blocks(batches):
        for at, anchors in groups.get(rows.x.shape[1], []):
            any_ = known[at].any(1)
            alive = (anchors.labels[:, None] != rows.labels[None, :]) & (anchors.ids[:, None] != rows.ids[None, :]) & any_[:, None]
            met += np.count_nonzero(alive)
            floor = best.floor().reshape(size, slots)[at]
            low = np.where(known[at], np.maximum(least[at], floor), np.iinfo(np.int64).max).min(1).astype(np.float64)
            high = np.where(known[at], wanted[at], LEAST).max(1).astype(np.float64)
            alive = bounded(anchors, rows, alive, low, high)
            i, j, score = opened_scores(anchors, rows, alive)
            opened += len(i)
            for slot in range(slots):
                now = best.floor().reshape(size, slots)[at][i, slot]
                kept = known[at][i, slot] & (score <= wanted[at][i, slot]) & (score >= least[at][i, slot]) & (score >= now)
                best.add(at[i[kept]] * slots + slot, score[kept], rows.ids[j[kept]])
    yield best.rows(np.repeat(np.arange(size), slots), np.tile(np.arange(slots), size))
    yield _tally(met, opened)


def opened_scores(a: Side, b: Side, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, exact score) of the pairs still alive."""
    i, j = np.nonzero(alive)
    if len(i) > OPEN * alive.size:
        return i, j, scores(a.x, b.x)[i, j]
    return i, j, np.einsum("ij,ij->i", a.x[i], b.x[j])


def _tally(met: int, opened: int) -> pa.RecordBatch:
    """What a task did, under anchor -1: pairs it met and pairs it scored exactly."""
    columns = [pa.array([-1, -1], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([met, opened], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "id", "score"])


# --- search over a table


def _best_of(found: DataFrame, top: int) -> DataFrame:
    """The best `top` of each (anchor, slot) over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.where("anchor >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _anchor_files(table: DataFrame, chosen: Column, block: int) -> list[str]:
    """Paths of files that hold all anchors, `block` rows at most in each."""
    spark = table.sparkSession
    anchors = table.where(chosen)
    count = anchors.count()
    if not count:
        return []
    path = scratch_path(spark, "anchors")
    anchors.repartition(math.ceil(count / block)).write.option("maxRecordsPerFile", block).parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def _groups(anchors: list) -> dict[int, list]:
    """Anchors by width, in groups that are scored at once: (numbers in the block, rows)."""
    out: dict[int, list] = {}
    for width in sorted({r["width"] for r in anchors}):
        at = np.array([k for k, r in enumerate(anchors) if r["width"] == width])
        mine = [anchors[k] for k in at]
        x = np.frombuffer(b"".join(r["x"] for r in mine), np.int64).reshape(len(mine), -1)
        short = np.frombuffer(b"".join(r["summary"] for r in mine), np.float32).reshape(len(mine), -1)
        every = Side(np.array([r["id"] for r in mine]), np.array([r["label"] for r in mine]), x, short)
        out[width] = [(at[k : k + ANCHORS], every.some(slice(k, k + ANCHORS))) for k in range(0, len(at), ANCHORS)]
    return out


def mine(table: DataFrame, chosen: Column, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> tuple[DataFrame | None, DataFrame | None]:
    """Negatives of the anchors `chosen` (a condition on `id`) among the rows of `table` (see `stored`).

    Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first
    `negatives` rows of another label with num/den * positive_score <= score <= positive_score. The
    second table counts (pairs met, pairs scored exactly) by scan. None and None without anchors.
    """
    spark = table.sparkSession
    results, work = [], []
    for number, path in enumerate(_anchor_files(table, chosen, block)):
        anchors = spark.read.schema(table.schema).parquet(path).orderBy("id", "label", "x").collect()
        size = len(anchors)
        groups = _groups(anchors)
        sent = spark.sparkContext.broadcast((groups, size, None))
        near = written(table.mapInArrow(lambda batches, sent=sent: _positives(batches, sent, positives), FOUND), "negatives-near")
        wanted, ids = np.zeros((size, positives), np.int64), np.zeros((size, positives), np.int64)
        known = np.zeros((size, positives), bool)
        for r in _best_of(near, positives).collect():  # positives * block rows at most
            at = r["anchor"], r["rank"] - 1
            wanted[at], ids[at], known[at] = r["score"], r["id"], True
        sent.destroy()
        again = spark.sparkContext.broadcast((groups, size, (wanted, known)))
        far = written(table.mapInArrow(lambda batches, sent=again: _negatives(batches, sent, negatives, num, den), FOUND), "negatives-far")
        again.destroy()
        names = spark.createDataFrame(
            [(a, s, int(anchors[a]["id"]), int(ids[a, s]), int(wanted[a, s])) for a in range(size) for s in range(positives) if known[a, s]],
            "anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        best = _best_of(far, negatives).join(names, ["anchor", "slot"])
        results.append(best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        for name, scan in (("positives", near), ("negatives", far)):
            counted = scan.where("anchor = -1").select(F.lit(number).alias("block"), F.lit(name).alias("scan"), F.when(F.col("slot") == 0, F.col("score")).alias("met"), F.when(F.col("slot") == 1, F.col("score")).alias("opened"))
            work.append(counted.groupBy("block", "scan").agg(F.sum("met").alias("met"), F.sum("opened").alias("opened")))
    return _all(results), _all(work)


def _all(frames: list[DataFrame]) -> DataFrame | None:
    while len(frames) > 1:  # by halves: the plan stays shallow
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + ([frames[-1]] if len(frames) % 2 else [])
    return frames[0] if frames else None


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(rows: DataFrame, chosen: Column, scale: float = 256.0, **how) -> DataFrame:
    """`mine` over plain rows (vec_id, label, embedding); `chosen` is a condition on `id`."""
    found, _ = mine(stored(rows, scale), chosen, **how)
    return rows.sparkSession.createDataFrame([], MINED) if found is None else found
