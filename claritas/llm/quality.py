"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of word n-grams (1 and 2 words between blanks, hashed to 2**BITS) and of runs
in which one word stands 2, 3, 4 or 8 times in a row. Counts of each indicator by class, over all
labelled rows, give log-count ratios; a text is its indicators scaled by these ratios, to length one.
A linear hinge-loss model on such vectors is fitted by dual coordinate descent over a bounded sample
of labelled rows (`sample` per class at most, chosen by a hash of the id), and decision values of rows
left out of a fold are turned into probabilities by a logistic fit that weighs rows back to the class
shares of all labelled rows.

Scores read the text alone. Nulls: a null text is empty; an empty text has no indicators and scores by
the intercept. Rows of `labels` without id or label are not used; an id labelled more than once takes
the majority (a tie counts as 1). With labels of one class only, or none, every score is the smoothed
share of that class. Repeated documents score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import words as W
from claritas.session import written

BITS = 18
SIZE = 1 << BITS
SAMPLE = 8_000
LEAST = 4
LABEL_BYTES = 32  # of a (bigint, int) row in a hash table
SHIPPED_BYTES = 32 << 20
RUNS = (2, 3, 4, 8)
RUN_CODES = W.mix(np.arange(1, len(RUNS) + 1, dtype=np.uint64) * W.STEP)


def indicators(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature), sorted, for the texts of one slice."""
    at, pairs = W.grams(words, 2)
    docs, codes = [words.doc, words.doc[at]], [words.code, pairs]
    same = np.zeros(len(words.code), bool)
    if len(same):
        same[1:] = (words.code[1:] == words.code[:-1]) & (words.doc[1:] == words.doc[:-1])
    run = same.copy()
    for length, code in zip(range(2, RUNS[-1] + 1), [dict(zip(RUNS, RUN_CODES)).get(k) for k in range(2, RUNS[-1] + 1)]):
        if length > 2:
            run[1:] = run[1:] & same[1:] & np.concatenate([[False], run[:-1]])[1:]
        if code is not None:
            found = np.unique(words.doc[run])
            docs.append(found)
            codes.append(np.full(len(found), code, np.uint64))
    key = np.concatenate(docs).astype(np.int64) << BITS | (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return key >> BITS, key & (SIZE - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, zeros, ones): texts of this task that hold an indicator, by class; feature -1 counts all texts."""
    counts = np.zeros((2, SIZE), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows += np.bincount(labels, minlength=2)
        for words in W.word_slices(batch.column(1), W.BLANK):
            doc, feature = indicators(words)
            kind = labels[words.first + doc]
            for y in (0, 1):
                counts[y] += np.bincount(feature[kind == y], minlength=SIZE)
    seen = np.flatnonzero(counts.sum(0))
    if rows.sum():
        columns = [pa.array(np.append(-1, seen), pa.int32()), pa.array(np.append(rows[0], counts[0][seen])), pa.array(np.append(rows[1], counts[1][seen]))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "zeros", "ones"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for words in W.word_slices(batch.column(1), W.BLANK):
            doc, feature = indicators(words)
            cut = np.searchsorted(doc, np.arange(words.n_docs + 1))
            out += [feature[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(out, pa.binary())], ["y", "features"])


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def decide(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        value = self.ratio[feature]
        length = np.sqrt(np.bincount(doc, value * value, n))
        dot = np.bincount(doc, value * self.weight[feature], n)
        return dot / np.maximum(length, 1e-9) + self.bias

    def score(self, words: W.Words) -> np.ndarray:
        z = self.slope * self.decide(*indicators(words), words.n_docs) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hinge loss, squared-norm penalty, bias as a feature of value one (Hsieh et al., 2008)."""
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    values = []
    for r in rows:
        v = ratio[r]
        values.append((v / max(float(np.sqrt(v @ v)), 1e-9)).astype(np.float32))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = sign[i] * (float(values[i] @ weight[rows[i]]) + bias) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weight[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


def logistic(z: np.ndarray, y: np.ndarray, rate: np.ndarray) -> tuple[float, float]:
    """slope, offset of a weighted logistic fit with smoothed targets (Platt's method, Newton steps)."""
    ones, zeros = rate[y == 1].sum(), rate[y == 0].sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([z, np.ones_like(z)])
    beta = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -40, 40)))
        grad = x @ (rate * (p - goal)) + 1e-3 * (beta - [1, 0])
        hess = (x * (rate * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def labelled(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """(doc_id, text, y) of the documents with a label."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    kept = kept.groupBy("doc_id").agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("y"))
    kept = written(kept, "quality-labels")
    if kept.count() * LABEL_BYTES <= SHIPPED_BYTES:  # beyond that both sides are shuffled
        kept = F.broadcast(kept)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(kept, "doc_id")


def ratios(counts: np.ndarray, least: int) -> np.ndarray:
    """Log-count ratios of the indicators, smoothed by one; 0 for those in fewer than `least` texts."""
    smooth = counts + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[counts.sum(0) < least] = 0.0
    return ratio


def fit_sample(vectors: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, share: np.ndarray, cost: float) -> tuple[np.ndarray, float, float, float]:
    """weight, bias, slope, offset from the sampled rows, each the features of a text."""
    per_class = np.bincount(y, minlength=2)
    costs = np.where(y == 1, cost * min(1.0, per_class[0] / per_class[1]), cost * min(1.0, per_class[1] / per_class[0]))
    fold = np.arange(len(y)) % 2
    z = np.zeros(len(y))
    for k in (0, 1):
        use, left = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        weight, bias = dual_descent([vectors[i] for i in use], y[use], ratio, costs[use])
        for i in left:
            v = ratio[vectors[i]]
            z[i] = float(v @ weight[vectors[i]]) / max(float(np.sqrt(v @ v)), 1e-9) + bias
    weight, bias = dual_descent(vectors, y, ratio, costs)
    slope, offset = logistic(z, y, 1.0 / share[y])
    return weight, bias, slope, offset


MODEL = "ratio binary, weight binary, bias double, slope double, offset double"


def _fit(batches: Iterator[pa.RecordBatch], share: np.ndarray, least: int, cost: float) -> Iterator[pa.RecordBatch]:
    """The model, in one task: rows (feature, zeros, ones) are counts, rows (y, features) the sample."""
    counts, picked = np.zeros((2, SIZE), np.int64), []
    for batch in batches:
        counted = batch.filter(pc.is_valid(batch.column(0)))
        at = counted.column(0).to_numpy()
        counts[0, at], counts[1, at] = counted.column(1).to_numpy(), counted.column(2).to_numpy()
        drawn = batch.filter(pc.is_valid(batch.column(3)))
        picked += zip(drawn.column(3).to_pylist(), drawn.column(4).to_pylist())
    picked.sort()  # the same order on every run
    y = np.array([k for k, _ in picked])
    ratio = ratios(counts, least)
    weight, *rest = fit_sample([np.frombuffer(b, np.int32) for _, b in picked], y, ratio, share, cost)
    columns = [pa.array([ratio.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()), *[pa.array([float(x)]) for x in rest]]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MODEL.split(", ")])


def fit(rows: DataFrame, sample: int = SAMPLE, cost: float = 1.0, least: int = LEAST) -> Model:
    """A model of `rows` (doc_id, text, y). `sample` bounds the rows of each class that the descent sees;
    indicators in fewer than `least` labelled texts weigh nothing.

    Counts are summed by indicator; the descent runs in one task over the written sample, and only the
    model itself (two numbers per hash bucket) reaches the driver.
    """
    counted = rows.select("y", "text").mapInArrow(_count, "feature int, zeros bigint, ones bigint")
    counts = written(counted.groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")), "quality-counts")
    total = counts.where("feature = -1").first()
    n = np.array([total["zeros"], total["ones"]]) if total else np.zeros(2, np.int64)
    if n.min() == 0:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1e-3, float(np.log((n[1] + 1) / (n[0] + 1))))
    share = np.minimum(1.0, sample / n)
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < F.when(F.col("y") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    picked = written(rows.where(draw).select("y", "text").mapInArrow(_vectors, "y int, features binary"), "quality-sample")
    both = counts.where("feature >= 0").unionByName(picked, allowMissingColumns=True).coalesce(1)
    found = both.mapInArrow(lambda batches: _fit(batches, share, least, cost), MODEL).first()
    return Model(np.frombuffer(found["ratio"]), np.frombuffer(found["weight"]), found["bias"], found["slope"], found["offset"])


def _score(batches: Iterator[pa.RecordBatch], sent, name: str) -> Iterator[pa.RecordBatch]:
    model = Model(*sent.value)
    for batch in batches:
        scores = [model.score(words) for words in W.word_slices(batch.column(0), W.BLANK)]
        kept = [batch.column(k) for k in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names[1:], name])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns `keep` (default: all) of `docs` and the probability of label 1."""
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"{name} is taken; name the score differently")
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.slope, model.offset))
    picked = docs.select(F.col("text").cast("string").alias(W.free("_text", [*keep, name])), *[F.col(c) for c in keep])
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{name}` double"])
    return picked.mapInArrow(lambda batches: _score(batches, sent, name), schema)


def keep_good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """`docs` without the documents that score below `least`."""
    name = W.free("score", docs.columns)
    return score(docs, model, name=name).where(F.col(name) >= least).select(*docs.columns)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of `labels.quality`, fitted on rows that are not held out; texts are scanned for labels once."""
    rows = written(labelled(docs, labels).where(~held_out(F.col("doc_id"))), "quality-rows")
    return fit(rows, sample)
