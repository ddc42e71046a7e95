"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

Terms are shingles of five words between blanks, A-Z lower-cased (fewer words: all of them), weighted by
how often they stand in the text. For every term and sample, r and c are gamma(2, 1) variables and b a
uniform one, all drawn from one hash of the term. With weight w,

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r,

and a sample is the (term, t) of the least a. Two texts agree in a sample with the probability of their
generalised Jaccard similarity, sum of least weights over sum of largest. A fingerprint keeps 16 bits of
each sample, as hex; the likeness of two is the share of equal samples.

Rows are compared with the next one in order of doc_id (null ids last, equal ids by text): ids are cut
into ranges at quantiles, every range is sorted in one task, and the first row of a range is also sent
to the range before it, so texts cross the network once.

Nulls: a null text is empty; texts without words have the fingerprint of no terms, alike among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import words as W
from claritas.session import shuffle_width

SAMPLES = 64
SHINGLE = 5
SLICE = 256 << 10
LAST = (1 << 63) - 1
MAX_RANGES = 50_000


def gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of gamma(2, 1): solutions of 1 - (1 + x) exp(-x) = p at the middle of each cell."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return ((low + high) / 2).astype(np.float32)


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        self.gamma = gamma_table()
        self.log_gamma = np.log(self.gamma)
        self.seed = W.mix(np.arange(1, samples + 1, dtype=np.uint64) * W.STEP)

    def values(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One row per (term, weight): in each sample 20 bits that order by a, then 12 bits of (term, t)."""
        h = (term[:, None] ^ self.seed[None, :]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        low = h.astype(np.uint32)
        r = self.gamma[low & np.uint32(0xFFFF)]
        b = ((h >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        heavy = np.flatnonzero(weight > 1)
        t = np.zeros((len(heavy), len(self.seed)), np.float32)
        a = self.log_gamma[low >> np.uint32(16)]
        if len(heavy):
            t = np.floor(np.log(weight[heavy]).astype(np.float32)[:, None] / r[heavy] + b[heavy])
            a[heavy] -= r[heavy] * t
        a += r * (b - np.float32(1))
        bits = a.view(np.int32)
        order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.uint32) ^ np.uint32(0x80000000)
        label = (h >> np.uint64(44)).astype(np.uint32) & np.uint32(0xFFF)
        if len(heavy):
            label[heavy] = (label[heavy] + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E5)) & np.uint32(0xFFF)
        return (order & np.uint32(0xFFFFF000)) | label

    def prints(self, texts: list[str]) -> np.ndarray:
        """16 bits per sample and text."""
        out = np.full((len(texts), len(self.seed)), 0xFFFFFFFF, np.uint32)
        for words in W.word_slices(pa.array(texts, pa.large_string()), W.BLANK, 2 * SLICE):
            doc, term = W.shingles(words, SHINGLE)
            if len(term) == 0:
                continue
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
            weight = np.diff(np.append(first, len(term)))
            doc, term = doc[first], term[first]
            # the same term with the same weight is sampled once per slice
            by = np.lexsort((weight, term))
            new = np.concatenate([[True], (term[by][1:] != term[by][:-1]) | (weight[by][1:] != weight[by][:-1])])
            row = np.empty(len(term), np.int64)
            row[by] = np.cumsum(new) - 1
            pick = by[new]
            sampled = np.empty((len(pick), len(self.seed)), np.uint32)
            for s in range(0, len(pick), 4096):
                sampled[s : s + 4096] = self.values(term[pick[s : s + 4096]], weight[pick[s : s + 4096]])
            start = np.searchsorted(doc, np.arange(words.n_docs))
            for d in np.unique(doc):
                end = start[d + 1] if d + 1 < words.n_docs else len(doc)
                least = out[words.first + d]
                for s in range(start[d], end, 2048):
                    np.minimum(least, sampled[row[s : min(end, s + 2048)]].min(0), out=least)
        return (W.mix(out.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, next text) in order; rows are (range, sent ahead, doc_id, text), sorted."""
    held = None
    for batch in batches:
        for part, ahead, doc_id, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            text = text or ""
            if held is not None and held[0] == part:
                yield held[1], held[2], text
            held = None if ahead else (part, doc_id, text)
            if ahead:
                held = (None, None, None)


def _compare(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(samples)
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        # the text after a row is that of the row after it, but for ends of ranges
        after = [k + 1 if k + 1 < len(rows) and rows[k + 1][1] is rows[k][2] else None for k in range(len(rows))]
        extra = [k for k in range(len(rows)) if after[k] is None]
        new = [edited(r[1], r[2]) for r in rows]
        prints = sampler.prints([*texts, *new, *[rows[k][2] for k in extra]])
        n = len(rows)
        for j, k in enumerate(extra):
            after[k] = 2 * n + j
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                pa.array([shown(p) for p in prints[:n]]),
                pa.array([shown(p) for p in prints[n : 2 * n]]),
                pa.array([likeness(prints[k], prints[n + k]) for k in range(n)], pa.float64()),
                pa.array([likeness(prints[k], prints[after[k]]) for k in range(n)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for row in _runs(batches):
        rows.append(row)
        size += len(row[1])
        if size > SLICE:
            yield flush()
            rows, size = [], 0
    if rows:
        yield flush()


def in_order(docs: DataFrame) -> DataFrame:
    """(range, ahead, doc_id, text), every range whole and sorted in one partition; `ahead` marks the row
    that follows the last one of its range (of the last range: the very first row)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = min(4 * shuffle_width(spark), MAX_RANGES)
    cuts = texts.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("bigint")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right"))

    key = F.coalesce("doc_id", F.lit(LAST))  # no nulls: pandas would turn the ids into doubles
    ranged = texts.select(range_of(key).alias("part"), key.alias("key"))
    firsts = sorted((r["part"], r["key"]) for r in ranged.groupBy("part").agg(F.min("key").alias("key")).collect())
    keys = np.array([k for _, k in firsts], np.int64)
    before = np.array([p for p, _ in firsts][-1:] + [p for p, _ in firsts][:-1], np.int64)

    @F.pandas_udf("bigint")
    def sent_to(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        return pd.Series(np.where(keys[at] == ids, before[at], -1))

    sent = texts.withColumn("part", range_of(key)).withColumn("to", sent_to(key))
    own, ahead = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead")), F.struct(F.col("to").alias("part"), F.lit(1).alias("ahead"))
    sent = sent.withColumn("place", F.explode(F.when(F.col("to") >= 0, F.array(own, ahead)).otherwise(F.array(own))))
    sent = sent.select("place.part", "place.ahead", "doc_id", "text").repartition(shuffle_width(spark), "part")
    return sent.sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), F.coalesce("text", F.lit("")))


def compare_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], schema)
    return in_order(docs).mapInArrow(lambda b: _compare(b, samples), schema)


def _print(batches: Iterator[pa.RecordBatch], samples: int, name: str) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(samples)
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        kept = [batch.column(k) for k in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([shown(p) for p in sampler.prints(texts)], pa.string())], [*batch.schema.names[1:], name])


def fingerprint(docs: DataFrame, keep: list[str], samples: int = SAMPLES, name: str = "fingerprint") -> DataFrame:
    """Columns `keep` of `docs` and the fingerprint of the column `text`; `name` must not be kept."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{name}` string"])
    picked = docs.select(F.col("text").cast("string").alias(W.free("_text", keep)), *keep)
    return picked.mapInArrow(lambda b: _print(b, samples, name), schema)
