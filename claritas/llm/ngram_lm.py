"""Interpolated modified Kneser-Ney language model of order 2, counted in Spark, read by memory map.

Counting. Tasks sum the words of their training texts in sorted arrays of 64-bit codes and send them by
code range; every range becomes one file (codes, counts). A word's id is its rank over all ranges. A
second scan sums word pairs, packed as two ids, and sends them by a hash of the first word, the context
(by a hash of the pair for contexts so frequent that they would fill a range alone). Every range becomes
one file: pairs and counts, contexts and their numbers of followers seen once, twice and more often.
The distinct contexts of each word go on to one more file per word range. Files are written under the
scratch folder by rename, so a repeated task leaves the same file. Only sizes, counts of counts and the
list of frequent contexts (at most `FREQUENT_CONTEXTS`) reach the driver.

Scoring. Workers map the files and search them; nothing is loaded whole. With c(uw) the count of a pair,
D the discounts of Chen and Goodman (1998) from the counts of counts,

    p(w|u) = max(c(uw) - D(c(uw)), 0) / c(u) + g(u) q(w),   g(u) = (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u)
    q(w)   = max(k(w) - D'(k(w)), 0) / K + g' / (V + 1)

k(w) is the number of distinct contexts of w, K their sum, g' the mass the discounts D' free, V the number
of distinct words; an unknown word has the last term only, after an unknown context p is q.
A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), then one end; its first context is a start.

The scratch folder must be one that workers can open as a path (a mounted folder).
Nulls: a null text is empty: the end alone; a null id is a training row. Repeated rows count each.
Without training rows the model is uniform over one word, and every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import words as W
from claritas.llm.files import PART, bucket_of, grouped, local_folder, mapped, parts, runs, save, spread, summed
from claritas.session import scratch_path, shuffle_width

END = np.uint64(0x0E4D0E4D0E4D0E4D)
FLUSH = 2_000_000
FREQUENT_CONTEXTS = 256


def _count_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0

    def flush() -> pa.RecordBatch:
        key, count = summed(keys, counts)
        start, end = runs(bucket_of(key, bits))
        return parts([(0, int(key[s] >> np.uint64(64 - bits)), key[s:e].tobytes(), count[s:e].tobytes()) for s, e in zip(start, end)])

    for batch in batches:
        for words in W.word_slices(batch.column(0), W.BLANK):
            key, count = np.unique(words.code, return_counts=True)
            keys += [key, np.array([END])]
            counts += [count, np.array([words.n_docs])]
            held += len(key)
            if held > FLUSH:
                yield flush()
                keys, counts, held = [], [], 0
    if keys:
        yield flush()


def _store_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for bucket, a, b in grouped(batches, (np.uint64, np.int64)):
        code, count = summed(a, b)
        save(f"{folder}/words-{bucket}", [code, count])
        top = np.argsort(-count, kind="stable")[:64]
        yield parts([(0, bucket, np.array([len(code), count.sum()], np.int64).tobytes(), np.stack([top, count[top]]).astype(np.int64).tobytes())])


class Vocabulary:
    def __init__(self, folder: str, bits: int, sizes: np.ndarray):
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.maps: dict[int, list] = {}

    def __len__(self) -> int:
        return int(self.offset[-1])

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted codes."""
        ids, counts = np.full(len(code), -1, np.int64), np.zeros(len(code), np.int64)
        bucket = bucket_of(code, self.bits)
        for s, e in zip(*runs(bucket)):
            k = int(bucket[s])
            n = int(self.sizes[k])
            if n == 0:
                continue
            if k not in self.maps:
                self.maps[k] = mapped(f"{self.folder}/words-{k}", [("u8", n), ("i8", n)])
            known, count = self.maps[k]
            at = np.minimum(np.searchsorted(known, code[s:e]), n - 1)
            hit = known[at] == code[s:e]
            ids[s:e][hit] = at[hit] + self.offset[k]
            counts[s:e][hit] = count[at[hit]]
        return ids, counts


def tokens(words: W.Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, context id, count) of all words and ends of a slice; id -1: unknown, context V: start."""
    many = words.counts()
    at = np.arange(len(words.code)) + words.doc  # an end stands after each text before
    total = len(words.code) + words.n_docs
    code = np.full(total, END, np.uint64)
    code[at] = words.code
    distinct, back = np.unique(code, return_inverse=True)
    ids, counts = vocabulary.find(distinct)
    ids, counts = ids[back], counts[back]
    doc = np.repeat(np.arange(words.n_docs), many + 1)
    context = np.empty(total, np.int64)
    context[1:] = ids[:-1]
    context[np.concatenate([[0], np.cumsum(many + 1)[:-1]])] = len(vocabulary)
    return doc, ids, context, counts


def pair_bucket(context: np.ndarray, key: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    by = np.where(np.isin(context, frequent), key, context.astype(np.uint64))
    return bucket_of(W.mix(by * W.ODD + np.uint64(7)), bits)


def pack(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _count_pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, frequent: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    keys, held = [], 0

    def flush() -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        bucket = pair_bucket((key >> np.uint64(32)).astype(np.int64), key, frequent, bits)
        order = np.argsort(bucket, kind="stable")
        key, count, bucket = key[order], count[order].astype(np.uint32), bucket[order]
        return parts([(1, int(bucket[s]), key[s:e].tobytes(), count[s:e].tobytes()) for s, e in zip(*runs(bucket))])

    for batch in batches:
        for words in W.word_slices(batch.column(0), W.BLANK):
            _, ids, context, _ = tokens(words, vocabulary)
            keys.append(pack(context, ids))
            held += len(ids)
            if held > FLUSH:
                yield flush()
                keys, held = [], 0
    if keys:
        yield flush()


def _counts_of_counts(count: np.ndarray) -> np.ndarray:
    return np.array([(count == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _store_pairs(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: Vocabulary, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Files of pairs; on go statistics, and the distinct contexts of each word by word range, summed over the buckets of a task."""
    words_, many_, held = [], [], 0

    def flush() -> pa.RecordBatch:
        word, many = summed(words_, many_)
        place = np.searchsorted(vocabulary.offset, word, "right") - 1
        return parts([(4, int(place[s]), (word[s:e] - vocabulary.offset[place[s]]).astype(np.uint32).tobytes(), many[s:e].astype(np.uint32).tobytes()) for s, e in zip(*runs(place))])

    for bucket, a, b in grouped(batches, (np.uint64, np.uint32)):
        key, count = summed(a, b)
        context = (key >> np.uint64(32)).astype(np.int64)
        start, _ = runs(context)
        sums = np.stack([np.add.reduceat(x.astype(np.int64), start) for x in (count == 1, count == 2, count > 2)])
        own = context[start]
        save(f"{folder}/pairs-{bucket}", [key, count.astype(np.uint32), own.astype(np.uint32), *sums.astype(np.uint32)])
        hot = np.isin(own, frequent)
        yield parts(
            [
                (2, -1, np.array([bucket, len(key), len(own), *_counts_of_counts(count)], np.int64).tobytes(), b""),
                (3, -1, np.concatenate([own[hot][None], sums[:, hot]]).astype(np.int64).tobytes(), b""),
            ]
        )
        word, many = np.unique((key & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        words_.append(word)
        many_.append(many)
        held += len(word)
        if held > FLUSH:
            yield flush()
            words_, many_, held = [], [], 0
    if held:
        yield flush()


def _store_contexts(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Files of the number of distinct contexts per word id; statistics pass through."""
    for bucket, a, b in grouped(batches, (np.uint32, np.uint32)):
        if bucket is None:
            yield parts([a])
            continue
        word, many = summed(a, b)
        dense = np.zeros(int(vocabulary.sizes[bucket]), np.uint32)
        dense[word] = many
        save(f"{folder}/contexts-{bucket}", [dense])
        yield parts([(5, -1, np.array([bucket, many.sum(), *_counts_of_counts(many), len(many)], np.int64).tobytes(), b"")])


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, kept inside [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if n1 == 0 or n2 == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(x, 0.0 if k == 0 else 0.05), float(k)) for k, x in enumerate(d)])


class Model:
    """What a worker needs to find its way in the files."""

    def __init__(self, vocabulary, total, documents, bits, sizes, frequent, followers, pair_counts, context_total, context_counts, context_known):
        self.vocabulary, self.total, self.documents, self.bits, self.sizes = vocabulary, total, documents, bits, sizes
        self.frequent, self.followers = frequent, followers
        self.discount = discounts(pair_counts)
        low = discounts(context_counts)
        self.low_discount, self.context_total, self.context_known = low, context_total, context_known
        rest = context_known - context_counts[0] - context_counts[1]
        freed = low[1] * context_counts[0] + low[2] * context_counts[1] + low[3] * rest
        self.floor = (freed / context_total if context_total else 1.0) / (len(vocabulary) + 1)
        self.pair_maps: dict[int, list] = {}
        self.context_maps: dict[int, np.ndarray] = {}

    def q(self, ids: np.ndarray) -> np.ndarray:
        """The lower order, for distinct sorted ids."""
        many = np.zeros(len(ids), np.int64)
        place = np.searchsorted(self.vocabulary.offset, ids, "right") - 1
        for s, e in zip(*runs(place)):
            if ids[s] < 0 and ids[e - 1] < 0:
                continue
            k = int(place[s])
            if k not in self.context_maps:
                self.context_maps[k] = mapped(f"{self.vocabulary.folder}/contexts-{k}", [("u4", int(self.vocabulary.sizes[k]))])[0]
            many[s:e] = self.context_maps[k][ids[s:e] - self.vocabulary.offset[k]]
        kept = np.maximum(many - self.low_discount[np.minimum(many, 3)], 0.0) / max(self.context_total, 1)
        return kept + self.floor

    def pairs(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(uw), and the discounted mass D1 n1(u) + D2 n2(u) + D3 n3(u); 0 for unknown words or contexts."""
        count, mass = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        known = np.flatnonzero(context >= 0)
        key = pack(context[known], np.maximum(ids[known], 0))
        bucket = pair_bucket(context[known], key, self.frequent, self.bits)
        order = np.argsort(bucket, kind="stable")
        known, key, bucket = known[order], key[order], bucket[order]
        d = self.discount[1:]
        for s, e in zip(*runs(bucket)):
            k = int(bucket[s])
            n, m = (int(x) for x in self.sizes[k])
            if n == 0:
                continue
            if k not in self.pair_maps:
                self.pair_maps[k] = mapped(f"{self.vocabulary.folder}/pairs-{k}", [("u8", n), ("u4", n), ("u4", m), ("u4", m), ("u4", m), ("u4", m)])
            keys, counts, own, n1, n2, n3 = self.pair_maps[k]
            spot = known[s:e]
            at = np.minimum(np.searchsorted(keys, key[s:e]), n - 1)
            count[spot] = np.where((keys[at] == key[s:e]) & (ids[spot] >= 0), counts[at], 0)
            at = np.minimum(np.searchsorted(own, context[spot].astype(np.uint32)), m - 1)
            mass[spot] = np.where(own[at] == context[spot], d[0] * n1[at] + d[1] * n2[at] + d[2] * n3[at], 0.0)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, context), len(self.frequent) - 1)
            hot = self.frequent[at] == context
            mass[hot] = (d @ self.followers)[at[hot]]
        return count, mass

    def score(self, words: W.Words) -> tuple[np.ndarray, ...]:
        """Per text: n_tokens, n_known, base_score, score."""
        doc, ids, context, counts = tokens(words, self.vocabulary)
        n = words.n_docs
        size = len(self.vocabulary)
        base = np.log10((counts + 0.5) / (self.total + 0.5 * (size + 1)))
        distinct, back = np.unique(ids, return_inverse=True)
        low = self.q(distinct)[back]
        seen = np.zeros(len(ids), np.int64)
        seen[1:] = counts[:-1]
        seen[context == size] = self.documents
        count, mass = self.pairs(context, ids)
        divisor = np.maximum(seen, 1)
        p = np.where(seen > 0, np.maximum(count - self.discount[np.minimum(count, 3)], 0.0) / divisor + mass / divisor * low, low)
        total = lambda v: np.bincount(doc, v, n)
        return words.counts() + 1, total(counts > 0).astype(np.int64), total(base), total(np.log10(p))


def fit(training: DataFrame) -> Model:
    """A model of the column `text`."""
    spark = training.sparkSession
    folder = local_folder(scratch_path(spark, "lm"))
    texts = training.select(F.col("text").cast("string").alias("text"))
    documents, letters = texts.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    bits = max(4, math.ceil(math.log2(max(shuffle_width(spark), (letters or 0) // 4_000_000))))
    counted = texts.mapInArrow(lambda b: _count_words(b, bits), PART)
    rows = spread(counted).mapInArrow(lambda b: _store_words(b, folder), PART).collect()
    sizes, total, top = np.zeros(1 << bits, np.int64), 0, []
    for r in rows:
        n, many = np.frombuffer(r["a"], np.int64)
        sizes[r["bucket"]], total = n, total + int(many)
        top.append((r["bucket"], np.frombuffer(r["b"], np.int64).reshape(2, -1)))
    vocabulary = Vocabulary(folder, bits, sizes)
    if len(vocabulary) >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: pairs of ids no longer fit 64 bits")
    least = total / (4 << bits)
    often = sorted(((int(c), int(vocabulary.offset[k] + i)) for k, t in top for i, c in zip(*t) if c > least), reverse=True)
    frequent = np.array(sorted([i for _, i in often[: FREQUENT_CONTEXTS - 1]] + [len(vocabulary)]), np.int64)
    pairs = spread(texts.mapInArrow(lambda b: _count_pairs(b, vocabulary, frequent, bits), PART))
    stored = spread(pairs.mapInArrow(lambda b: _store_pairs(b, folder, vocabulary, frequent), PART))
    pair_sizes, followers = np.zeros((1 << bits, 2), np.int64), np.zeros((3, len(frequent)), np.int64)
    pair_counts, context_counts, context_total, context_known = np.zeros(4, np.int64), np.zeros(4, np.int64), 0, 0
    for r in stored.mapInArrow(lambda b: _store_contexts(b, folder, vocabulary), PART).toLocalIterator():
        v = np.frombuffer(r["a"], np.int64)
        if r["kind"] == 2:
            pair_sizes[v[0]] = v[1:3]
            pair_counts += v[3:]
        elif r["kind"] == 3:
            v = v.reshape(4, -1)
            np.add.at(followers, (slice(None), np.searchsorted(frequent, v[0])), v[1:])
        else:
            context_total, context_known = context_total + int(v[1]), context_known + int(v[6])
            context_counts += v[2:6]
    return Model(vocabulary, total, documents, bits, pair_sizes, frequent, followers, pair_counts, context_total, context_counts, context_known)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in W.word_slices(batch.column(0), W.BLANK):
            kept = [batch.column(k).slice(words.first, words.n_docs) for k in range(1, batch.num_columns)]
            n, known, base, score = model.score(words)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], [*batch.schema.names[1:], "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep`, n_tokens, n_known, base_score (smoothed unigrams), score (log10 probability)."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens bigint, n_known bigint, base_score double, score double"])
    picked = docs.select(F.col("text").cast("string").alias(W.free("_text", keep)), *keep)
    return picked.mapInArrow(lambda b: _score(b, model), schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """`scored` with the perplexity of every text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
