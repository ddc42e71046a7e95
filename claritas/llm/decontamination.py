"""Benchmark decontamination: a hash set of normalised test n-grams against all training windows.

The windows of the benchmark go to every task as a sorted array of 64-bit codes, in blocks of at most
`BLOCK_WINDOWS`; a benchmark with more windows takes one scan of the documents per block, each a stage of
its own that writes its rows for the next, so a task never holds more than one block. A bit filter
over the codes drops nearly all training windows, a search in the array finds the rest, and every hit
is compared word by word with the benchmark, so a collision of codes never counts.

Nulls: a null text has no words; a benchmark row without words or without an id has no windows.
Repeated ids of the benchmark count once. Repeated documents each get their own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import words as W
from claritas.session import written

BLOCK_WINDOWS = 250_000
FILTER_BITS = 24


def _window_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: list[tuple] = []
        for words in W.word_slices(batch.column(1)):
            at = words.offsets()
            for d in range(words.n_docs):
                item = ids[words.first + d]
                if item is None:
                    continue
                lo, hi = int(at[d]), int(at[d + 1])
                size = min(n, hi - lo)
                for i in range(lo, hi - size + 1 if size else lo):
                    out.append((item, size, b" ".join(words.word(j) for j in range(i, i + size))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary()))],
            ["item_id", "size", "gram"],
        )


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(size, gram, items): distinct windows of the benchmark with the ids that hold them."""
    ids = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = ids.mapInArrow(lambda batches: _window_rows(batches, n), "item_id string, size int, gram binary")
    return rows.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


class HashSet:
    """One block of benchmark windows. Codes are searched, grams decide."""

    def __init__(self, block: list[tuple[int, bytes, list[str]]]):
        self.items = {(size, gram): ids for size, gram, ids in block}
        self.codes: dict[int, np.ndarray] = {}
        for size in sorted({s for s, _, _ in block}):
            grams = [g for s, g, _ in block if s == size]
            raw = np.frombuffer(b"".join(grams), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
            self.codes[size] = np.unique(W.grams(W.words_of(raw, offsets), size)[1])
        self.filter = {}
        for size, codes in self.codes.items():
            bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
            top = codes >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, top >> np.uint64(3), np.left_shift(1, (top & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            self.filter[size] = bits

    def hits(self, words: W.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(index of the first word, size, items) of every window that occurs in the slice."""
        for size, codes in self.codes.items():
            at, code = W.grams(words, size)
            top = code >> np.uint64(64 - FILTER_BITS)
            bits = self.filter[size][top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)
            maybe = np.flatnonzero(bits & 1)
            where = np.searchsorted(codes, code[maybe])
            maybe = maybe[codes[np.minimum(where, len(codes) - 1)] == code[maybe]]
            for i in at[maybe].tolist():
                found = self.items.get((size, b" ".join(words.word(j) for j in range(i, i + size))))
                if found is not None:
                    yield i, size, found


def _scan(batches: Iterator[pa.RecordBatch], sent, schema: pa.Schema, last: bool) -> Iterator[pa.RecordBatch]:
    """Columns before the last three stay; then come [first, end) of hit words, flat, items and the text.
    Hits and items of this block are added; after the last block n_words, spans and items are given."""
    known = HashSet(sent.value)
    for batch in batches:
        k = batch.num_columns - 3
        marks, held = batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()
        for words in W.word_slices(batch.column(k + 2)):
            at = words.offsets()
            items: dict[int, set[str]] = {}
            for i, size, found in known.hits(words):
                d = int(words.doc[i])
                marks[words.first + d] += [i - int(at[d]), i - int(at[d]) + size]
                items.setdefault(d, set()).update(found)
            for d, found in items.items():
                held[words.first + d] = sorted(found.union(held[words.first + d]))
            if not last:
                continue
            spans: list[list[dict]] = [[] for _ in range(words.n_docs)]
            for d in range(words.n_docs):
                if own := marks[words.first + d]:
                    hit = np.zeros(int(at[d + 1] - at[d]) + 2, np.int8)
                    for first, end in zip(own[::2], own[1::2]):
                        hit[first + 1 : end + 1] = 1
                    edges = np.flatnonzero(np.diff(hit))
                    spans[d] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
            keys = [batch.column(c).slice(words.first, words.n_docs) for c in range(k)]
            rest = [
                pa.array(words.counts(), pa.int64()),
                pa.array(spans, schema.field("spans").type),
                pa.array(held[words.first : words.first + words.n_docs], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*keys, *rest], schema=schema)
        if not last:
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(marks, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.string())), batch.column(k + 2)], schema=batch.schema)


def _blocks(benchmark: DataFrame, n: int) -> Iterator[list[tuple[int, bytes, list[str]]]]:
    """Blocks of at most BLOCK_WINDOWS windows; only one block is on the driver at a time."""
    found = written(windows(benchmark, n), "benchmark-windows")
    blocks = -(-found.count() // BLOCK_WINDOWS) or 1
    for b in range(blocks):
        part = found if blocks == 1 else found.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        yield [(r["size"], bytes(r["gram"]), r["items"]) for r in part.toLocalIterator()]


def _scans(out: DataFrame, blocks: Iterator[list], step: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """`step` (rows, block, whether it is the last) for every block; the rows between two blocks are written."""
    block = next(blocks)
    while True:
        following = next(blocks, None)
        sent = out.sparkSession.sparkContext.broadcast(block)
        out = step(out, sent, following is None)
        if following is None:
            return out
        out, block = written(out, "decontamination-block"), following
        sent.destroy()


def matches(docs: DataFrame, benchmark: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Columns `keys`, n_words, spans (word runs inside occurring windows, from 0), items, one row per document.

    With several blocks each scan hands its hits on in the row itself, so `keys` need not tell documents apart.
    """
    spark = docs.sparkSession
    hits, items = W.free("_hits", [*keys, "text"]), W.free("_items", [*keys, "text"])
    out = docs.select(*keys, F.array().cast("array<bigint>").alias(hits), F.array().cast("array<string>").alias(items), F.col("text").cast("string").alias("text"))
    between, kinds = out.schema, dict(docs.select(*keys).dtypes)
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"])
    empty = spark.createDataFrame([], ddl)
    schema = pa.schema([*[pa.field(k, _arrow(empty.schema[k].dataType)) for k in keys], pa.field("n_words", pa.int64()),
                        pa.field("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.field("items", pa.list_(pa.string()))])

    def step(rows: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        return rows.mapInArrow(lambda batches: _scan(batches, sent, schema, last), ddl if last else between)

    return _scans(out, _blocks(benchmark, n), step)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def report(found: DataFrame) -> DataFrame:
    """Digest columns from the rows of `matches`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _drop(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Rows without hits."""
    known = HashSet(sent.value)
    for batch in batches:
        for words in W.word_slices(batch.column(batch.schema.names.index("text"))):
            dirty = {int(words.doc[i]) for i, _, _ in known.hits(words)}
            part = batch.slice(words.first, words.n_docs)
            yield part.filter(pa.array([d not in dirty for d in range(words.n_docs)])) if dirty else part


def _mark(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The last column lists [first, end) of hit words, flat; hits of this block are added."""
    known = HashSet(sent.value)
    for batch in batches:
        marks = batch.column(batch.num_columns - 1).to_pylist()
        for words in W.word_slices(batch.column(batch.schema.names.index("text"))):
            at = words.offsets()
            for i, size, _ in known.hits(words):
                d = int(words.doc[i])
                marks[words.first + d] += [i - int(at[d]), i - int(at[d]) + size]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.list_(pa.int64()))], schema=batch.schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that the last column lists; that column goes."""
    for batch in batches:
        k = batch.schema.names.index("text")
        texts, marks = batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        for words in W.word_slices(batch.column(k)):
            at = words.offsets()
            base = 0
            for d in range(words.n_docs):
                i = words.first + d
                raw = (texts[i] or "").encode()
                if marks[i]:
                    hit = np.zeros(int(at[d + 1] - at[d]) + 2, np.int8)
                    for first, end in zip(marks[i][::2], marks[i][1::2]):
                        hit[first + 1 : end + 1] = 1
                    edges, kept, last = np.flatnonzero(np.diff(hit)), [], 0
                    for first, end in zip(edges[::2], edges[1::2]):
                        kept.append(raw[last : int(words.start[at[d] + first]) - base])
                        last = int(words.end[at[d] + end - 1]) - base
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
                base += len(raw)
        columns = [pa.array(texts, batch.schema.field("text").type) if c == k else batch.column(c) for c in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """`docs` (all columns, as given) without contaminated documents, or with the hit words cut out of
    their texts (`remove="spans"`; what stands around a cut stays). Clean documents keep their text.
    All words are judged on the input, however many blocks the benchmark has."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    if remove == "documents":
        return _scans(docs, _blocks(benchmark, n), lambda rows, sent, _: rows.mapInArrow(lambda batches: _drop(batches, sent), docs.schema))
    marked = docs.withColumn(W.free("_hits", docs.columns), F.array().cast("array<bigint>"))
    schema = marked.schema
    marked = _scans(marked, _blocks(benchmark, n), lambda rows, sent, _: rows.mapInArrow(lambda batches: _mark(batches, sent), schema))
    return marked.mapInArrow(_cut, docs.schema)
