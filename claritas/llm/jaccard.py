"""Exact n-gram Jaccard join through a token-group matrix (after Li et al., LES3, 2021).

A document is the set of its distinct word shingles, as 64-bit codes. Two documents link when
den * |intersection| >= num * |union|. The result is the connected components of all links.

1. One scan gives every document its set size and a digest of its set; equal sets are one node from
   here on. The same scan counts shingles that are frequent in a task.
2. Candidate groups. Linked sets of a size class differ in at most D shingles, so of m = D + c + s ranges
   of the code space at least c + s hold the same shingles in both. Every set gives one code per range.
   Ranges that are empty or hold frequent shingles only are void; their codes are given out only by sets
   with more than s void ranges. If one of two linked sets has at most s, they share c ranges that are
   not void; else both give out all. So two linked sets meet in c codes at least, whichever shingles
   count as frequent, and a passage that many documents hold does not tie them together: unrelated sets
   seldom meet in c codes. Up to MEET sets at one code are counted pair by pair. More of them are tied to
   one representative whatever the counts, also inside a task before the shuffle (the representative
   then ties all that it meets), so a hot code costs a row per set at most.
   The components of these ties are the groups of similar documents; no link leaves its group.
3. Inside a group (in blocks of bounded size, block against block, where it is large) the documents are
   split into small groups ordered by their least shingle. The token-group matrix holds the union of
   shingles of each small group. A query's overlap with a union bounds its overlap with every member;
   only small groups that reach num/den of the query's size are opened and counted exactly.
4. The links found (a spanning forest of each block pair) are joined to components.

Shingle codes and digests have 64 bits; a collision (chance n*n/2**65) would join equal-coded sets.

Nulls and edges: a text without words (or null) has the empty set and links with nothing; fewer words
than the shingle size are one shingle; a row without doc_id takes part in no link and has no
component; rows with the same doc_id are one node. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claritas.llm import words as W
from claritas.llm.components import Forest, components
from claritas.llm.files import runs, summed
from claritas.session import shuffle_width, written

FREQUENT_IN_TASK = 8
FREQUENT = 64
TABLE_BITS = 22
MEET = 8
FREQUENT_LIMIT = 2_000_000
FLUSH = 300_000
BUCKET_ENTRIES = 250_000
BLOCK_SHINGLES = 1_000_000
SMALL_GROUP = 16
SHIP_ROWS = 500_000


def sets(words: W.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: codes, sorted inside each text; offsets of the texts; digests of the sets (0: empty)."""
    doc, code = W.distinct(*W.shingles(words, n))
    at = np.searchsorted(doc, np.arange(words.n_docs + 1))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(W.mix(code * W.ODD + np.uint64(1)), out=sums[1:])
    size = (at[1:] - at[:-1]).astype(np.uint64)
    digest = W.mix(sums[at[1:]] - sums[at[:-1]] + size * W.STEP)
    digest[size == 0] = 0
    return code, at, digest.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, set size, digest); kind 1: (none, documents, shingle) for frequent shingles of the task.

    A shingle is listed from the time on that its cell of a counting table is full; which shingles are
    listed never changes the result.
    """
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    codes, counts, held = [], [], 0
    for batch in batches:
        for words in W.word_slices(batch.column(1), W.BLANK):
            code, at, digest = sets(words, n)
            k = words.n_docs
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int8)), batch.column(0).slice(words.first, k), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(digest)],
                ["kind", "doc_id", "n", "code"],
            )
            value, many = np.unique(code, return_counts=True)
            cell = (value >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            total = table[cell] + many
            table[cell] = np.minimum(total, 255)
            full = total >= FREQUENT_IN_TASK
            codes.append(value[full])
            counts.append(many[full])
            held += int(full.sum())
            if held > 500_000:
                value, many = summed(codes, counts)
                codes, counts, held = [value], [many], 0
    if codes:
        code, many = summed(codes, counts)
        k = len(code)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.array(many + FREQUENT_IN_TASK - 1), pa.array(code.view(np.int64))],
            ["kind", "doc_id", "n", "code"],
        )


def _frequent(rows: DataFrame) -> np.ndarray:
    """Sorted codes of the most frequent shingles, at most FREQUENT_LIMIT. The set only sets the speed."""
    sums = written(rows.where("kind = 1").groupBy("code").agg(F.sum("n").alias("n")), "frequent")
    least = FREQUENT
    while sums.where(F.col("n") >= least).count() > FREQUENT_LIMIT:
        least *= 4
    found = sums.where(F.col("n") >= least).select("code").toPandas()["code"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


class Levels:
    """Size classes and the number of ranges of each."""

    def __init__(self, num: int, den: int, largest: int):
        step = (den / num) ** 2
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(math.floor(self.low[-1] * step) + 1)
        high = [b - 1 for b in self.low[1:]] + [math.floor(self.low[-1] * step)]
        self.differ = np.array([2 * h * (den - num) // (den + num) for h in high])
        self.meet = np.array([1 + h // 50 for h in high])
        self.slack = np.array([self._empty(int(d + c), low * num / den) for d, c, low in zip(self.differ, self.meet, self.low)])
        self.low = np.array(self.low)
        self.num, self.den = num, den

    @staticmethod
    def _empty(ranges: int, least: float) -> int:
        """More ranges than are empty, in all likelihood, in a set of `least` shingles, were so many added."""
        slack = 1
        for _ in range(30):
            m = ranges + slack
            mean = m * math.exp(-least / m)
            slack = math.ceil(1.1 * mean + 3 * math.sqrt(mean) + 1)
        return slack

    def of(self, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(level, texts): the class of a size, and the next one if a linked set can be in it."""
        own = np.searchsorted(self.low, size, "right") - 1
        for level in range(len(self.low)):
            if self.differ[level] == 0:
                continue  # only equal sets
            near = (own == level - 1) & (size * self.den >= self.num * self.low[level])
            chosen = np.flatnonzero((size > 0) & ((own == level) | near))
            if len(chosen):
                yield level, chosen


def range_codes(code: np.ndarray, at: np.ndarray, common: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, range code, codes in which linked sets meet) that the sets of one slice give out."""
    size = at[1:] - at[:-1]
    where = np.searchsorted(common, code)
    rare = np.ones(len(code), bool) if len(common) == 0 else common[np.minimum(where, len(common) - 1)] != code
    mixed = W.mix(code ^ W.ODD)
    texts, out, meet = [], [], []
    for level, chosen in levels.of(size):
        m = int(levels.differ[level] + levels.meet[level] + levels.slack[level])
        pick = np.repeat(at[chosen] - np.concatenate([[0], np.cumsum(size[chosen])[:-1]]), size[chosen]) + np.arange(size[chosen].sum())
        doc = np.repeat(np.arange(len(chosen)), size[chosen])
        part = ((code[pick] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = doc * m + part  # rises, as codes are sorted inside a text
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total = np.add.reduceat(mixed[pick], first)
        useful = np.add.reduceat(rare[pick].astype(np.int64), first) > 0
        full = np.zeros(len(chosen) * m, np.uint64)
        full[cell[first]] = total
        void = np.ones(len(chosen) * m, bool)
        void[cell[first[useful]]] = False
        void = void.reshape(len(chosen), m)
        give = (~void | (void.sum(1) > levels.slack[level])[:, None]).ravel()
        spot = np.flatnonzero(give)
        seed = W.mix(np.array([level + 1], np.uint64))
        texts.append(chosen[spot // m])
        meet.append(np.full(len(spot), min(255, int(levels.meet[level])), np.uint8))
        out.append(W.mix(full[spot] * W.STEP + W.mix((spot % m).astype(np.uint64) + seed)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return np.concatenate(texts), np.concatenate(out), np.concatenate(meet)


def met(code: np.ndarray, node: np.ndarray, meet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, node, meet) sorted, starts and ends of their codes, and which codes have more than MEET nodes or a
    representative (meet 0)."""
    order = np.lexsort((meet, node, code))
    code, node, meet = code[order], node[order], meet[order]
    if len(code):
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (node[1:] != node[:-1])])
        code, node, meet = code[new], node[new], meet[new]
    start, end = runs(code)
    wide = (end - start > MEET) | (np.minimum.reduceat(meet, start) == 0 if len(start) else np.zeros(0, bool))
    return code, node, meet, np.stack([start, end]), wide


def stars(node: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of each run."""
    size = bounds[1] - bounds[0]
    least = np.repeat(node[bounds[0]], size)
    own = node[_ranges(bounds[0], bounds[1])]
    keep = own != least
    pairs = np.unique(np.stack([own[keep], least[keep]]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def pairs_of(node: np.ndarray, meet: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (larger node, lesser node, meet) of runs of at most MEET nodes."""
    out = []
    size = bounds[1] - bounds[0]
    for k in range(2, MEET + 1):
        start = bounds[0][size == k]
        for i in range(k):
            for j in range(i + 1, k):
                out.append(np.stack([node[start + j], node[start + i], meet[start].astype(np.int64)]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def _give(batches: Iterator[pa.RecordBatch], n: int, common, levels: Levels, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, codes, nodes and meets) per bucket of the code space; ties found inside the task have bucket < 0."""
    held: list = []
    size = 0

    def flush() -> pa.RecordBatch:
        code, node, meet, bounds, wide = met(*[np.concatenate([h[k] for h in held]) for k in range(3)])
        a, b = stars(node, bounds[:, wide])
        # of a wide code only the representative goes on
        stay = np.ones(len(code), bool)
        stay[_ranges(bounds[0][wide] + 1, bounds[1][wide])] = False
        meet[bounds[0][wide]] = 0
        code, node, meet = code[stay], node[stay], meet[stay]
        bucket = (code >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)
        low = (code >> np.uint64(max(0, 32 - bits))).astype(np.uint32)
        rows = [(int(bucket[s]), low[s:e].tobytes(), node[s:e].tobytes() + meet[s:e].tobytes()) for s, e in zip(*runs(bucket))]
        for s in range(0, len(a), 100_000):
            rows.append((-1 - int(abs(int(a[s])) % 4096), a[s : s + 100_000].tobytes(), b[s : s + 100_000].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "codes", "nodes"])

    for batch in batches:
        for words in W.word_slices(batch.column(1), W.BLANK):
            code, at, digest = sets(words, n)
            text, given, meet = range_codes(code, at, common.value, levels)
            held.append((given, digest[text], meet))
            size += len(given)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _ties(a: np.ndarray, b: np.ndarray, meet: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(meet.astype(np.int64)), pa.array(many.astype(np.int64))], ["a", "b", "meet", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, meet, n): pairs of a partition with their counts over its buckets, ties with meet 0. One bucket is in memory at a time."""
    bucket, held, pairs = None, [], []

    def close() -> pa.RecordBatch:
        code, node, meet, bounds, wide = met(*[np.concatenate([h[k] for h in held]) for k in range(3)])
        pairs.append(np.stack(pairs_of(node, meet, bounds[:, ~wide])))
        a, b = stars(node, bounds[:, wide])
        return _ties(a, b, np.zeros(len(a)), np.ones(len(a)))

    def counted() -> pa.RecordBatch:
        a, b, meet = np.concatenate(pairs, axis=1)
        order = np.lexsort((meet, b, a))
        a, b, meet = a[order], b[order], meet[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return _ties(a[first], b[first], meet[first], np.diff(np.append(first, len(a))))

    for batch in batches:
        for at, codes, nodes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            codes, nodes = codes.as_py(), nodes.as_py()
            if at < 0:
                a = np.frombuffer(codes, np.int64)
                yield _ties(a, np.frombuffer(nodes, np.int64), np.zeros(len(a)), np.ones(len(a)))
                continue
            if at != bucket and held:
                yield close()
                held = []
                if sum(p.shape[1] for p in pairs) > FLUSH:
                    yield counted()
                    pairs = []
            bucket = at
            k = len(codes) // 4
            held.append((np.frombuffer(codes, np.uint32), np.frombuffer(nodes, np.int64, k), np.frombuffer(nodes, np.uint8, k, 8 * k)))
    if held:
        yield close()
    if pairs:
        yield counted()


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, ..."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def links(node: np.ndarray, sets_: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different sets; `side` 0 asks and 1 answers, all do both if there is one side."""
    kept = np.unique(node, return_index=True)[1]
    node, sets_, side = node[kept], [sets_[i] for i in kept], side[kept]
    order = sorted(range(len(node)), key=lambda i: int(sets_[i][0]))
    node, sets_, side = node[order], [sets_[i] for i in order], side[order]
    m = len(node)
    size = np.array([len(s) for s in sets_])
    token = np.unique(np.concatenate(sets_), return_inverse=True)[1]
    doc = np.repeat(np.arange(m), size)
    first = np.concatenate([[0], np.cumsum(size)])
    # postings by (token, document); as documents stand by small group, (token, small group) is a run of them
    by = np.lexsort((doc, token))
    posted, of = doc[by], token[by]
    cell = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (posted[1:] // SMALL_GROUP != posted[:-1] // SMALL_GROUP)]))
    cell_end = np.append(cell[1:], len(of))
    cell_group = posted[cell] // SMALL_GROUP
    row = np.searchsorted(of[cell], np.arange(of[-1] + 2))  # token -> its cells: the token-group matrix
    groups = -(-m // SMALL_GROUP)
    found, out = Forest(), []
    two = side.max() != side.min()
    for q in np.flatnonzero(side == 0) if two else range(m):
        own = token[first[q] : first[q + 1]]
        cells = _ranges(row[own], row[own + 1])
        bound = np.bincount(cell_group[cells], minlength=groups)
        opened = bound * den >= num * size[q]
        cells = cells[opened[cell_group[cells]]]
        overlap = np.bincount(posted[_ranges(cell[cells], cell_end[cells])], minlength=m)
        hit = np.flatnonzero(den * overlap >= num * (size + size[q] - overlap))
        for x in hit.tolist():
            if x != q and (not two or side[x] == 1) and found.join(int(node[q]), int(node[x])):
                out.append((int(node[q]), int(node[x])))
    return out


def _verify(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and block pair: links of each."""
    key, held, pairs = None, [], []

    def close():
        if len(held) > 1:
            node, codes, side = zip(*held)
            pairs.extend(links(np.array(node), list(codes), np.array(side), num, den))

    for batch in batches:
        heads = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
        side, node = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for words in W.word_slices(batch.column(5), W.BLANK):
            code, at, digest = sets(words, n)
            for d in range(words.n_docs):
                i = words.first + d
                if heads[i] != key:
                    close()
                    key, held = heads[i], []
                if digest[d] == node[i]:  # a repeated doc_id may bring another text
                    held.append((node[i], code[at[d] : at[d + 1]].copy(), side[i]))
        if len(pairs) > 100_000:
            yield _pairs(pairs)
            pairs = []
    close()
    yield _pairs(pairs)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _shipped(rows: DataFrame) -> DataFrame:
    """Narrow written rows, sent to all tasks where they are few; otherwise they are joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(SHIP_ROWS + 1).count() <= SHIP_ROWS else rows


def similar(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs`: the least doc_id reachable by links."""
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(lambda b: _scan(b, n), "kind tinyint, doc_id bigint, n bigint, code bigint"), "jaccard-sets")
    own = rows.where("kind = 0").select("doc_id", "n", "code")
    total, largest = own.agg(F.sum("n"), F.max("n")).first()
    common = spark.sparkContext.broadcast(_frequent(rows))
    levels = Levels(num, den, largest or 1)
    bits = max(0, math.ceil(math.log2(max(1, 4 * width, (total or 0) // (2 * BUCKET_ENTRIES)))))
    given = texts.where("doc_id IS NOT NULL").mapInArrow(lambda b: _give(b, n, common, levels, bits), "bucket bigint, codes binary, nodes binary")
    counts = given.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a bigint, b bigint, meet bigint, n bigint")
    ties = counts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("meet").alias("meet")).where("n >= meet").select("a", "b")
    grouped = components(ties)
    # groups with their blocks; a set is read once per block pair that it stands in
    roots = grouped.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = grouped.unionByName(roots)
    known = own.where("doc_id IS NOT NULL AND n > 0").groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = written(members.join(known, F.col("node") == F.col("code")).select("root", "node", "doc_id", "n"), "jaccard-groups")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = members.join(blocks, "root").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = written(placed.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "doc_id"), "jaccard-blocks")
    read = texts.join(_shipped(placed), "doc_id").select("root", "i", "j", "side", "node", "text")
    read = read.repartition(width, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = written(components(read.mapInArrow(lambda b: _verify(b, n, num, den), "a bigint, b bigint")), "jaccard-links")
    classed = own.join(found, F.col("code") == F.col("node"), "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "code")).alias("class"))
    least = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = classed.join(least, "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("bigint").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one document of each component: the one of the least doc_id; of rows with one id the
    one with the least text hash. Rows without doc_id all stay."""
    ids = written(similar(docs, n, num, den).where("doc_id IS NOT NULL").select("doc_id", "component_id"), "jaccard-ids")
    dropped = ids.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    repeated = ids.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("bigint").alias("id"))
    left = packed.join(_shipped(written(dropped, "jaccard-dropped")), "id", "left_anti")
    repeated = _shipped(written(repeated, "jaccard-repeated"))
    one = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("doc.text"), "doc.text"))
    again = left.join(repeated, "id", "left_semi").withColumn("place", one).where("place = 1")
    return left.join(repeated, "id", "left_anti").select("doc.*").unionByName(again.select("doc.*"))
