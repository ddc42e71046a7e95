"""Suffix-array dedup: repeated strings of `length` bytes from merged Burrows-Wheeler orders.

What is computed: a byte goes if some string of `length` (400) bytes that covers it also starts anywhere
else; strings lie inside one document and are judged on the input.

A plain merge of byte-wise transforms takes `length` rounds over every suffix of the corpus, each a
shuffle. Two things keep the method and drop that cost.

*Anchors.* In every window of `length` bytes the anchor is the start of the least GRAM-gram by hash,
leftmost on ties. Equal windows have their anchor at the same depth. Only suffixes at anchors are sorted,
about one in 185; the windows of an anchor are the depths at which it is seen. Windows are split in two
halves by depth: all windows of a half share some 216 bytes around the anchor (the key of the half), so
only anchors whose key stands elsewhere too need to be looked at.

*Refinement.* The anchors of a key meet in one task, from all shards, with the bytes that their windows
span (equal ones once). They are sorted once, by the suffix at the anchor, with the common prefixes of
neighbours. The order one byte further left is the stable partition of the present order by the byte
before (the step from a transform's last column to its first), and common prefixes carry over as range
minima; so each round refines the interleave of the shards' suffixes, re-sorts nothing, and gives the
repeated intervals of one depth: neighbours whose common prefix and depth sum to `length`. Suffixes that
are alone, or can no longer reach `length`, leave.

Three scans of the texts: keys, spans, result. Repeated keys and results are sorted arrays in files that
workers map. A document is cut into pieces of windows, so memory is bounded for any text. Keys and spans
are told apart by 64-bit hashes; bytes decide inside a key.

Hot keys. Equal spans, however many, are summed in every task before the shuffle. A key that stands at more
than `heavy` anchors (a passage of some 216 bytes in very many places) is not used: its windows are
split into ranges of SUB depths, whose keys cover all but SUB - 1 bytes of a window; so what differs around the
passage lies apart. These narrow keys are counted in a scan of their own (only where there are heavy keys).
One that still stands at more than `heavy` anchors is split into single depths: the key is then the whole
window, so a summed count above 1 decides, and no bytes are gathered. So no task meets more than `heavy`
spans of a key.

Nulls: a null text is empty; rows of any id count each, so a repeated row removes both copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm import files
from claritas.llm import words as W
from claritas.session import scratch_path, shuffle_width

GRAM = 32
PIECE = 1 << 20
FLUSH_KEYS = 500_000
FLUSH_BYTES = 24 << 20
BATCH_SPANS = 16_384
SUB = 12
HEAVY = 50_000


class Spot:
    """Anchors of one piece: position, and first and last start of its windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        n = len(raw)
        self.raw, self.length, self.half = raw, length, (length - GRAM) // 2
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(W.BYTE_CODE[raw] * W.powers(W.BASE, n), out=sums[1:])
        self.sums, self.inverse = sums, W.powers(W.INVERSE, n + 1)
        span = length - GRAM + 1
        if n < length:
            self.at = self.first = self.last = np.zeros(0, np.int64)
            return
        gram = W.mix((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        least = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
        start = np.flatnonzero(np.arange(len(anchor)) + length <= end)
        if len(start) == 0:
            self.at = self.first = self.last = start
            return
        a = anchor[start]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
        stop = np.append(cut[1:], len(start)) - 1
        self.at, self.first, self.last = a[cut], start[cut], start[stop]

    def code(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * W.ODD)

    def part(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray, first: int, end: int) -> tuple:
        """Windows at depths first..end-1 of the anchors `rows`: (anchors, least depth, largest depth, key, first).

        The key is a code of the bytes that all these depths share.
        """
        keep = (low < end) & (high >= first)
        rows, low, high = rows[keep], np.maximum(low[keep], first), np.minimum(high[keep], end - 1)
        at = self.at[rows]
        key = W.mix(self.code(at - first, at - end + 1 + self.length) + W.mix(np.array([first * 65537 + end], np.uint64)))
        return rows, low, high, key, first

    def halves(self) -> Iterator[tuple]:
        rows, low, high = np.arange(len(self.at)), self.at - self.last, self.at - self.first
        yield self.part(low, high, rows, 0, self.half)
        yield self.part(low, high, rows, self.half, self.length - GRAM + 1)

    def narrow(self, keys: Found) -> Iterator[tuple]:
        """The windows of heavy keys by SUB narrow ranges of depths, and the end of each range."""
        for rows, low, high, key, first in self.halves():
            heavy = np.flatnonzero(keys.find(key) == 1)
            if len(heavy):
                end = self.half if first == 0 else self.length - GRAM + 1
                for cut in range(first, end, SUB):
                    stop = min(end, cut + SUB)
                    yield *self.part(low[heavy], high[heavy], rows[heavy], cut, stop), stop

    def wanted(self, keys: Found, narrow: Found) -> Iterator[tuple]:
        """What must be compared: anchors with repeated keys; those of heavy keys by narrow ranges of depths,
        those of heavy narrow keys by single depths (the last value is then True: the key is the whole window)."""
        for rows, low, high, key, first in self.halves():
            light = np.flatnonzero(keys.find(key) == 0)
            yield rows[light], low[light], high[light], key[light], first, False
        for rows, low, high, key, first, stop in self.narrow(keys):
            place = narrow.find(key)
            light, heavy = np.flatnonzero(place == 0), np.flatnonzero(place == 1)
            yield rows[light], low[light], high[light], key[light], first, False
            if len(heavy):
                for cut in range(first, stop):
                    yield *self.part(low[heavy], high[heavy], rows[heavy], cut, cut + 1), True

    def spans(self, chosen: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the bytes that the windows of these depths span, and a code of all that."""
        start, end = self.at[chosen] - high, self.at[chosen] - low + self.length
        depth = low.astype(np.uint64) << np.uint64(16) | high.astype(np.uint64)
        return start, end, W.mix(self.code(start, end) ^ W.mix(key ^ W.mix(depth + np.uint64(1))))


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(index of first text, byte offset in it, bytes, offsets); every window start is in one piece."""
    for first, raw, offsets in W.text_slices(column, PIECE):
        if len(raw) <= 2 * PIECE:
            yield first, 0, raw, offsets
            continue
        for at in range(0, len(raw), PIECE):
            part = raw[at : at + PIECE + length - 1]
            yield first, at, part, np.array([0, len(part)])


def _keys(batches: Iterator[pa.RecordBatch], length: int, bits: int, keys: Found | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of halves; with `keys`, of the narrow keys of the heavy ones."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        count = count.astype(np.uint32)
        bucket = files.bucket_of(key, bits)
        return files.parts([(0, int(bucket[s]), key[s:e].tobytes(), count[s:e].tobytes()) for s, e in zip(*files.runs(bucket))])

    for batch in batches:
        for _, _, raw, offsets in pieces(batch.column(0), length):
            spot = Spot(raw, offsets, length)
            for part in spot.halves() if keys is None else spot.narrow(keys):
                held.append(part[3])
                size += len(part[3])
            if size > FLUSH_KEYS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch], folder: str, name: str, heavy: int) -> Iterator[pa.RecordBatch]:
    for bucket, a, b in files.grouped(batches, (np.uint64, np.uint32)):
        key, count = files.summed(a, b)
        key, count = key[count > 1], count[count > 1]
        files.save(f"{folder}/{name}-{bucket}", [key, (count > heavy).astype(np.uint8)])
        yield files.parts([(0, bucket, np.array([len(key), len(key), (count > heavy).sum()], np.int64).tobytes(), b"")])


class Found:
    """Sorted codes in bucket files, looked up by map."""

    def __init__(self, folder: str, name: str, bits: int, sizes: np.ndarray, more: tuple):
        self.folder, self.name, self.bits, self.sizes, self.more = folder, name, bits, sizes, more
        self.maps: dict[int, list] = {}

    def of(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self.maps:
            kinds = [("u8", int(self.sizes[bucket, 0])), *[(k, int(n)) for k, n in zip(self.more, self.sizes[bucket, 1:])]]
            self.maps[bucket] = files.mapped(f"{self.folder}/{self.name}-{bucket}", kinds)
        return self.maps[bucket]

    def find(self, code: np.ndarray) -> np.ndarray:
        """The value beside each code in the file of its bucket, -1 where it is not."""
        out = np.full(len(code), -1, np.int64)
        bucket = files.bucket_of(code, self.bits)
        order = np.argsort(bucket, kind="stable")
        for s, e in zip(*files.runs(bucket[order])):
            k, spot = int(bucket[order[s]]), order[s:e]
            if self.sizes[k, 0]:
                known, value = self.of(k)[:2]
                at = np.minimum(np.searchsorted(known, code[spot]), len(known) - 1)
                out[spot] = np.where(known[at] == code[spot], value[at], -1)
        return out


HEAD = np.dtype([("code", "<u8"), ("key", "<u8"), ("count", "<u4"), ("size", "<u4"), ("low", "<u2"), ("high", "<u2"), ("base", "<u2"), ("none", "<u2")])


def _spans(batches: Iterator[pa.RecordBatch], length: int, bits: int, keys: Found, narrow: Found) -> Iterator[pa.RecordBatch]:
    """Spans of anchors with repeated keys, equal ones of a flush once, by bucket of the key."""
    heads, bodies, size, seen = [], [], 0, {}

    def flush() -> pa.RecordBatch:
        head = np.concatenate(heads)
        code, first, where = np.unique(head["code"], return_index=True, return_inverse=True)
        kept = head[first]
        kept["count"] = np.minimum(np.bincount(where, head["count"], len(code)), 2).astype(np.uint32)
        bucket = files.bucket_of(kept["key"], bits)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for s, e in zip(*files.runs(bucket[order])):
            pick = order[s:e]
            rows.append((1, int(bucket[pick[0]]), kept[pick].tobytes(), b"".join(bodies[first[i]] for i in pick)))
        return files.parts(rows)

    for batch in batches:
        for _, _, raw, offsets in pieces(batch.column(0), length):
            spot = Spot(raw, offsets, length)
            for chosen, low, high, key, base, whole in spot.wanted(keys, narrow):
                start, end, code = spot.spans(chosen, low, high, key)
                _, first, where = np.unique(code, return_index=True, return_inverse=True)
                many = np.bincount(where, minlength=len(first))
                head = np.zeros(len(first), HEAD)
                for name, value in (("code", code), ("key", key), ("size", start - start if whole else end - start), ("low", low), ("high", high)):
                    head[name] = value[first]
                head["count"], head["base"] = np.minimum(many, 2), base
                heads.append(head)
                for i in first:
                    bodies.append(b"" if whole else raw[start[i] : end[i]].tobytes())
                size += len(head) * HEAD.itemsize + int(head["size"].sum())
            if size > FLUSH_BYTES:
                yield flush()
                heads, bodies, size = [], [], 0
    if heads and sum(len(h) for h in heads):
        yield flush()


def refine(head: np.ndarray, body: list[bytes], length: int) -> list[np.ndarray]:
    """For spans sorted by key, of one base: per span the depths (from its least on) of windows that stand in another span too.

    Spans of a key are equal from the anchor back to the depth `base`.
    """
    n = len(head)
    low, high = head["low"].astype(np.int64), head["high"].astype(np.int64)
    left, right = int(high.max()), length - int(low.min())
    table = np.zeros((n, left + right), np.uint8)
    for i, b in enumerate(body):
        at = left - int(high[i])
        table[i, at : at + len(b)] = np.frombuffer(b, np.uint8)
        row = table[i, at : at + len(b)]
        row[row == 0] = 255  # no byte of UTF-8; zero stays for "nothing here"
    hit = np.zeros((n, int((high - low).max()) + 1), bool)
    suffix = np.ascontiguousarray(table[:, left:]).view(f"S{right}").ravel()
    group = np.cumsum(np.concatenate([[0], head["key"][1:] != head["key"][:-1]]))
    order = np.argsort(suffix, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    kind = group[order].astype(np.int64)
    common = np.full(n, -1, np.int64)  # common prefix with the neighbour before, of the suffix at the anchor
    for s in range(1, n, 4096):
        a, b = table[order[s - 1 : s + 4095], left:][: min(4096, n - s)], table[order[s : s + 4096], left:]
        differs = (a != b) | (b == 0)
        common[s : s + 4096] = np.where(differs.any(1), differs.argmax(1), right)
    common[np.concatenate([[True], kind[1:] != kind[:-1]])] = -1
    for depth in range(int(head["base"][0]), int(high.max()) + 1):
        # leave: past their depths, or too far from both neighbours
        after = np.append(common[1:], -1)
        stay = (high[order] >= depth) & (np.maximum(common, after) + high[order] >= length)
        if not stay.all():
            order, kind, common = _left(order, kind, common, stay)
        if len(order) < 2:
            break
        # repeated intervals of this depth
        open_ = (low[order] <= depth) & (depth <= high[order])
        pair = np.flatnonzero((common >= length - depth) & open_ & np.concatenate([[False], open_[:-1]]))
        for i in (order[pair], order[pair - 1]):
            hit[i, depth - low[i]] = True
        # one byte further left
        if depth == int(high.max()):
            break
        byte = table[order, left - depth - 1].astype(np.int64)
        value = kind * 256 + byte
        step = np.diff(value)
        if (step < 0).any():
            place = np.argsort(value, kind="stable")
            value = value[place]
            common = _carried(common, place, value)
            order = order[place]
        else:
            common = np.where(np.concatenate([[True], step != 0]), -1, common)
        kind = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
    return [np.flatnonzero(row) for row in hit]


def _left(order, kind, common, stay):
    """The order without some suffixes; a gap's common prefix is the least on the way."""
    kept = np.flatnonzero(stay)
    if len(kept) == 0:
        return order[:0], kind[:0], common[:0]
    out = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
    out[0] = -1
    return order[kept], kind[kept], out


def _carried(common: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Common prefixes after a stable partition: range minima of those before."""
    out = np.full(len(place), -1, np.int64)
    same = np.flatnonzero(value[1:] == value[:-1]) + 1
    near = same[place[same] == place[same - 1] + 1]
    out[near] = common[place[near]]
    far = same[place[same] != place[same - 1] + 1]
    if len(far):
        padded = np.append(common, -1)
        bounds = np.stack([place[far - 1] + 1, place[far] + 1], axis=1).ravel()
        out[far] = np.minimum.reduceat(padded, bounds)[::2]
    return out


def _merge(batches: Iterator[pa.RecordBatch], folder: str, length: int) -> Iterator[pa.RecordBatch]:
    """Files of span codes with the depth ranges of repeated windows."""

    def close(bucket: int, heads: list, blobs: list) -> pa.RecordBatch:
        head = np.concatenate(heads)
        blob, shift = b"".join(blobs), 0
        begin = np.zeros(len(head), np.int64)
        for h, b in zip(heads, blobs):
            size = h["size"].astype(np.int64)
            begin[shift : shift + len(h)] = np.concatenate([[0], np.cumsum(size)[:-1]])
            shift += len(h)
        base = np.repeat(np.concatenate([[0], np.cumsum([len(b) for b in blobs])[:-1]]), [len(h) for h in heads])
        begin += base
        code, first, where = np.unique(head["code"], return_index=True, return_inverse=True)
        count = np.bincount(where, head["count"], len(code))
        head, begin = head[first], begin[first]
        order = np.lexsort((head["key"], head["base"]))
        head, begin, count = head[order], begin[order], count[order]
        start, end = files.runs(head["key"])
        depths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(head)
        batch: list[int] = []

        def work() -> None:
            for i, d in zip(batch, refine(head[batch], [blob[begin[i] : begin[i] + int(head["size"][i])] for i in batch], length)):
                depths[i] = d
            batch.clear()

        for s, e in zip(start, end):
            if e - s > 1 and head["size"][s]:
                if batch and (len(batch) + e - s > BATCH_SPANS or head["base"][batch[0]] != head["base"][s]):
                    work()
                batch.extend(range(s, e))
        if batch:
            work()
        for i in np.flatnonzero(count > 1):
            depths[i] = np.arange(int(head["high"][i]) - int(head["low"][i]) + 1)
        keep = [i for i in range(len(head)) if len(depths[i])]
        keep.sort(key=lambda i: int(head["code"][i]))
        ranges, pointer = [], [0]
        for i in keep:
            d = depths[i] + int(head["low"][i])
            cut = np.flatnonzero(np.diff(d) != 1)
            firsts, lasts = d[np.concatenate([[0], cut + 1])], d[np.append(cut, len(d) - 1)]
            ranges.append(np.stack([firsts, lasts], axis=1).ravel())
            pointer.append(pointer[-1] + len(firsts))
        flat = np.concatenate(ranges).astype(np.uint16) if ranges else np.zeros(0, np.uint16)
        files.save(f"{folder}/spans-{bucket}", [head["code"][keep], np.array(pointer, np.uint32), flat])
        return files.parts([(1, bucket, np.array([len(keep), len(pointer), len(flat)], np.int64).tobytes(), b"")])

    bucket, heads, blobs = None, [], []
    for batch in batches:
        for at, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if at != bucket and heads:
                yield close(bucket, heads, blobs)
                heads, blobs = [], []
            bucket = at
            heads.append(np.frombuffer(a.as_py(), HEAD))
            blobs.append(b.as_py())
    if heads:
        yield close(bucket, heads, blobs)


def _apply(batches: Iterator[pa.RecordBatch], length: int, keys: Found, narrow: Found, found: Found, digest: bool) -> Iterator[pa.RecordBatch]:
    """Per row its kept columns, then n_bytes, n_removed, n_spans and kept_sha256, or the text that is left."""
    for batch in batches:
        last = batch.num_columns - 1
        texts = batch.column(last)
        gone: dict[int, np.ndarray] = {}

        def cover(first: int, base: int, raw: np.ndarray, offsets: np.ndarray) -> None:
            spot = Spot(raw, offsets, length)
            mark = np.zeros(len(raw) + 1, np.int32)
            any_ = False
            for chosen, low, high, key, _, _ in spot.wanted(keys, narrow):
                _, _, code = spot.spans(chosen, low, high, key)
                # spans are filed by the bucket of their key
                bucket = files.bucket_of(key, found.bits)
                order = np.argsort(bucket, kind="stable")
                for s, e in zip(*files.runs(bucket[order])):
                    k, rows = int(bucket[order[s]]), order[s:e]
                    if not found.sizes[k, 0]:
                        continue
                    known, pointer, ranges = found.of(k)
                    at = np.minimum(np.searchsorted(known, code[rows]), len(known) - 1)
                    ok = known[at] == code[rows]
                    rows, at = rows[ok], at[ok]
                    many = pointer[at + 1].astype(np.int64) - pointer[at]
                    if not len(rows):
                        continue
                    any_ = True
                    pick = np.repeat(pointer[at].astype(np.int64) - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    anchor = np.repeat(spot.at[chosen[rows]], many)
                    np.add.at(mark, anchor - ranges[2 * pick + 1].astype(np.int64), 1)
                    np.add.at(mark, anchor - ranges[2 * pick].astype(np.int64) + length, -1)
            if any_:
                covered = np.cumsum(mark[:-1]) > 0
                for d in range(len(offsets) - 1):
                    part = covered[offsets[d] : offsets[d + 1]]
                    if part.any():
                        whole = gone.get(first + d)
                        if whole is None:
                            size = len((texts[first + d].as_py() or "").encode())
                            whole = gone[first + d] = np.zeros(size, bool)
                        whole[base : base + len(part)] |= part

        for first, base, raw, offsets in pieces(texts, length):
            cover(first, base, raw, offsets)
        n_bytes, n_removed, n_spans, result = [], [], [], []
        for i, text in enumerate(texts.to_pylist()):
            raw = (text or "").encode()
            cut = gone.get(i)
            n_bytes.append(len(raw))
            if cut is None:
                n_removed.append(0)
                n_spans.append(0)
            else:
                n_removed.append(int(cut.sum()))
                n_spans.append(int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()))
                raw = np.frombuffer(raw, np.uint8)[~cut].tobytes()
            result.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode(errors="ignore"))
        kept = [batch.column(k) for k in range(last)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(result, pa.string())],
            [*batch.schema.names[:last], "n_bytes", "n_removed", "n_spans", "result"],
        )


def _sizes(df: DataFrame, bits: int, width: int) -> np.ndarray:
    out = np.zeros((1 << bits, width), np.int64)
    for r in df.toLocalIterator():
        out[r["bucket"]] = np.frombuffer(r["a"], np.int64)
    return out


def dedup(docs: DataFrame, keep: list[str], length: int = 400, digest: bool = True, heavy: int = HEAVY) -> DataFrame:
    """Columns `keep`, n_bytes, n_removed, n_spans, then kept_sha256 (of the bytes left) or, without
    `digest`, kept_text (bytes of cut characters at the edges of a removed run are dropped)."""
    if length < GRAM + 2:
        raise ValueError(f"length must be at least {GRAM + 2}")
    spark = docs.sparkSession
    folder = files.local_folder(scratch_path(spark, "suffixes"))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(4 * shuffle_width(spark), size // 8_000_000))))
    counted = files.spread(texts.mapInArrow(lambda b: _keys(b, length, bits), files.PART))
    sizes = _sizes(counted.mapInArrow(lambda b: _repeated(b, folder, "keys", heavy), files.PART), bits, 3)
    keys, sizes_of_narrow = Found(folder, "keys", bits, sizes, ("u1",)), np.zeros_like(sizes)
    if sizes[:, 2].any():
        counted_narrow = files.spread(texts.mapInArrow(lambda b: _keys(b, length, bits, keys), files.PART))
        sizes_of_narrow = _sizes(counted_narrow.mapInArrow(lambda b: _repeated(b, folder, "narrow", heavy), files.PART), bits, 3)
    narrow = Found(folder, "narrow", bits, sizes_of_narrow, ("u1",))
    given = files.spread(texts.mapInArrow(lambda b: _spans(b, length, bits, keys, narrow), files.PART))
    found = Found(folder, "spans", bits, _sizes(given.mapInArrow(lambda b: _merge(b, folder, length), files.PART), bits, 3), ("u4", "u2"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_bytes bigint, n_removed bigint, n_spans bigint, result string"])
    picked = docs.select(*keep, F.col("text").cast("string").alias(W.free("_text", keep)))
    out = picked.mapInArrow(lambda b: _apply(b, length, keys, narrow, found, digest), schema)
    return out.withColumnRenamed("result", "kept_sha256" if digest else "kept_text")
