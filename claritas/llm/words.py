"""Vectorised words of whole texts, for Arrow batches inside tasks.

A batch is cut into slices of a few megabytes; a text is never cut. Words are byte runs in the
UTF-8 text with A-Z lower-cased. Two classes of word bytes are in use:

* ``ALNUM``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (digits, a-z, everything outside ASCII)
* ``BLANK``: ``[^\\x20\\x09-\\x0D]+`` (runs without ASCII white space)

A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
BLANK = np.ones(256, bool)
BLANK[32] = False
BLANK[9:14] = False

ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)
SLICE_BYTES = 512 << 10


def free(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur style)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_FORWARD: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker for the largest n asked for so far."""
    if base not in _FORWARD or len(_FORWARD[base]) < n:
        _FORWARD[base] = _powers(base, n)
    return _FORWARD[base][:n]


BASE = int(STEP)
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass
class Words:
    """Words of one slice. `doc` counts texts of the slice; `start`/`end` are byte offsets in `raw`."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    n_docs: int
    first: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def offsets(self) -> np.ndarray:
        """Index of the first word of every text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of first text, bytes, offsets) of runs of whole texts; about `limit` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, first: int = 0) -> Words:
    """Words of the texts raw[offsets[i]:offsets[i+1]] with a 64-bit code each (equal words, equal codes)."""
    n_docs = len(offsets) - 1
    low = LOWER[raw]
    inside = kind[low]
    cut = offsets[(offsets > 0) & (offsets < len(low))]
    # a word ends where its text ends: starts are judged with the byte before a text as a blank
    before = np.zeros(len(low), bool)
    if len(low):
        before[1:] = inside[:-1]
        before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(low), bool)
    if len(low):
        after[:-1] = inside[1:]
        after[cut - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_CODE[low] * powers(BASE, len(low)), out=sums[1:])
    code = (sums[end] - sums[start]) * powers(INVERSE, len(low) + 1)[start]
    code = mix(code + (end - start).astype(np.uint64) * ODD)
    return Words(low, start, end, doc, code, n_docs, first)


def word_slices(column: pa.Array, kind: np.ndarray = ALNUM, limit: int = SLICE_BYTES) -> Iterator[Words]:
    for first, raw, offsets in text_slices(column, limit):
        yield words_of(raw, offsets, kind, first)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, code) of every run of n words inside one text."""
    size = len(words.code)
    if size < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = size - n + 1
    code = np.zeros(last, np.uint64)
    for j in range(n):
        code = code * STEP + words.code[j : j + last]
    at = np.flatnonzero(words.doc[:last] == words.doc[n - 1 :])
    return at, mix(code[at])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of all runs of n words; a text of fewer words, but not none, has one: all of them."""
    at, code = grams(words, n)
    doc = words.doc[at]
    counts, offsets = words.counts(), words.offsets()
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        value = np.zeros(1, np.uint64)
        for c in words.code[offsets[d] : offsets[d + 1]]:
            value = value * STEP + c
        doc = np.append(doc, d)
        code = np.append(code, mix(value + np.uint64(int(counts[d]))))
    return doc, code


def distinct(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code), sorted."""
    if len(code) == 0:
        return doc, code
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[keep], code[keep]
