"""Sorted arrays in files of the scratch folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claritas.session import shuffle_width

PART = "kind tinyint, bucket bigint, a binary, b binary"


def local_folder(uri: str) -> str:
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError("memory-mapped files need spark.checkpoint.dir as a mounted folder")
    return unquote(found.path)


def save(path: str, arrays: list[np.ndarray]) -> None:
    """By rename: a repeated or speculative task leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for x in arrays:
            f.write(x.tobytes())
    os.replace(own, path)


def mapped(path: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file, given their types and lengths."""
    if not sum(n for _, n in kinds):
        return [np.zeros(0, k) for k, _ in kinds]
    raw, out, at = np.memmap(path, np.uint8, "r"), [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


def bucket_of(code: np.ndarray, bits: int) -> np.ndarray:
    return (code >> np.uint64(64 - bits)).astype(np.int64)


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal values."""
    if len(sorted_) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return start, np.append(start[1:], len(sorted_))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start, _ = runs(key)
    return key[start], np.add.reduceat(count, start) if len(start) else count


def parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int8(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "bucket", "a", "b"])


def grouped(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator:
    """(bucket, arrays a, arrays b) of rows sorted by bucket; (None, row, None) for rows below bucket 0."""
    bucket, a, b = None, [], []
    for batch in batches:
        for kind, at, x, y in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            if at < 0:
                yield None, (kind, at, x, y), None
                continue
            if at != bucket and a:
                yield bucket, a, b
                a, b = [], []
            bucket = at
            a.append(np.frombuffer(x, kinds[0]))
            b.append(np.frombuffer(y, kinds[1]))
    if a:
        yield bucket, a, b


def spread(df: DataFrame) -> DataFrame:
    """Rows of PART by bucket, each bucket whole and in a row."""
    return df.repartition(shuffle_width(df.sparkSession), "bucket").sortWithinPartitions("bucket")
