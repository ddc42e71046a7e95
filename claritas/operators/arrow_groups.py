"""Rows of one key side by side in Arrow batches, without a shuffle where they are partitioned by it already."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HELD_BYTES = 64 << 20  # of a group; a larger one waits in a file for its end


def with_first(df: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Sort the rows by key and `order`; `_first` marks the first of each key."""
    within = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    return df.withColumn("_first", F.row_number().over(within) == 1)


def firsts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where groups begin."""
    return np.flatnonzero(np.asarray(table.column("_first")))


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int = HELD_BYTES) -> Iterator[pa.Table]:
    """The rows of `with_first` in tables of whole groups; a group may span any number of batches."""
    held: list[pa.RecordBatch] = []
    size, spill, n_files = 0, None, 0
    with tempfile.TemporaryDirectory() as folder:

        def path() -> str:
            return os.path.join(folder, f"held-{n_files}")

        def spilled() -> None:
            nonlocal held, size, spill
            spill = spill or pa.ipc.new_file(path(), held[0].schema)
            for b in held:
                spill.write_batch(b)
            held, size = [], 0

        def taken() -> pa.Table:
            nonlocal held, size, spill, n_files
            if spill is None:
                table = pa.Table.from_batches(held)
            else:
                spilled()
                spill.close()
                table = pa.ipc.open_file(pa.memory_map(path())).read_all()
                os.unlink(path())  # the mapping stays until the table goes
                spill, n_files = None, n_files + 1
            held, size = [], 0
            return table

        for batch in batches:
            begins = firsts(batch)
            cut = int(begins[0]) if len(begins) else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
                size += held[-1].nbytes
            if len(begins):
                if held or spill:
                    yield taken()
                if begins[-1] > cut:
                    yield pa.Table.from_batches([batch.slice(cut, int(begins[-1]) - cut)])
                held = [batch.slice(int(begins[-1]))]
                size = held[0].nbytes
            if size > limit:
                spilled()
        if held or spill:
            yield taken()
