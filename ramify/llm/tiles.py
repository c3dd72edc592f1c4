"""Rows that belong together, one group after another, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one value of ``keys`` (whole numbers) after another; rows must come sorted by them."""
    open_rows: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        starts = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            mark = tuple(marks[:, a])
            if open_rows and mark != last:
                yield pa.Table.from_batches(open_rows)
                open_rows = []
            open_rows.append(batch.slice(a, b - a))
            last = mark
    if open_rows:
        yield pa.Table.from_batches(open_rows)
