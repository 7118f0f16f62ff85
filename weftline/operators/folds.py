"""Folds whose next step needs the last one's result: conditional appends and block cuts.

Rows are dealt by stream and sorted; a task carries one small state along, so the memory it needs
does not depend on how long a stream is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa


def accepted_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, pos, expected, current) to (stream, pos, expected, ok, version), by stream and pos."""
    stream = version = None
    for batch in batches:
        ok, versions = [], []
        for name, expected, current in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if name != stream:
                stream, version = name, current
            good = expected == -1 or expected == version + 1
            version += good
            ok.append(good)
            versions.append(version if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ok, pa.bool_()), pa.array(versions, pa.int32())], ["stream", "pos", "expected", "ok", "version"])


def block_numbers(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(stream, version, rec_size) with the first version of each event's block, by stream and version."""
    stream, start, used = None, 0, 0
    for batch in batches:
        starts = np.empty(batch.num_rows, np.int32)
        for i, (name, version, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if name != stream or used + size > budget:
                stream, start, used = name, version, 0
            used += size
            starts[i] = start
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts)], [*batch.schema.names, "start_version"])


def blocks_within(budget: int):
    return partial(block_numbers, budget=budget)
