"""Helpers for operators that work on Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def texts(column: pa.Array) -> list[str | None]:
    """The strings of a column."""
    return column.to_pylist()


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text each, so that memory doesn't follow the length of texts; a longer row stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows < 2 or col.nbytes <= most:
        yield batch
        return
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + batch.num_rows + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def sliced(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], column: str, most: int = 16 << 20) -> Callable:
    """For mapInArrow: `function` applied to each slice of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, column, most):
                yield from function(part)

    return run
