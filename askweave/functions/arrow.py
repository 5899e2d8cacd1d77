"""Arrow batches in pieces whose working memory has a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; a single longer text is taken alone.
SLICE_BYTES = 8 << 20


def text_slices(values: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (start, length) of at most ``limit`` bytes of text, or of one row."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    n = len(values)
    if not n:
        return
    width = 8 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else 4
    ends = np.frombuffer(values.buffers()[1], np.int64 if width == 8 else np.int32, n + 1, offset=values.offset * width).astype(np.int64)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield start, min(stop, n) - start
        start = min(stop, n)


def row_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes each, by its mean row."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
