"""Arrow batches in pieces of bounded size, for Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, in order, in slices that end once they hold ``most`` bytes of the column, or ``rows`` rows.

    A slice is what a worker turns into Python values at a time; a single longer text is a slice whole.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)) + 1
        hi = min(full, lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
