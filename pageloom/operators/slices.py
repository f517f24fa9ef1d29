"""Row slices of Arrow batches with about so many bytes in a column, so that a map holds little beside its input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of HTML or text that are worked on at once; a larger one is alone in its slice.
LIMIT = 1 << 20


def slices(batch: pa.RecordBatch, column: str | int, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
