"""Arrow batches in slices of bounded size.

Spark fills a batch by rows, so its bytes grow with its texts; as Python objects they take several times as much.  Work on
rows as Python objects goes over slices, so that a worker holds the objects of a few MB, however large the table is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of a slice, about (one row at least), and what an element of a list is taken for
MOST_BYTES, ELEMENT_BYTES = 2 << 20, 200


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row holds: its strings and the elements of its lists."""
    size = np.full(batch.num_rows, 16, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(column.type):
            size += pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * ELEMENT_BYTES
    return size


def small(batches: Iterable[pa.RecordBatch], most: int = MOST_BYTES, size: Callable[[pa.RecordBatch], np.ndarray] = row_bytes) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of about ``most`` bytes at most (rows counted by ``size``); an empty batch stays."""
    for batch in batches:
        upto, i = np.cumsum(size(batch)), 0
        if not len(upto):
            yield batch
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
            yield batch.slice(i, j - i)
            i = j
