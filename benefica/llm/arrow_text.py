"""Texts of Arrow batches as flat byte arrays, in stretches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STRETCH = 4 << 20  # bytes of text at a time; one longer text is a stretch of its own


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row starts (one more entry than rows)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def stretches(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts) of the texts of consecutive rows, about ``STRETCH`` bytes each."""
    data, at = raw(batch.column(text))
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STRETCH, "right")) - 1)
        yield slice(lo, hi), data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``data`` as a binary array; ``starts`` has one more entry than there are stretches."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
