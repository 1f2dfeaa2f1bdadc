"""Arrow batches as flat byte arrays, for operators that run over whole texts.

Every helper works on bounded chunks: a batch is cut into runs of rows whose
UTF-8 text stays under a byte limit, so numpy temporaries stay bounded whatever
the batch size is.  A single text above the limit forms a chunk of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes (UTF-8 of strings) and n+1 int64 offsets of a string or binary column; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows under ``limit`` bytes."""
    data, off = text_parts(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def memory_returned() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def returned_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and freed memory goes back to the system when they are over."""
    yield from batches
    memory_returned()
