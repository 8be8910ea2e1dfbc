"""Arrow batches in slices of bounded size: a batch of ten thousand long texts never stands in a worker as Python strings at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: By kind and key; a worker keeps its solvers, and what they have learnt, from task to task of their operator.
TOOLS: dict = {}


def tidy() -> None:
    """Give freed memory back to the machine: a worker lives on through stages that have no use for it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def put_away() -> None:
    """Forget the solvers of operators that ran in this worker before; for operators that need none."""
    if TOOLS:
        TOOLS.clear()
        tidy()


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of the column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size)))
        yield batch.slice(lo, hi - lo)
        lo = hi
    tidy()
