"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system, as far as the C library can: Spark keeps a worker for later tasks, and what it holds counts beside the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches, after whose last one freed memory is given back."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def returning_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """As returning, for a function of one group; for groups large enough to be worth it."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return whole
