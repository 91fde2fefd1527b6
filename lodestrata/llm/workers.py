"""Memory of the Python workers, which an executor keeps for the tasks of all its stages.

What a task frees stays with the worker: the C library keeps the gaps that large arrays leave between small
objects, and Arrow's pool keeps its pages. An executor would hold the largest task of each worker so far, beside a
heap that has grown as well. Freed pages go back to the system after each batch and at a task's end.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim; other C libraries have none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory returns to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def _each(batches: Iterator) -> Iterator:
    for batch in batches:
        yield batch
        del batch
        give_back()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, with freed memory given back after each batch and at the end."""

    def leaner(batches: Iterator) -> Iterator:
        try:
            yield from run(_each(batches))
        finally:
            give_back()

    return leaner
