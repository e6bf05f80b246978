"""Memory of Python workers.

Spark keeps workers from task to task and from query to query.  What one
operator caches there (encoders, tables of powers) is of use to its next
partition, not to the next operator, so it goes when another operator starts;
and freed pages go back to the machine at the end of each partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_clear: list[Callable[[], object]] = []
_owner: list[str] = [""]


def caching(clear: Callable[[], object]) -> None:
    """Register what empties a module's cache."""
    _clear.append(clear)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def begin(owner: str) -> None:
    if _owner[0] != owner:
        for clear in _clear:
            clear()
        _owner[0] = owner
        trim()


def tended(owner: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that cleans up around a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        try:
            yield from rows(batches)
        finally:
            trim()

    return run
