"""Memory of Python workers, which live on from task to task: bounded memories, and giving freed memory back when a task ends."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes that a memory of words may take in a worker, as counted by their lengths and what Python needs for an entry.
LIMIT, ENTRY = 32_000_000, 200


class Remembered(dict):
    """Word -> ``make(word)``, forgotten all at once when it has grown to ``limit`` bytes."""

    def __init__(self, make: Callable, limit: int = LIMIT):
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, word):
        self.held += len(word) + ENTRY
        if self.held > self.limit:
            self.clear()
            self.held = 0
        self[word] = value = self.make(word)
        return value


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``function`` for mapInArrow; at the end of the task its memory goes back to the system, not only to the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()

    return run
