"""Memory of Python workers between tasks.

Spark keeps workers for later tasks, and a stage may hold several of them per core. What a task has freed stays
with the allocators of its worker until it is handed back, and what a module keeps per worker stays for good.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]

_forgetting: list[Callable[[], None]] = []


def at_end_of_task(forget: Callable[[], None]) -> None:
    """Has ``forget`` called in a worker whenever it ends a task of this module."""
    _forgetting.append(forget)


def give_back() -> None:
    """Hands what is freed back to the system."""
    for forget in _forgetting:
        forget()
    pa.default_memory_pool().release_unused()
    # Only the GNU C library has it.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function, whose worker gives memory back when the task ends."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """``mapInArrow`` in workers that give memory back."""
    return df.mapInArrow(thrifty(run), schema)
