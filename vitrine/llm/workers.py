"""What a task's Python function does before and after its work."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def tidy(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`work`, with memory going back to the system: Arrow's as soon as it is free, and what the allocator kept when the task ends.

    Workers live on between tasks, so what one stage needed at most would add to the next one's.
    """

    @wraps(work)
    def run(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run
