"""What a Python worker keeps from task to task, and how it lets go of it.

Workers live on and serve one operator after another. What one operator keeps
would be held beside all that the next ones need, once for each worker.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache, wraps

import pyarrow as pa

_clear = []


def kept(size: int):
    """``lru_cache(size)`` until ``release``."""

    def cached(make):
        found = lru_cache(size)(make)
        _clear.append(found.cache_clear)
        return found

    return cached


def release() -> None:
    """Drop what operators keep in this process, and give memory that is free back to the system."""
    for clear in _clear:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def alone(run):
    """A task ``run`` over Arrow batches that begins without what others keep and leaves no free memory behind."""

    @wraps(run)
    def task(batches):
        release()
        yield from run(batches)
        release()

    return task
