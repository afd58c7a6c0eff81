"""Objects that a worker process keeps between tasks (loaded vocabularies, models)."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """The object under ``key`` in this process, made once."""
    store = sys.modules.setdefault("_corpusmill_process_cache", types.ModuleType("_corpusmill_process_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def frugal(run: Callable) -> Callable:
    """``run`` over Arrow batches, giving freed memory back when a task ends, so that an
    idle worker does not hold its last task's peak beside the next stage."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return wrapped
