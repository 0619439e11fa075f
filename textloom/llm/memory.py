"""Memory of Python workers, which live on from task to task and from stage to stage."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns to the system what this process has freed but still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a function of glibc alone
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Lets a function over a task's batches give its memory back when the task is through with it."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run
