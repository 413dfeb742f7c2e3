"""What a worker keeps between tasks: the tables of one operator, with bounded tables of answers for pieces it meets again."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

ENTRY = 150  # bytes that an entry takes besides what its key and value hold


class Generations(dict):
    """A dictionary of at most about ``2 * size`` bytes: when the young half is full, the old half goes.

    Look an entry up with ``get``; if that is empty, ``old`` may still have it. Keys are str or
    bytes; of values only bytes count for the size.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.held, self.old = size, 0, {}

    def put(self, key, value) -> None:
        if self.held >= self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        self[key] = value


_loaders: list[Callable] = []


def trim() -> None:
    """Hands unused memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        give(0)


def per_worker(make: Callable) -> Callable:
    """``make``, whose last two results a worker keeps until an operator that does not use them runs in it."""

    @functools.wraps(make)
    def made(*args):
        out = make(*args)
        trim()  # reading a file takes more than what is made of it
        return out

    kept = functools.lru_cache(maxsize=2)(made)
    _loaders.append(kept)
    return kept


def forget(keeps: Callable | None = None) -> None:
    """Drops the results of all loaders but ``keeps``."""
    dropped = [kept for kept in _loaders if kept is not keeps and kept.cache_info().currsize]
    for kept in dropped:
        kept.cache_clear()
    if dropped:
        trim()
