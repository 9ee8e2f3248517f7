"""A bounded memory of computed values with two generations: what is asked for again outlives a turn. Giving freed memory back."""

from __future__ import annotations

import ctypes

import pyarrow as pa


class Memo(dict):
    """memo[key] computes a missing value once. At most 2 * limit values are held."""

    def __init__(self, compute, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Freed memory goes back to the system: Spark reuses Python workers, and an idle one counts beside the stage that follows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
