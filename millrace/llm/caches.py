"""What a Python worker keeps between tasks: one cache at a time, so that operators don't add up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_HELD: dict[tuple, object] = {}


def release() -> None:
    """Hands memory that nothing holds any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def held(kind: str, key, make: Callable[[], object]):
    """The worker's object for a kind and key, made if it isn't the one held; any other is dropped first."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        release()
        _HELD[kind, key] = make()
    return _HELD[kind, key]
