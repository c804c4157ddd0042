"""What a Python worker keeps between tasks, and how it gives memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa

_HELD: dict[str, tuple[Any, Any]] = {}


def held(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """The worker's object of a kind, made anew when ``key`` changes."""
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD.pop(kind, None)
        _HELD[kind] = (key, make())
    return _HELD[kind][1]


def release() -> None:
    """Give free memory of Arrow and the allocator back to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(keeps: str | None = None) -> Callable:
    """For functions of mapInArrow: before a task what other kinds than ``keeps`` left goes, after it free memory."""

    def around(task: Callable) -> Callable:
        @wraps(task)
        def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
            for kind in [k for k in _HELD if k != keeps]:
                del _HELD[kind]
            try:
                yield from task(batches, *args, **kwargs)
            finally:
                release()

        return run

    return around
