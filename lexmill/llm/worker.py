"""What a Python worker keeps between tasks: one operator's tables at a time.

Spark reuses workers for whatever comes next. Tables that make an operator fast (encodings of
words, transitions of an automaton) would pile up over the stages of a pipeline, so there is a
single place for them: what comes next drops what was there before.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

_kept: list = [None, None]


def kept(key: Any, build: Callable[[], Any]) -> Any:
    """The tables under ``key``; another key's are dropped first, and their memory goes back to the system."""
    if _kept[0] != key:
        drop()
        _kept[:] = key, build()
    return _kept[1]


def drop() -> None:
    if _kept[0] is None:
        return
    _kept[:] = None, None
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """Cycle collection is off inside: it would walk large tables that hold no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
