"""What a Python worker keeps from task to task: the state of one operator, so that it can't pile up beside the next one's."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_HELD: dict[tuple, Any] = {}


def hold(key: tuple, make: Callable[[], Any]) -> Any:
    """The state of that key, made if the worker hasn't it; any other is dropped."""
    if key not in _HELD:
        drop()
        _HELD[key] = make()
    return _HELD[key]


def drop() -> None:
    """Called by tasks that need memory of their own and keep nothing."""
    for state in _HELD.values():
        state.close()
    _HELD.clear()
