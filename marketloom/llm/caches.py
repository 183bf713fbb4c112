"""Tables of remembered values, of which a Python worker keeps those of one kind of task only.

Workers live on from stage to stage; what one stage remembered would stay beside the next one's.
"""

from __future__ import annotations

from collections.abc import Callable

_held: dict[tuple, object] = {}


def remembered(kind: tuple, make: Callable):
    """The worker's table of this kind, made if it has none; those of other kinds are dropped."""
    if kind not in _held:
        _held.clear()
        _held[kind] = make()
    return _held[kind]


def forget() -> None:
    """Drop all tables; for tasks that need none."""
    _held.clear()
