"""What a Python worker remembers between tasks: words of one operator at a time."""

from __future__ import annotations

import gc
from collections.abc import Callable

_HELD: dict[str, Callable[[], None]] = {}


def enter(owner: str, forget: Callable[[], None]) -> None:
    """``owner`` begins a task in this worker. What another operator remembers is forgotten, as a worker lives on through all stages
    of a job and would hold the words of each."""
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
        gc.collect()
    _HELD[owner] = forget
