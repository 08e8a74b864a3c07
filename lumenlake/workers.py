"""What a Python worker keeps between its tasks.

Functions travel by value, so their module's globals are new in every task. What is dear to load (a model, a tokenizer with what
it remembers) is kept in a module of its own, which lives as long as the worker.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

_NAME = "_lumenlake_worker"


def kept(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives for key, made once in a worker; only the latest key of a kind is held, so memory does not grow."""
    home = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    held = home.get(kind)
    if held is None or held[0] != key:
        home[kind] = None  # what is not wanted any more goes before the next is made
        held = home[kind] = (key, make())
    return held[1]
