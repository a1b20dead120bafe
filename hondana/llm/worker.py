"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
from collections.abc import Callable


def kept(name: str, key: str, make: Callable):
    """The object made for ``name`` and ``key``. Workers keep one at a time, so that stages don't add up.

    Functions reach workers by value, with module globals of their own in each task, so it hangs on ``sys``.
    """
    held = sys.__dict__.setdefault("_hondana_kept", {})
    if (name, key) not in held:
        held.clear()
        held[name, key] = make()
    return held[name, key]
