"""Lower-casing that keeps offsets, and automata kept per Python worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: dict[Any, Any] = {}


def lower_in_place(text: str) -> str:
    """Lower case, character by character, so that every offset still holds in the original."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """make(), once per worker and key; a worker keeps the latest one only."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def fresh(name: str, columns: list[str]) -> str:
    """A name that is in none of the columns, whatever their case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name
