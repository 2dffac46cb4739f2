"""Named extension points: adapters, extractors and scorers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """A name -> object table that refuses unnamed and repeated entries."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, Any] = {}

    def add(self, name: str, entry: Any) -> Any:
        if not name:
            raise ValueError(f"{self.kind}: an entry needs a name")
        if name in self._entries:
            raise ValueError(f"{self.kind} {name!r} is already registered")
        self._entries[name] = entry
        return entry

    def register(self, name: str) -> Callable[[Any], Any]:
        return lambda entry: self.add(name, entry)

    def get(self, name: str) -> Any:
        if name not in self._entries:
            raise KeyError(f"no {self.kind} {name!r}; registered: {self.names()}")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)
