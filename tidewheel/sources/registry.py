"""Which reader serves which kind of source."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self) -> None:
        self._readers: dict[str, Callable[..., Any]] = {}

    def register(self, kind: str, reader: Callable[..., Any]) -> None:
        if kind in self._readers:
            raise ValueError(f"kind {kind!r} has a reader already")
        self._readers[kind] = reader

    def reader(self, kind: str) -> Callable[..., Any]:
        return self._readers[kind]

    def kinds(self) -> set[str]:
        return set(self._readers)


class CannedReader:
    """Fixed results by source, for tests: a list of items or an exception; unknown sources get ``default``."""

    def __init__(self, results: dict[str, Any], default: Any = ()) -> None:
        self.results, self.default = results, default

    def __call__(self, source_id: str) -> list[Any]:
        found = self.results.get(source_id, self.default)
        if isinstance(found, Exception):
            raise found
        return list(found)
