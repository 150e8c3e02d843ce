"""Forecast models and detectors of one's own, by name."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from tempora.functions.kernels import MODELS

KINDS = ("forecast", "detector")


@dataclass(frozen=True)
class Plugin:
    name: str
    kind: str
    function: Callable
    version: str
    sha256: str | None


def digest(function: Callable) -> str:
    """SHA-256 of a function's source."""
    return hashlib.sha256(inspect.getsource(function).encode()).hexdigest()


class Plugins:
    """Functions by (kind, name). A forecast is function(values, horizon, **options) -> Forecast, a detector function(rows, keys, value, order, **options) -> rows."""

    def __init__(self):
        self._held: dict[tuple[str, str], Plugin] = {}

    def add(self, name: str, kind: str, function: Callable, version: str = "1", sha256: str | None = None) -> Plugin:
        """``sha256``: refused where the function's source has another one."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
        if (kind, name) in self._held or (kind == "forecast" and name in MODELS):
            raise ValueError(f"{kind} {name!r} exists")
        if sha256 is not None and digest(function) != sha256:
            raise ValueError(f"{kind} {name!r} is not the function that was signed")
        self._held[kind, name] = made = Plugin(name, kind, function, version, sha256)
        return made

    def get(self, name: str, kind: str) -> Callable:
        if (kind, name) not in self._held:
            raise KeyError(f"no {kind} {name!r}; known: {', '.join(self.names(kind))}")
        return self._held[kind, name].function

    def remove(self, name: str, kind: str) -> None:
        self.get(name, kind)
        del self._held[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._held if k == kind)
