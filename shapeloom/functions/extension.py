"""Clauses that a registered renderer reads."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..options import InvalidOption
from .jsoncompat import numeric


@dataclass(frozen=True)
class Clause:
    """Shown as ``name:label(k=v)``, or ``label(k=v)`` without a field's name."""

    label: str
    name: str = ""
    params: dict[str, Any] = field(default_factory=dict)

    def with_param(self, key: str, value: Any) -> Clause:
        if not isinstance(key, str) or not key or numeric(key):
            raise InvalidOption(f"a parameter's name is a string that isn't empty and no number, not {key!r}")
        return Clause(self.label, self.name, {**self.params, key: value})
