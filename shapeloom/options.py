"""Options of the digest: what is erased, what is capped and how the fingerprint is written."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

LEVELS = ("none", "values", "structural")
INDEX_MODES = ("date-patterns", "identity")


class InvalidOption(ValueError):
    """An option of a wrong name, type or value."""


@dataclass(frozen=True)
class Options:
    """Immutable. ``None`` lifts a cap; ``hash_length`` is held within 4 and 64.

    ``renderers``: for clause types that aren't built in, a function from the clause's body to ``extension.Clause`` or None;
    any one marks the fingerprint's version with an x. ``redactor``: (field, value) to the value that is shown.
    """

    normalization: str = "values"
    max_clauses: int | None = 12
    max_values: int | None = 5
    max_length: int | None = 512
    index_normalizer: str = "date-patterns"
    agg_names: bool = False
    hash_version: str = "q4"
    hash_length: int = 12
    redactor: Callable[[str, Any], Any] | None = None
    renderers: Mapping[str, Callable[[dict], Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, allowed in (("normalization", LEVELS), ("index_normalizer", INDEX_MODES)):
            if getattr(self, name) not in allowed:
                raise InvalidOption(f"{name} is one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        object.__setattr__(self, "hash_length", max(4, min(64, self.hash_length)))

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> Options:
        """Options by their public names (camel case), with strict types."""
        found: dict[str, Any] = {}
        for key, value in spec.items():
            if key not in _NAMES:
                raise InvalidOption(f"no option {key!r}; there are {', '.join(_NAMES)}")
            name, kinds = _NAMES[key]
            if type(value) not in kinds:
                raise InvalidOption(f"{key} can't be {type(value).__name__}")
            found[name] = value
        return cls(**found)

    def with_renderer(self, clause: str, renderer: Callable[[dict], Any]) -> Options:
        return replace(self, renderers={**self.renderers, clause: renderer})

    @property
    def version(self) -> str:
        return self.hash_version + ("x" if self.renderers else "")


_CAP = (int, type(None))
_NAMES: dict[str, tuple[str, tuple[type, ...]]] = {
    "normalization": ("normalization", (str,)), "maxClauses": ("max_clauses", _CAP), "maxValues": ("max_values", _CAP), "maxLength": ("max_length", _CAP),
    "indexNormalizer": ("index_normalizer", (str,)), "aggNames": ("agg_names", (bool,)), "hashVersion": ("hash_version", (str,)), "hashLength": ("hash_length", (int,)),
}
