"""Values that aren't known yet: what they may be used for, and what depends on them.

A slot stands for the literals of many requests at once. It may be stored and written, which leaves its mark in the text that it is
written to; whatever looks at it, or at the order of texts that its mark decides, raises ``Undecided``.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterable, Sequence

#: Marks of a slot as it is, and as a value in a line, where it may be quoted.
RAW, SHOWN, MOST = 0xF0000, 0xF8000, 64
MARK = re.compile(f"[{chr(RAW)}-{chr(0xFFFFF)}]")
#: Ints of slots in a text to be decoded.
INTEGERS = 9_100_000_000_000_000


class Undecided(Exception):
    """The result depends on what these slots hold."""

    def __init__(self, slots: Iterable[int]):
        super().__init__("undecided")
        self.slots = set(slots)


class _State(threading.local):
    probing = False


state = _State()


def marked(text: str) -> set[int]:
    """The slots whose marks are in a text."""
    return {ord(m) - (SHOWN if ord(m) >= SHOWN else RAW) for m in MARK.findall(text)}


class TextSlot(str):
    """A string that isn't empty and has no quotes, backslashes and control characters."""

    @property
    def slot(self) -> int:
        return ord(self) - RAW

    @property
    def shown(self) -> str:
        return chr(SHOWN + self.slot)


class IntSlot(int):
    """A 64-bit int, written with its digits alone."""

    @property
    def slot(self) -> int:
        return int.__sub__(self, INTEGERS)

    def __str__(self) -> str:
        return chr(RAW + self.slot)

    def __format__(self, spec: str) -> str:
        return str(self)


def _refuse(self, *_, **__):
    raise Undecided([self.slot])


_KEPT = {"__class__", "__new__", "__init__", "__init_subclass__", "__subclasshook__", "__getattribute__", "__setattr__", "__delattr__", "__doc__", "__dir__", "__str__", "__format__"}
for _slot in (TextSlot, IntSlot):
    for _name in {*dir(_slot.__base__), "__bool__"} - _KEPT:
        setattr(_slot, _name, _refuse)
SLOTS = (TextSlot, IntSlot)


def sure(in_order: Sequence[str]) -> None:
    """Raises unless these texts, sorted by their marks, are in that order whatever the slots hold, with the same ones equal."""
    for a, b in zip(in_order, in_order[1:]):
        if a != b:
            at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if found := marked(a[at : at + 1] + b[at : at + 1]):
                raise Undecided(found)


def sure_strings(values: Sequence[str]) -> bool:
    """The same of strings that are compared as numbers where they are numbers; whether there are marks at all."""
    values = [str(v) for v in values]
    found = {s for v in values for s in marked(v)}
    if found:
        if any(not v or v[0] in "+-. \t\n\r\v\f" or "0" <= v[0] <= "9" or MARK.match(v) for v in values):
            raise Undecided(found)
        sure(sorted(values))
    return bool(found)
