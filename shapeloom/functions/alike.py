"""Requests that differ in literals only, digested once for all of them.

A request is tokenised, its simple literals become slots (``slots``), and what is left is a pattern; the rows that match it get their
lines from those of the first by putting in their own literals, in columns. Where a result depends on what a slot holds, the rows are
parted by it if it holds few values, and else left to be read one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..options import Options
from .extension import Clause
from .jsoncompat import MANY, brackets, decode
from .request import Line, _describe
from .slots import INTEGERS, MARK, MOST, RAW, SHOWN, SLOTS, IntSlot, TextSlot, Undecided, marked, state

#: Rows from which on a shape is worth it; shapes tried on a batch; values that rows are parted by.
LEAST, TRIED, PARTS = 8, 24, 16
#: Shapes that are probed for a batch at most.
PROBED = 48
_TOKEN = re.compile(r'(?s:("(?:[^"\\]|\\.)*"[ \t\n\r]*:)|"([^"\\\x00-\x1f]+)"|"(?:[^"\\]|\\.)*"|(-?[0-9][0-9.eE+-]*))')
_INTEGER = re.compile(r"-?[1-9][0-9]{0,17}|0")
_TEXT_FORM, _INT_FORM = r'"(?P<s%d>[^"\\\x00-\x1f]+)"', r"(?P<s%d>-?[1-9][0-9]{0,17}|0)"
_SIMPLE = re.compile(r'[^"\\\x00-\x1f]+')
_SPECIAL = re.compile(r"([\\.+*?()|\[\]{}^$])")
#: Of what a slot may hold, what is quoted in a line.
_QUOTED = r"[ '():<>|{}\[\]]"
_FOREIGN = re.compile(r'"wrapper"|\\u|91000000000000|[\x00-\x08\x0b\x0c\x0e-\x1f]')

Piece = str | tuple[int, bool]  # text as it stands, or a slot and whether it is a string's


def _pieces(text: str) -> list[Piece]:
    out: list[Piece] = []
    end = slot = 0
    for m in _TOKEN.finditer(text):
        if m[2] or m[3] and _INTEGER.fullmatch(m[3]):
            out += [text[end : m.start()], (slot, bool(m[2]))]
            end, slot = m.end(), slot + 1
    return [*out, text[end:]]


def _fold(pieces: list[Piece], values: dict[int, str]) -> list[Piece]:
    """Slots of known values as text."""
    return [(f'"{values[p[0]]}"' if p[1] else values[p[0]]) if not isinstance(p, str) and p[0] in values else p for p in pieces]


def _slots_of(value: Any) -> set[int]:
    if isinstance(value, SLOTS):
        return {value.slot}
    if isinstance(value, str):
        return marked(value)
    return {s for v in (value.values() if isinstance(value, dict) else value) for s in _slots_of(v)} if isinstance(value, (dict, list)) else set()


def _put(value: Any, held: dict[int, str]) -> Any:
    """A value with what its slots hold in one row."""
    if isinstance(value, SLOTS):
        return held[value.slot] if isinstance(value, TextSlot) else int(held[value.slot])
    if isinstance(value, dict):
        return {k: _put(v, held) for k, v in value.items()}
    return [_put(v, held) for v in value] if isinstance(value, list) else value


class Call:
    """A function of the user's, called with what the slots hold in each row. What it gives has a fixed part, and values that are slots in their turn."""

    def __init__(self, function: Callable[[Any], tuple[tuple, list]], body: Any, columns: dict[int, pa.Array], first: int):
        self.function, self.body, self.used = function, body, sorted(_slots_of(body))
        if any(s >= MOST for s in self.used) or any(marked(b) and not isinstance(b, SLOTS) for b in body if isinstance(b, str)):
            raise Undecided(s for s in self.used)
        self.fixed, values = function(_put(body, {s: columns[s][0].as_py() for s in self.used}))
        self.same = [None if type(v) is int or type(v) is str and _SIMPLE.fullmatch(v) else v for v in values]
        self.kinds = [type(v) for v in values]
        self.slots = [first + i for i in range(len(values))]
        if MARK.search(repr((self.fixed, self.same))):
            raise ValueError("marks in what a function gave")
        self.values = [s if s is not None or k is type(None) else TextSlot(chr(RAW + i)) if k is str else IntSlot(INTEGERS + i) for s, k, i in zip(self.same, self.kinds, self.slots)]

    def add(self, columns: dict[int, pa.Array], n: int) -> np.ndarray:
        """Puts the columns of its slots beside the others; which rows aren't like the first and have to be read one at a time."""
        memory: dict[tuple, list | None] = {}
        rows = []
        for held in zip(*(columns[s].to_pylist() for s in self.used)):
            if held not in memory:
                memory[held] = self._one(dict(zip(self.used, held)))
            rows.append(memory[held])
        for i, slot in enumerate(self.slots):
            columns[slot] = pa.array(["" if r is None else str(r[i]) for r in rows], pa.string())
        return np.array([r is None for r in rows], bool)

    def _one(self, held: dict[int, str]) -> list | None:
        try:
            fixed, values = self.function(_put(self.body, held))
            if repr(fixed) != repr(self.fixed) or [type(v) for v in values] != self.kinds:
                return None
            for value, same, kind in zip(values, self.same, self.kinds):
                if kind is str and same is None:
                    if not _SIMPLE.fullmatch(value) or MARK.search(value):
                        return None
                    value.encode()
                elif kind is not int and repr(value) != repr(same):
                    return None
            return values
        except Exception:  # whatever it is, the row raises it when it is read
            return None


class Shape:
    """A pattern of requests; ``line`` has marks, and is None where its rows have to be read one at a time."""

    def __init__(self, pieces: list[Piece]):
        self.pieces, self.line, self.calls = pieces, None, []
        self.slots = [p[0] for p in pieces if not isinstance(p, str)]
        self.pattern = r"\A" + "".join(_SPECIAL.sub(r"\\\1", p) if isinstance(p, str) else (_TEXT_FORM if p[1] else _INT_FORM) % p[0] for p in pieces) + r"\z"

    def match(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, pa.Array]]:
        """Which texts are of this shape, and what the slots of those hold."""
        if not self.slots:
            return np.asarray(pc.equal(texts, "".join(self.pieces))), {}
        found = pc.extract_regex(texts, self.pattern)
        hit = found.is_valid()
        return np.asarray(hit), dict(zip(self.slots, (found if found.null_count == 0 else found.filter(hit)).flatten()))

    def _called(self, function: Callable[[Any], tuple[tuple, list]], body: Any, columns: dict[int, pa.Array]) -> tuple[tuple, list]:
        if not _slots_of(body):
            return function(body)
        self.calls.append(Call(function, body, columns, MOST + sum(len(c.slots) for c in self.calls)))
        return self.calls[-1].fixed, self.calls[-1].values

    def _watched(self, options: Options, columns: dict[int, pa.Array]) -> Options:
        """The options with functions of the user's that slots are kept from."""

        def renderer(own: Callable[[Any], Any]) -> Callable[[Any], Any]:
            def given(body: list) -> tuple[tuple, list]:
                found = own(body[0])
                return ((), []) if found is None else ((found.label, found.name, *found.params), list(found.params.values()))

            def render(body: Any) -> Clause | None:
                fixed, values = self._called(given, [body], columns)
                return Clause(fixed[0], fixed[1], dict(zip(fixed[2:], values))) if fixed else None

            return render

        def redact(field: str, value: Any) -> Any:
            return self._called(lambda body: ((), [options.redactor(*body)]), [field, value], columns)[1][0]

        return replace(options, renderers={k: renderer(r) for k, r in options.renderers.items()}, redactor=options.redactor and redact)

    def probe(self, index: str | None, options: Options, with_rules: bool, columns: dict[int, pa.Array]) -> Line | None:
        """The line with marks; None if there is none; ``Undecided`` where it depends on slots."""
        text = "".join(p if isinstance(p, str) else f'"{chr(RAW + p[0])}"' if p[1] else str(INTEGERS + p[0]) for p in self.pieces)
        fixed = "".join(p for p in self.pieces if isinstance(p, str))
        if len(self.slots) > MOST or MARK.search(fixed + (index or "")) or _FOREIGN.search(fixed) or brackets(text) > MANY:
            return None
        seen: list[int] = []
        try:
            value = _slotted(decode(text), seen)
            if sorted(seen) != sorted(self.slots):
                return None
            state.probing = True
            line = _describe(value, index, self._watched(options, columns), with_rules)
        except Undecided as e:
            raise Undecided(self._roots(e.slots)) from e
        except Exception:  # whatever it is, the rows raise it when they are read
            return None
        finally:
            state.probing = False
        if found := marked(f"{line.idx} {line.notes} {line.rules}"):
            raise Undecided(self._roots(found))
        return line

    def _roots(self, slots: set[int]) -> set[int]:
        """Slots of the requests that these come from."""
        return {r for s in slots for r in next((c.used for c in self.calls if s in c.slots), [s])}


def _slotted(value: Any, seen: list[int]) -> Any:
    if isinstance(value, dict):
        return {k: _slotted(v, seen) for k, v in value.items()}
    if isinstance(value, list):
        return [_slotted(v, seen) for v in value]
    if isinstance(value, str) and len(value) == 1 and RAW <= ord(value) < SHOWN:
        seen.append(ord(value) - RAW)
        return TextSlot(value)
    if type(value) is int and INTEGERS <= value < INTEGERS + MOST:
        seen.append(value - INTEGERS)
        return IntSlot(value)
    return value


def _filled(line: str, columns: dict[int, pa.Array], n: int) -> pa.Array:
    """A line with marks for each row."""
    parts: list = []
    end = 0
    for m in MARK.finditer(line):
        code = ord(m[0])
        column = columns[code - (SHOWN if code >= SHOWN else RAW)]
        if code >= SHOWN:
            column = pc.if_else(pc.match_substring_regex(column, _QUOTED), pc.binary_join_element_wise('"', column, '"', ""), column)
        parts += [line[end : m.start()], column]
        end = m.end()
    if not parts:
        return pa.repeat(pa.scalar(line, pa.string()), n)
    return pc.binary_join_element_wise(*parts, line[end:], "")


class Shapes:
    """The shapes that were met, by index, the last first."""

    def __init__(self, options: Options, with_rules: bool, fields: list[pa.Field]):
        self.options, self.with_rules, self.fields = options, with_rules, fields
        self.met: dict[str | None, list[Shape]] = {}
        self.last: tuple[str | None, pa.Array, pa.StructArray] | None = None  # index, requests and lines of a batch of few

    def read(self, texts: pa.Array, index: str | None) -> tuple[list[tuple[np.ndarray, pa.StructArray]], np.ndarray]:
        """Places and lines of rows that are read by shape, and the places of the others."""
        at = np.arange(len(texts))
        out: list[tuple[np.ndarray, pa.StructArray]] = []
        if len(at) < LEAST:
            return out, at
        if len(self.met) > TRIED and index not in self.met:
            self.met.clear()
        known, single = list(self.met.setdefault(index, [])), []
        self.probed = 0
        if texts.null_count:
            single.append(at[np.asarray(texts.is_null())])
            at, texts = at[np.asarray(texts.is_valid())], texts.drop_null()
        for tried in range(len(known) + TRIED):
            if len(at) < LEAST:
                break
            new = tried >= len(known)
            shape = Shape(_pieces(texts[0].as_py())) if new else known[tried]
            hit, columns = shape.match(texts)
            if new and not hit[0]:
                hit = np.arange(len(at)) == 0
                single.append(at[hit])
            elif hit.any():
                self._use(shape, at[hit], columns, index, out, single, new)
            at, texts = at[~hit], texts.filter(pa.array(~hit)) if hit.any() else texts
        return out, np.concatenate([at, *single])

    def _use(self, shape: Shape, at: np.ndarray, columns: dict[int, pa.Array], index: str | None, out: list, single: list, new: bool) -> None:
        if new:
            self.probed += 1
            if len(at) < LEAST or self.probed > PROBED:
                single.append(at)
                return
            try:
                shape.line = shape.probe(index, self.options, self.with_rules, columns)
            except Undecided as e:
                values = {s: columns[s].dictionary_encode() for s in e.slots}
                slot = min(values, key=lambda s: len(values[s].dictionary))
                by = values[slot]
                if len(by.dictionary) <= PARTS:
                    for code, value in enumerate(by.dictionary.to_pylist()):
                        mine = np.asarray(by.indices) == code
                        part = {s: c.filter(pa.array(mine)) if len(by.dictionary) > 1 else c for s, c in columns.items() if s != slot}
                        self._use(Shape(_fold(shape.pieces, {slot: value})), at[mine], part, index, out, single, True)
                    return
            known = self.met[index]
            known.insert(0, shape)
            del known[TRIED:]
        if shape.line is None:
            single.append(at)
            return
        other = np.zeros(len(at), bool)
        for call in shape.calls:
            other |= call.add(columns, len(at))
        lines = self._lines(shape.line, columns, len(at))
        if other.any():
            single.append(at[other])
            at, lines = at[~other], lines.filter(pa.array(~other))
        out.append((at, lines))

    def _lines(self, line: Line, columns: dict[int, pa.Array], n: int) -> pa.StructArray:
        same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(n, np.int64)))
        kinds = [f.type for f in self.fields]
        sig = _filled(line.sig, columns, n)
        arrays = [same(line.idx, kinds[0]), _filled(line.q, columns, n), sig, sig if line.full == line.sig else _filled(line.full, columns, n), same(line.notes or None, kinds[4]), pa.nulls(n, kinds[5])]
        return pa.StructArray.from_arrays([*arrays, *([same(line.rules, kinds[6])] if self.with_rules else [])], fields=self.fields)
