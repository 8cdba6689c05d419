"""JSON as the fingerprint's contract reads it, and the string forms and orders that follow from it.

An empty object is an empty list, an object with the keys "0" to "n-1" in order is a list; key order is kept. Integers beyond
64 bits are floats. Nesting beyond 512 and lone surrogates aren't decodable.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cmp_to_key
from typing import Any

from . import slots

DEPTH = 512
TRIM = " \t\n\r\0\x0b"
_NUMERIC = re.compile(r"[ \t\n\r\v\f]*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\n\r\v\f]*\Z")


class Undecodable(ValueError):
    """Not JSON, or JSON that is neither object nor list."""


def _object(pairs: list[tuple[str, Any]]) -> dict | list:
    if not pairs:
        return []
    found = dict(pairs)
    if "0" in found and all(k == str(i) for i, k in enumerate(found)):
        return list(found.values())
    return found


def _integer(text: str) -> int | float:
    if len(text) < 19:
        return -0.0 if text == "-0" else int(text)
    value = int(text) if len(text) < 4000 else math.copysign(math.inf, -1 if text[0] == "-" else 1)
    return value if -(1 << 63) <= value < 1 << 63 else float(text)


def _constant(name: str) -> Any:
    raise ValueError(name)


_decoder = json.JSONDecoder(object_pairs_hook=_object, parse_int=_integer, parse_constant=_constant)
#: Brackets of a text from which on more levels than usual may be needed.
MANY = 150


@contextmanager
def deep(levels: int = 20_000) -> Iterator[None]:
    """Recursion to so many levels within the block, and the limit that there was after it."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, levels))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def brackets(text: str) -> int:
    return text.count("{") + text.count("[")


def _too_deep(value: Any) -> bool:
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEPTH:
            return True
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, (dict, list))]
    return False


def decode(text: str) -> Any:
    """The value of a JSON text; ``Undecodable`` if it has none."""
    many = brackets(text)
    try:
        if many > MANY:
            with deep():
                value = _decoder.decode(text.strip(" \t\n\r"))
        else:
            value = _decoder.decode(text.strip(" \t\n\r"))
    except (ValueError, RecursionError) as e:
        raise Undecodable("not JSON") from e
    if isinstance(value, (dict, list)) and many > DEPTH and _too_deep(value):
        raise Undecodable("nested too deeply")
    if "\\ud" in text or "\\uD" in text:
        try:
            json.dumps(value, ensure_ascii=False).encode()
        except UnicodeEncodeError as e:
            raise Undecodable("a lone surrogate") from e
    return value


def composite(value: Any) -> bool:
    return isinstance(value, (dict, list))


def items(value: dict | list) -> Iterator[tuple[str, Any]]:
    """Keys and values; a list has its places as keys."""
    return iter(value.items()) if isinstance(value, dict) else ((str(i), x) for i, x in enumerate(value))


def get(value: dict | list, key: str, default: Any = None) -> Any:
    return value.get(key, default) if isinstance(value, dict) else default


def has(value: dict | list, key: str) -> bool:
    return isinstance(value, dict) and key in value


def clauses(value: Any) -> list[dict | list]:
    """One clause or several as a list; what is no object or empty is left out."""
    if isinstance(value, dict):
        return [value]
    return [x for x in value if composite(x) and x] if isinstance(value, list) else []


def number(value: float) -> str:
    """A float with 14 significant digits: 1, 0.1, 1.0E+25, 1.0E-5."""
    if math.isinf(value) or math.isnan(value):
        return "NAN" if math.isnan(value) else "INF" if value > 0 else "-INF"
    text = "%.14G" % value
    if "E" not in text:
        return text
    mantissa, power = text.split("E")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{power[0]}{int(power[1:])}"


def scalar(value: Any) -> bool:
    return isinstance(value, (str, int, float))


def cast(value: Any) -> str:
    """A scalar as a string; true is 1 and false is empty."""
    if isinstance(value, bool):
        return "1" if value else ""
    return number(value) if isinstance(value, float) else str(value)


def text(value: Any) -> str:
    """Any value as a string: booleans by name, null and composites empty."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return cast(value) if scalar(value) else ""


def texts(value: Any) -> list[str]:
    return [text(x) for _, x in items(value)] if composite(value) else []


def integer(value: Any) -> int | None:
    """An int, or the int of a string of digits alone; nothing else."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(value, str) and value.isascii() and value.isdigit():
        return min(int(value), (1 << 63) - 1) if len(value) < 4000 else (1 << 63) - 1
    return None


def numeric(value: str) -> bool:
    return _NUMERIC.match(value) is not None


def _compare(a: str, b: str) -> int:
    if numeric(a) and numeric(b):
        x, y = float(a), float(b)
        return (x > y) - (x < y)
    return (a > b) - (a < b)


def ordered(values: Iterable[str]) -> list[str]:
    """Strings in order, those that are numbers compared as such."""
    values = list(values)
    if len(values) < 2:
        return values
    if slots.state.probing and slots.sure_strings(values):
        return sorted(map(str, values))
    if any(v and (v[0] in "+-. \t\n\r\v\f" or "0" <= v[0] <= "9") for v in values):
        return sorted(values, key=cmp_to_key(_compare))
    return sorted(values)


def _encoded(value: Any) -> str:
    if isinstance(value, slots.SLOTS):
        raise slots.Undecided([value.slot])
    if isinstance(value, dict):
        return "{" + ",".join(f"{_encoded(k)}:{_encoded(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_encoded, value)) + "]"
    if isinstance(value, float):
        short = repr(value)
        if "e" in short:
            mantissa, power = short.split("e")
            return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{power[0] if power[0] in '+-' else '+'}{int(power.lstrip('+-'))}"
        return short[:-2] if short.endswith(".0") else short
    return json.dumps(value).replace("/", "\\/")


def encode(value: Any) -> str:
    """Compact JSON with escaped slashes and non-ASCII characters."""
    return _encoded(value)


def digest_of(value: Any) -> str:
    return hashlib.md5(encode(value).encode(), usedforsecurity=False).hexdigest()
