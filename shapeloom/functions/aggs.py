"""Aggregations: what is said of each, and their order."""

from __future__ import annotations

from typing import Any

from .jsoncompat import cast, composite, get, integer, items, scalar, texts
from .rules import Log
from .slots import state, sure

_RESERVED = ("aggs", "aggregations", "meta")
#: Types of which the field isn't said.
_BARE = {"filter", "filters", "nested", "reverse_nested", "composite", "top_hits"}


class Agg:
    __slots__ = ("name", "kind", "args", "kids", "key")

    def __init__(self, name: str, kind: str, field: str | None, params: list[str], kids: list[Agg]):
        self.name, self.kind, self.kids = name, kind, kids
        self.args = ([] if field is None else [field]) + params
        self.key = f"{kind}({'' if field is None else field};{','.join(params)})"

    def settle(self) -> None:
        if self.kids:
            self.key += f">[{','.join(k.key for k in self.kids)}]"


def _trimmed(value: str) -> str:
    return value.rstrip("0").rstrip(".") if "." in value else value


def _described(kind: str, body: Any) -> tuple[str, str | None, list[str]]:
    field = get(body, "field")
    field = field if isinstance(field, str) else None
    if kind in _BARE:
        return kind, None, []
    if kind in ("terms", "significant_terms", "rare_terms"):
        size = integer(get(body, "size"))
        return kind, field, [] if size is None else [str(size)]
    if kind == "date_histogram":
        return kind, field, [x for x in (get(body, k) for k in ("calendar_interval", "fixed_interval", "interval")) if isinstance(x, str)][:1]
    if kind == "histogram":
        step = get(body, "interval")
        return kind, field, [cast(step)] if scalar(step) else []
    if kind == "percentiles" and composite(wanted := get(body, "percents")) and wanted:
        each = [_trimmed(x) for x in texts(wanted)]
        return (f"p{each[0]}", field, []) if len(each) == 1 else (kind, field, [f"[{','.join(each)}]"])
    return kind, field, []


def read(value: Any, log: Log) -> list[Agg]:
    """The aggregations of a section, in canonical order with theirs below."""
    out = _unordered(value)
    return settled(out, log)


def _unordered(value: Any) -> list[Agg]:
    out: list[Agg] = []
    for name, definition in items(value) if composite(value) else ():
        kind = next((k for k, _ in items(definition) if k not in _RESERVED), None) if composite(definition) else None
        if kind is None:
            continue
        body = next(v for k, v in items(definition) if k == kind)
        below = [a for slot in ("aggs", "aggregations") for a in _unordered(get(definition, slot))]
        out.append(Agg(name, *_described(kind, body if composite(body) else []), below))
    return out


def settled(aggs: list[Agg], log: Log) -> list[Agg]:
    for a in aggs:
        a.kids = settled(a.kids, log)
        a.settle()
    if state.probing:
        sure(sorted(a.key for a in aggs))
    in_order = sorted(aggs, key=lambda a: a.key)
    if [a.key for a in in_order] != [a.key for a in aggs]:
        log.add("reorder", "aggs")
    return in_order


def rendered(aggs: list[Agg], names: bool) -> str:
    return ", ".join(_one(a, names) for a in aggs)


def _one(a: Agg, names: bool) -> str:
    own = f"{a.name + ':' if names else ''}{a.kind}({','.join(a.args)})"
    if not a.kids:
        return own
    below = rendered(a.kids, names)
    return f"{own}>{below}" if len(a.kids) == 1 else f"{own}>{{{below}}}"


