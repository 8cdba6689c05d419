"""The ranking as text and as JSON, on the driver: what it takes is the ranked top alone."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from .rank import Summary


def thousands(value: float) -> str:
    """Rounded half away from zero, with commas."""
    return f"{int(Decimal(repr(float(value))).quantize(Decimal(1), ROUND_HALF_UP)):,}"


def plural(n: int, noun: str) -> str:
    return f"{n:,} {noun}{'' if n == 1 else 's'}"


def heading(s: Summary) -> str:
    line = f"{plural(s.lines, 'line')}, {plural(s.records, 'record')}, {plural(s.shapes, 'shape')}, {thousands(s.total_ms)} ms total"
    notes = [f"{plural(s.other_phase, 'record')} from another phase, see --phase"] if s.other_phase else []
    notes += [f"{s.failed:,} unreadable, reported above"] if s.failed else []
    return line + (f" ({'; '.join(notes)})" if notes else "") + "\n\n"


def table(rows: Sequence[Mapping[str, Any]], sort: str = "total") -> str:
    """Counts and times to the right, a star on what they are sorted by; the signature on a line of its own."""
    names = {"count": "count", "total ms": "total", "mean": "mean", "p95": "p95", "max": "max"}
    head = [n + "*" * (k == sort) for n, k in names.items()]
    cell = lambda v: "-" if v is None else thousands(v)
    cells = [[thousands(r["count"]), *(cell(r[k] if r["measured"] else None) for k in ("total_ms", "mean_ms", "p95_ms", "max_ms"))] for r in rows]
    wide = [max(map(len, column)) for column in zip(head, *cells)]
    line = lambda row: "  " + "  ".join(x.rjust(w) for x, w in zip(row, wide)) + "  "
    out = [line(head) + "shape"]
    for row, r in zip(cells, rows):
        out += [line(row) + r["hash"], " " * (2 + sum(wide) + 2 * len(wide)) + r["sig"]]
    return "\n".join(out) + "\n"


def footer(shapes: int, shown: int) -> str:
    hidden = shapes - shown
    return f"\n{hidden:,} more {'shape' if hidden == 1 else 'shapes'} (--top none for all)\n" if hidden > 0 else ""


def as_json(rows: Sequence[Mapping[str, Any]]) -> str:
    """Times rounded to three places."""
    short = lambda v: None if v is None else float(Decimal(repr(float(v))).quantize(Decimal("0.001"), ROUND_HALF_UP))
    out = []
    for r in rows:
        times = {k: short(r[k]) for k in ("total_ms", "mean_ms", "p95_ms", "max_ms")}
        out.append({"hash": r["hash"], "sig": r["sig"], "idx": r["idx"], "count": r["count"], "measured": r["measured"], **times, "first": r["first"], "last": r["last"], "slowest": {"took_ms": short(r["max_ms"]), "text": r["slowest"]}})
    return json.dumps(out, ensure_ascii=False, indent=4)
