"""Searches in captured HTTP traffic: ``_search`` and ``_msearch`` requests with their cost."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import digest_names
from ..functions.jsoncompat import TRIM, Undecodable, composite, decode, get, text, texts

SEARCH = "array<struct<index:string,body:string,position:int>>"
_SEARCH = pa.struct([("index", pa.string()), ("body", pa.string()), ("position", pa.int32())])
#: Bytes of a response that are looked at for the time it took.
PEEK = 64
Found = tuple[str | None, str, int | None]


def _target(path: str, base: str) -> tuple[str, str | None] | None:
    """Endpoint and index of a path below the base path."""
    for mark in "?#":
        path = path.split(mark, 1)[0]
    path, base = path.strip("/"), base.strip("/")
    if base:
        if path != base and not path.startswith(base + "/"):
            return None
        path = path[len(base) + 1 :]
    parts = [unquote(p) for p in path.split("/") if p]
    if not parts or parts[-1] not in ("_search", "_msearch") or len(parts) > 2:
        return None
    return parts[-1], parts[0] if len(parts) == 2 else None


def _header_index(header: str, otherwise: str | None) -> str | None:
    try:
        found = decode(header)
    except Undecodable:
        return otherwise
    index = get(found, "index") if composite(found) else None
    return ",".join(n for n in (texts(index) if composite(index) else [text(index)]) if n) or otherwise


def extract(method: str | None, path: str | None, body: str | None, base: str = "") -> list[Found]:
    """(index, body, position) of each search; a single one has no position."""
    if not body or (method or "").upper() not in ("GET", "POST") or (target := _target(path or "", base)) is None:
        return []
    endpoint, index = target
    if endpoint == "_search":
        return [(index, body, None)]
    lines = [x for x in (line.strip(TRIM) for line in body.split("\n")) if x]
    return [(_header_index(head, index), query, i) for i, (head, query) in enumerate(zip(lines[::2], lines[1::2]))]


def searches(method: str | Column, path: str | Column, body: str | Column, base: str = "") -> Column:
    """The searches of an exchange, as an array."""

    @F.arrow_udf(SEARCH)
    def find(methods: pa.Array, paths: pa.Array, bodies: pa.Array) -> pa.Array:
        rows = [[{"index": i, "body": b, "position": p} for i, b, p in extract(*x, base)] for x in zip(methods.to_pylist(), paths.to_pylist(), bodies.to_pylist())]
        return pa.array(rows, pa.list_(_SEARCH))

    return find(*(F.col(c) if isinstance(c, str) else c for c in (method, path, body)))


def observed(exchanges: DataFrame, base: str = "", method: str = "method", path: str = "path", body: str = "request_body", response: str = "response_head") -> DataFrame:
    """A row a search: the exchange's columns, with (in place of columns of those names) index, body, position and took (ms; of single searches alone).

    ``took`` is read from the first bytes of the response, which isn't decoded. A failed exchange has null status and took.
    """
    head = F.regexp_extract(F.substring(F.col(response), 1, PEEK), r'^\s*[{]\s*"took"\s*:\s*([0-9]+)', 1)
    s = digest_names(exchanges, "search")["search"]
    found = exchanges.withColumn(s, F.explode(searches(method, path, body, base)))
    took = F.when(F.col(f"{s}.position").isNull() & (head != ""), head.cast("long"))
    kept = [c for c in exchanges.columns if c.lower() not in ("index", "body", "position", "took") and c not in (body, response)]
    return found.select(*kept, f"{s}.index", f"{s}.body", f"{s}.position", took.alias("took"))
