"""The logical form of a query: nodes, the reading of clauses into nodes, and the canonical form of a tree."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Mapping
from typing import Any

from .jsoncompat import Undecodable, cast, clauses, composite, decode, digest_of, get, has, integer, items, ordered, scalar, text, texts
from .rules import Log
from .slots import state, sure

AND, OR, NOT, NESTED, JOIN, ALL, NONE, OPAQUE, LEAF = range(9)


class Node:
    """``name``: field, path, relation or type; ``op``: a leaf's or join's kind; ``values``: a leaf's (key or None, value).

    ``need``: how many clauses of an OR have to match, where that isn't one. ``key`` orders siblings and tells equal ones.
    """

    __slots__ = ("kind", "name", "op", "values", "kids", "need", "_key")

    def __init__(self, kind: int, name: str = "", op: str = "", values: list | None = None, kids: list[Node] | None = None, need: int | None = None):
        self.kind, self.name, self.op, self.values, self.kids, self.need, self._key = kind, name, op, values or [], kids or [], need, None

    @property
    def key(self) -> str:
        if self._key is None:
            self._key = _KEYS[self.kind](self)
        return self._key


def _leaf_key(node: Node) -> str:
    flat = [f"{k}={_value_key(v)}" if k is not None else _value_key(v) for k, v in node.values]
    return f"{node.name}:{node.op}:{','.join(flat if node.op == 'range' else ordered(flat))}"


def _value_key(value: Any) -> str:
    if isinstance(value, str):
        return value
    return "null" if value is None else text(value) if scalar(value) else digest_of(value)


_KEYS: dict[int, Callable[[Node], str]] = {
    AND: lambda n: f"and({'&'.join(k.key for k in n.kids)})",
    OR: lambda n: f"or{'' if n.need is None else f'~{n.need}'}({'|'.join(k.key for k in n.kids)})",
    NOT: lambda n: f"not({n.kids[0].key})",
    NESTED: lambda n: f"nested:{n.name}({n.kids[0].key})",
    JOIN: lambda n: f"{n.op}:{n.name}({n.kids[0].key})",
    ALL: lambda n: "all",
    NONE: lambda n: "none",
    OPAQUE: lambda n: f"opaque:{n.name}",
    LEAF: _leaf_key,
}


def leaf(name: str, op: str, *values: Any) -> Node:
    return Node(LEAF, name, op, [(None, v) for v in values])


def opaque(name: str) -> Node:
    return Node(OPAQUE, name)


_GEO = {"distance", "distance_type", "type", "validation_method", "ignore_unmapped", "_name"}
_BASE64 = re.compile(r"([A-Za-z0-9+/]*)(={0,2})\Z")
#: Clause types that hold one field with one value: the operation that each is read as.
_SINGLE = {
    "term": "term", "match": "match", "match_bool_prefix": "match", "fuzzy": "match", "common": "match", "match_phrase": "phrase",
    "match_phrase_prefix": "phrase", "prefix": "prefix", "wildcard": "wildcard", "regexp": "regexp",
}


class Reader:
    """Reads one clause after another; ``notes`` has what isn't rendered, in order of first sight."""

    def __init__(self, log: Log, renderers: Mapping[str, Callable[[dict], Any]] | None = None):
        self.log, self.renderers, self.notes = log, renderers or {}, {}

    def note(self, note: str) -> None:
        self.notes[note] = None

    def clause(self, clause: dict | list) -> Node:
        for kind, body in items(clause):
            body = body if composite(body) else []
            if kind in _SINGLE:
                return self._single(body, _SINGLE[kind])
            read = _READ.get(kind)
            return read(self, body, kind) if read else self._extension(body, kind)
        return Node(ALL)

    def _fields(self, body: dict | list):
        """Fields and specifications without boosts."""
        for name, spec in items(body):
            if name == "boost":
                self.log.add("boost_dropped")
            else:
                yield name, spec

    def _inner(self, body: dict | list, slot: str) -> Node:
        inner = get(body, slot)
        return self.clause(inner) if composite(inner) else Node(ALL)

    def _bool(self, body: dict | list, kind: str) -> Node:
        must, filters = ([self.clause(c) for c in clauses(get(body, slot))] for slot in ("must", "filter"))
        if must and filters:
            self.log.add("must_filter_merged")
        every = [*must, *filters, *(Node(NOT, kids=[self.clause(c)]) for c in clauses(get(body, "must_not")))]
        should = [self.clause(c) for c in clauses(get(body, "should"))]
        raw = get(body, "minimum_should_match")
        if should and every and raw is None:
            self.note(f"should={len(should)}")
            self.log.add("should_boost_only", f"{len(should)} clause{'' if len(should) == 1 else 's'}")
        elif should:
            need = integer(raw)
            if raw is not None and need is None:
                self.note(f"msm={cast(raw) if scalar(raw) else '?'}")
            every.append(Node(OR, kids=should, need=need if need is not None and need > 1 else None))
        if not every:
            return Node(ALL)
        if len(every) == 1:
            self.log.add("unwrap", "bool")
            return every[0]
        return Node(AND, kids=every)

    def _single(self, body: dict | list, op: str) -> Node:
        for name, value in self._fields(body):
            if composite(value):
                if has(value, "boost"):
                    self.log.add("boost_dropped", name)
                value = get(value, "value") if has(value, "value") else get(value, "query")
            return leaf(name, op, value)
        return opaque(op)

    def _terms(self, body: dict | list, kind: str) -> Node:
        for name, value in self._fields(body):
            if name == "minimum_should_match_field":
                continue
            if isinstance(value, dict):
                self.note("terms_lookup")
                self.log.add("terms_lookup", name)
                return leaf(name, "raw", "<terms-lookup>")
            return leaf(name, "terms", *(value if isinstance(value, list) else [value]))
        return opaque("terms")

    def _exists(self, body: dict | list, kind: str) -> Node:
        name = get(body, "field")
        return leaf(name, "exists") if isinstance(name, str) else opaque("exists")

    def _ids(self, body: dict | list, kind: str) -> Node:
        values = get(body, "values")
        return leaf("_id", "terms", *((v for _, v in items(values)) if composite(values) else ()))

    def _range(self, body: dict | list, kind: str) -> Node:
        for name, spec in self._fields(body):
            if not composite(spec):
                continue
            bounds = [(b, get(spec, b)) for b in ("gte", "gt", "lte", "lt") if has(spec, b)]
            if not bounds:
                for end, side, open_, shut in (("from", "include_lower", "gt", "gte"), ("to", "include_upper", "lt", "lte")):
                    if get(spec, end) is not None:
                        bounds.append((open_ if get(spec, side) is False else shut, get(spec, end)))
                if bounds:
                    self.log.add("range_legacy_bounds")
            if bounds:
                return Node(LEAF, name, "range", bounds)
            if any(has(spec, k) for k in ("from", "to", "include_lower", "include_upper", "format", "time_zone", "relation")):
                self.log.add("range_unbounded")
                return leaf(name, "exists")
        return opaque("range")

    @staticmethod
    def _joined(body: dict | list, none: str) -> str:
        names = get(body, "fields")
        return "|".join(texts(names)) if composite(names) and names else none

    def _multi(self, body: dict | list, kind: str) -> Node:
        return leaf(self._joined(body, "*"), "match", get(body, "query"))

    def _query_string(self, body: dict | list, kind: str) -> Node:
        payload = get(body, "query")
        return leaf(self._joined(body, ""), "raw", payload) if isinstance(payload, str) else opaque(kind)

    def _nested(self, body: dict | list, kind: str) -> Node:
        path, inner = get(body, "path"), get(body, "query")
        if not isinstance(path, str) or not composite(inner):
            return opaque("nested")
        return Node(NESTED, path, kids=[self.clause(inner)])

    def _join(self, body: dict | list, kind: str) -> Node:
        relation, inner = get(body, "type" if kind == "has_child" else "parent_type"), get(body, "query")
        if not isinstance(relation, str) or not composite(inner):
            return opaque(kind)
        return Node(JOIN, relation, kind, kids=[self.clause(inner)])

    def _vector(self, body: dict | list, kind: str) -> Node:
        for name, spec in self._fields(body):
            if not composite(spec):
                continue
            values = [("query", get(spec, k)) for k in ("query_text", "query_image") if has(spec, k)][:1]
            values += [(k, get(spec, k)) for k in ("k", "min_score", "max_distance") if has(spec, k)]
            found = Node(LEAF, name, kind, values)
            limit = get(spec, "filter")
            return Node(AND, kids=[found, self.clause(limit)]) if composite(limit) and limit else found
        return opaque(kind)

    def _geo(self, body: dict | list, kind: str) -> Node:
        for name, _ in self._fields(body):
            if name not in _GEO:
                if kind == "geo_distance":
                    return leaf(name, kind, get(body, "distance"))
                return leaf(name, "geo_bbox" if kind == "geo_bounding_box" else kind)
        return opaque(kind)

    def _shape(self, body: dict | list, kind: str) -> Node:
        for name, spec in self._fields(body):
            if name in ("ignore_unmapped", "_name") or not composite(spec):
                continue
            if composite(geometry := get(spec, "shape")):
                form = get(geometry, "type")
                form = _lower(form) if isinstance(form, str) else "?"
            elif composite(get(spec, "indexed_shape")):
                self.note("indexed_shape")
                self.log.add("indexed_shape", name)
                form = "indexed"
            else:
                continue
            relation = get(spec, "relation")
            return leaf(name, kind, form, _lower(relation) if isinstance(relation, str) else "intersects")
        return opaque(kind)

    def _script(self, body: dict | list, kind: str) -> Node:
        script = get(body, "script")
        if composite(script):
            source = get(script, "source")
            script = source if isinstance(source, str) else get(script, "id")
        return leaf("", "script", script) if isinstance(script, str) else opaque("script")

    def _parent_id(self, body: dict | list, kind: str) -> Node:
        relation, value = get(body, "type"), get(body, "id")
        return leaf(relation, kind, value) if isinstance(relation, str) and scalar(value) else opaque(kind)

    def _like(self, body: dict | list, kind: str) -> Node:
        like = get(body, "like")
        entries = like if isinstance(like, list) else [like]
        values = [x if isinstance(x, str) else "<doc>" for x in entries if isinstance(x, str) or composite(x)]
        return leaf(self._joined(body, "*"), "like", *values) if values else opaque(kind)

    def _constant(self, body: dict | list, kind: str) -> Node:
        inner = get(body, "filter")
        if not composite(inner):
            return opaque(kind)
        self.log.add("constant_score_unwrapped")
        return self.clause(inner)

    def _rescored(self, body: dict | list, kind: str) -> Node:
        self.note("script_score:min_score" if kind == "script_score" and has(body, "min_score") else kind)
        self.log.add(f"{kind}_unwrapped")
        return self._inner(body, "positive" if kind == "boosting" else "query")

    def _union(self, body: dict | list, kind: str) -> Node:
        kids = [self.clause(c) for c in clauses(get(body, "queries"))]
        return Node(OR, kids=kids) if kids else Node(ALL)

    def _percolate(self, body: dict | list, kind: str) -> Node:
        name = get(body, "field")
        if not isinstance(name, str):
            return opaque(kind)
        if not has(body, "id"):
            return leaf(name, kind)
        self.note("percolate_lookup")
        self.log.add("percolate_lookup", name)
        return leaf(name, kind, "indexed")

    def _feature(self, body: dict | list, kind: str) -> Node:
        name = get(body, "field")
        if not isinstance(name, str):
            return opaque(kind)
        return Node(LEAF, name, kind, [("pivot", get(body, "pivot"))] if kind == "distance_feature" and has(body, "pivot") else [])

    def _intervals(self, body: dict | list, kind: str) -> Node:
        return next((leaf(name, kind) for name, _ in self._fields(body) if name != "_name"), None) or opaque(kind)

    def _wrapper(self, body: dict | list, kind: str) -> Node:
        inner = _unwrapped(get(body, "query"))
        if inner is None:
            return opaque(kind)
        self.log.add("wrapper_decoded")
        return self.clause(inner)

    def _extension(self, body: dict | list, kind: str) -> Node:
        found = self.renderers[kind](body) if kind in self.renderers else None
        if found is None:
            return opaque(kind)
        self.log.add("extension_rendered", kind)
        return Node(LEAF, found.name, "extension", [(None, found.label), *found.params.items()])


def _lower(value: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in value)


def _unwrapped(encoded: Any) -> dict | list | None:
    """The JSON in a base64 string: white space and missing padding are allowed, anything else foreign isn't."""
    if not isinstance(encoded, str):
        return None
    found = _BASE64.match(re.sub(r"[ \t\r\n]", "", encoded))
    if found is None:
        return None
    body, pad = found.groups()
    if len(body) % 4 == 1 or pad and (len(body) + len(pad)) % 4:
        return None
    try:
        inner = decode(base64.b64decode(body + "=" * (-len(body) % 4)).decode())
    except (ValueError, Undecodable):
        return None
    return inner if composite(inner) else None


_READ: dict[str, Callable[[Reader, Any, str], Node]] = {
    "match_all": lambda r, b, k: Node(ALL), "match_none": lambda r, b, k: Node(NONE), "bool": Reader._bool, "terms": Reader._terms, "terms_set": Reader._terms,
    "exists": Reader._exists, "ids": Reader._ids, "range": Reader._range, "multi_match": Reader._multi, "combined_fields": Reader._multi,
    "query_string": Reader._query_string, "simple_query_string": Reader._query_string, "nested": Reader._nested, "has_child": Reader._join, "has_parent": Reader._join,
    "knn": Reader._vector, "neural": Reader._vector, "geo_distance": Reader._geo, "geo_bounding_box": Reader._geo, "geo_polygon": Reader._geo,
    "geo_shape": Reader._shape, "xy_shape": Reader._shape, "script": Reader._script, "parent_id": Reader._parent_id, "more_like_this": Reader._like,
    "constant_score": Reader._constant, "function_score": Reader._rescored, "script_score": Reader._rescored, "boosting": Reader._rescored,
    "dis_max": Reader._union, "hybrid": Reader._union, "percolate": Reader._percolate, "rank_feature": Reader._feature, "distance_feature": Reader._feature,
    "intervals": Reader._intervals, "wrapper": Reader._wrapper,
}
#: All clause types that are read; any other is opaque.
NATIVE = sorted([*_SINGLE, *_READ])


def _flat(kids: list[Node], kind: int, need: int | None, log: Log) -> list[Node]:
    """Connectors of the same kind merged into this one; an OR that needs several clauses neither merges nor is merged."""
    out: list[Node] = []
    for kid in kids:
        if kid.kind == kind and need is None and kid.need is None:
            out += kid.kids
            log.add("flatten", _NAME[kind])
        else:
            out.append(kid)
    return out


def _distinct(kids: list[Node], kind: int, log: Log) -> list[Node]:
    seen: dict[str, Node] = {}
    for kid in kids:
        if seen.setdefault(kid.key, kid) is not kid:
            log.add("dedupe", _NAME[kind])
    return list(seen.values())


_NAME = {AND: "and", OR: "or"}


def canonical(node: Node, log: Log) -> Node:
    """The same query with connectors merged, cleared of what decides nothing, without repeats and in a stable order."""
    if not node.kids:
        return node
    kids = [canonical(k, log) for k in node.kids]
    kind, need = node.kind, node.need
    if kind not in _NAME:
        return Node(kind, node.name, node.op, kids=kids)
    kids = _flat(kids, kind, need, log)
    some = [k for k in kids if k.kind != NONE]
    if len(some) < len(kids) and need is None:
        log.add("absorb_match_none", _NAME[kind])
        if kind == AND or not some:
            return Node(NONE)
        kids = some
    if kind == AND and len(kids) > 1:
        limiting = [k for k in kids if k.kind != ALL]
        if len(limiting) < len(kids):
            log.add("drop_match_all")
        kids = limiting
    if state.probing:
        sure(sorted(k.key for k in kids))
    if need is None:
        kids = _distinct(kids, kind, log)
    in_order = sorted(kids, key=lambda k: k.key)
    if [k.key for k in in_order] != [k.key for k in kids]:
        log.add("reorder", _NAME[kind])
    if not in_order:
        log.add("empty_to_match_all", _NAME[kind])
        return Node(ALL)
    if len(in_order) == 1 and need is None:
        if len(node.kids) > 1:
            log.add("unwrap", _NAME[kind])
        return in_order[0]
    return Node(kind, kids=in_order, need=need)
