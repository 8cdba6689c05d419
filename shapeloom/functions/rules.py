"""The rules of normalisation, and the record of those that applied."""

from __future__ import annotations

from .jsoncompat import ordered

WHY = {
    "absorb_match_none": "match_none decides an AND and adds nothing to an OR.",
    "boost_dropped": "Boosts change the ranking of hits only.",
    "boosting_unwrapped": "Of boosting the positive clause alone selects documents.",
    "constant_score_unwrapped": "constant_score selects what its filter selects.",
    "dedupe": "The same clause stood twice among siblings.",
    "drop_match_all": "match_all limits nothing beside other clauses.",
    "empty_to_match_all": "No clause was left, so everything matches.",
    "extension_rendered": "A registered renderer read this clause; the fingerprint depends on it.",
    "flatten": "A connector inside one of its own kind was merged with it.",
    "function_score_unwrapped": "function_score selects what its query selects.",
    "index_pattern": "Dates and numbers in the index name became a pattern.",
    "indexed_shape": "The geometry is stored elsewhere; only that is known.",
    "must_filter_merged": "must and filter select alike and were joined.",
    "percolate_lookup": "The percolated document is stored elsewhere; only that is known.",
    "range_legacy_bounds": "from and to were read as the bounds that they stand for.",
    "range_unbounded": "A range without bounds asks for the field to exist.",
    "reorder": "Siblings whose order doesn't matter were sorted.",
    "script_score_unwrapped": "script_score selects what its query selects, but for a min_score, which is noted.",
    "section_ignored": "This section doesn't say what is searched for.",
    "should_boost_only": "This should group only raises scores, and was noted.",
    "terms_lookup": "The terms are stored elsewhere; a placeholder stands for them.",
    "unwrap": "A connector of one clause is that clause.",
    "wrapper_decoded": "The wrapped query was decoded and read.",
}


class Log:
    """Counts of rules and the details they applied to."""

    __slots__ = ("found",)

    def __init__(self) -> None:
        self.found: dict[str, list] = {}

    def add(self, rule: str, detail: str = "") -> None:
        entry = self.found.setdefault(rule, [0, {}])
        entry[0] += 1
        if detail:
            entry[1][detail] = None

    def rows(self) -> list[dict]:
        """In order of rule: {rule, count, why, on}."""
        return [{"rule": r, "count": n, "why": WHY[r], "on": ordered(on) or None} for r, (n, on) in sorted(self.found.items())]


class Silent(Log):
    """Takes no record."""

    def add(self, rule: str, detail: str = "") -> None:
        pass
