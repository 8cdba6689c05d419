"""Requests read by shape give what they give one at a time."""

import json
import random

import pyarrow as pa
import pytest

from shapeloom.functions.alike import Shapes
from shapeloom.functions.columns import _batch, _fields, _singly
from shapeloom.functions.extension import Clause
from shapeloom.options import Options
from shapeloom.plans import cases

VALUES = ['"a"', '"b"', '"a b"', '"10"', '"9"', '"x:y"', '"1e1"', '"é"', '""', '"q\\"r"', '"\\u00e9"', '"z\\\\"', '"75%"', '"+1"', '"_score"', '"2024.01.02"', '"\U000f0001"', "0", "1", "-5", "2", "12345678901234567", "-0", "1.50", "1e3", "99999999999999999999", "true", "null", "[]", "[1,\"a\"]", '{"k":1}', "0x1", "01", '"\t"', "--5"]
CLAUSES = [
    '{"term":{"@":#}}', '{"term":{"@":{"value":#,"boost":#}}}', '{"match":{"@":{"query":#}}}', '{"match_phrase":{"@":#}}', '{"terms":{"@":[#,#,#]}}', '{"range":{"@":{"gte":#,"lt":#}}}', '{"range":{"@":{"from":#,"to":#,"include_lower":#}}}',
    '{"exists":{"field":#}}', '{"ids":{"values":[#,#]}}', '{"nested":{"path":#,"query":%}}', '{"has_child":{"type":#,"query":%}}', '{"bool":{"must":[%,%],"filter":%}}', '{"bool":{"should":[%,%],"minimum_should_match":#}}',
    '{"bool":{"must_not":[%],"should":[%,%]}}', '{"bool":{"must":[%,{"match_all":{}}],"filter":[%,{"match_none":{}}]}}', '{"multi_match":{"query":#,"fields":[#]}}', '{"query_string":{"query":#,"fields":[#,"b"]}}', '{"wrapper":{"query":#}}', '{"knn":{"@":{"k":#,"min_score":#,"filter":%}}}',
    '{"geo_shape":{"@":{"shape":{"type":#},"relation":#}}}', '{"script":{"script":{"source":#}}}', '{"more_like_this":{"fields":["a"],"like":[#,#]}}', '{"parent_id":{"type":#,"id":#}}', '{"percolate":{"field":#,"id":#}}', '{"distance_feature":{"field":#,"pivot":#}}', '{"span_near":{"a":#}}', '{"wildcard":{"@":#}}',
]
BODIES = [
    '{"query":%,"size":#,"from":#}', '{"query":%,"sort":[{"a":#},#],"post_filter":%}', '{"index":[#,"b"],"body":{"query":%}}', '{"index":#,"body":{"query":%,"x":#}}', '{"query":%}', '{"query":%,"query":%}', '{"query":{"bool":{"must":[%,%,%]}},"size":#}',
    '{"size":#,"aggs":{"x":{"terms":{"field":#,"size":#}},"y":{"avg":{"field":#},"aggs":{"z":{"histogram":{"field":"h","interval":#}},"p":{"percentiles":{"field":#,"percents":[#]}}}}}}', '{"query":{"bool":{"filter":[%,%],"minimum_should_match":#}}} ', '[#,{"query":%}]',
]


def template(rng):
    text = rng.choice(BODIES)
    for depth in range(4):
        while "%" in text and (depth < 3 or "%" in text):
            text = text.replace("%", rng.choice(CLAUSES if depth < 2 and len(text) < 300 else CLAUSES[:6]), 1)
    return "".join(rng.choice("ab") if c == "@" else c for c in text)


def held(requests, index, options, with_rules):
    shapes = Shapes(options, with_rules, _fields(with_rules))
    for _ in range(2):  # shapes that are new, and shapes that are known
        found = _batch(pa.array(requests, pa.string()), pa.array([index] * len(requests), pa.string()), shapes)
        want = _singly(requests, index, options, with_rules)
        assert found.to_pylist() == want.to_pylist()
    return shapes


@pytest.mark.parametrize("seed", range(4))
def test_any_requests_of_a_shape(seed):
    rng = random.Random(seed)
    for _ in range(20):
        one, pool = template(rng), rng.sample(VALUES, rng.choice((2, 5, 20))) + rng.sample(VALUES[:8], 3)
        requests = ["".join(rng.choice(pool) if c == "#" else c for c in one) for _ in range(120)]
        held(requests, rng.choice((None, "logs-2024.01.02")), Options(normalization=rng.choice(("none", "values", "structural")), max_clauses=rng.choice((2, 12)), max_values=rng.choice((1, 5)), agg_names=rng.random() < 0.3, max_length=rng.choice((20, 512))), rng.random() < 0.5)


def texts(name, n):
    return [cases.CASES[name].request.replace("$v", ("click", "a b", "view")[i % 3]).replace("$n", str(i)).replace("$m", str(i % 50)) for i in range(n)]


def singly_read(name, monkeypatch, n=3000):
    """How many of a case's requests are read one at a time."""
    from shapeloom.functions import columns

    case, read = cases.CASES[name], []
    describe = columns.describe
    shapes = Shapes(case.options, case.rules is not None, _fields(case.rules is not None))
    monkeypatch.setattr(columns, "describe", lambda *a: read.append(a) or describe(*a))
    _batch(pa.array(texts(name, n)), pa.array([case.index] * n), shapes)
    monkeypatch.undo()
    held(texts(name, n), case.index, case.options, case.rules is not None)
    return len(read)


def test_canon_flatten_is_read_by_shape(monkeypatch):
    assert singly_read("canon_flatten", monkeypatch) == 0


def test_siblings_that_their_literals_order(monkeypatch):
    requests = [json.dumps({"query": {"bool": {"must": [{"term": {"a": x}}, {"term": {"a": y}}]}}}) for x in range(40) for y in range(40)]
    shapes = held(requests, None, Options(), True)
    assert all(s.line is None for s in shapes.met[None])


def test_indices_by_row_and_null_requests():
    requests = [None if i % 7 == 0 else "{oops" if i % 7 == 1 else json.dumps({"query": {"term": {"t": f"v{i}"}}, "size": i % 3}) for i in range(500)]
    indices = [None if i % 5 == 0 else f"logs-2024.01.0{i % 3}" if i % 5 < 4 else f"own-{i}-x" for i in range(500)]
    found = _batch(pa.array(requests, pa.string()), pa.array(indices, pa.string()), Shapes(Options(), False, _fields(False))).to_pylist()
    assert found == [_singly([r], i, Options(), False)[0].as_py() for r, i in zip(requests, indices)]
    assert len(_batch(pa.array([], pa.string()), pa.array([], pa.string()), Shapes(Options(), False, _fields(False)))) == 0


def test_bool_all_slots_is_read_by_shape(monkeypatch):
    assert singly_read("bool_all_slots", monkeypatch) == 0


def test_bool_minimum_is_read_by_shape(monkeypatch):
    assert singly_read("bool_minimum", monkeypatch) == 0


def each(names, body, n=1000):
    return [body.replace("#", name).replace("$v", v) for _ in range(n // len(names)) for v in ("click", "view") for name in names]


def read_in_batches(requests, monkeypatch):
    """How many requests of three batches alike are read one at a time; and that they give what each gives alone."""
    from shapeloom.functions import columns
    from shapeloom.functions.request import digest

    read, describe, shapes = [], columns.describe, Shapes(Options(), False, _fields(False))
    monkeypatch.setattr(columns, "describe", lambda *a: read.append(a) or describe(*a))
    for _ in range(3):
        found = _batch(pa.array(requests), pa.nulls(len(requests), pa.string()), shapes, lambda lines: columns._digested(lines, Options()))
    monkeypatch.undo()
    assert [(x["q"], x["sig"], x["hash"]) for x in found.to_pylist()] == [(d["q"], d["sig"], d["hash"]) for d in (digest(r) for r in requests)]
    return len(read)


def test_aggs_pipeline_is_read_once(spark, monkeypatch):
    requests = each(cases.PIPELINE, '{"aggs":{"a":{"#":{"buckets_path":"$v"}}},"size":0}')
    assert read_in_batches(requests, monkeypatch) <= len(set(requests))
    plan = cases.queries()["aggs_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and plan.count("ArrowEvalPython") == 1


def test_aggs_bucket_is_read_once(monkeypatch):
    requests = each(cases.BUCKET, '{"aggs":{"a":{"#":{"field":"$v"}}},"size":0}')
    assert read_in_batches(requests, monkeypatch) <= len(set(requests))


def test_extension_clause_is_read_by_shape(monkeypatch):
    from shapeloom.functions import columns
    from shapeloom.plans.queries import _joined_terms

    requests = [json.dumps({"query": {"bool": {"must": [{"own": {"at": "f", "k": i}}, {"own": {"k": "vw"[i % 2]}}]}}, "size": i % 50}) for i in range(2000)]
    options = Options().with_renderer("own", _joined_terms)
    shapes = held(requests, "logs-2024.01.02", options, False)
    assert [s.line is not None for s in shapes.met["logs-2024.01.02"]] == [True]
    monkeypatch.setattr(columns, "describe", None)
    assert _batch(pa.array(requests), pa.array(["logs-2024.01.02"] * 2000), shapes).null_count == 0


def test_functions_of_the_user_see_what_each_row_holds():
    def own(body):
        k = body.get("k")
        if isinstance(k, int) and k % 5 == 0:
            return None
        if k == 3:
            return Clause("l3", "n", {"a": 1.5})
        return Clause("l", "n", {"k": k, "z": True, "w": [1], "s": str(k) + ("" if isinstance(k, str) or k % 2 else "\\"), "e": None})

    def hide(field, value):
        return None if value == 7 else f'{value}"' if isinstance(value, int) and value % 3 == 0 else "***" if field == "b" else value

    requests = [json.dumps({"query": {"bool": {"must": [{"own": {"k": i % 97}}, {"own": {"k": "v w"[i % 3]}}, {"term": {"a": i}}, {"match_phrase": {"b": f"x{i}"}}, {"multi_match": {"query": f"q{i}", "fields": ["c", "de"[i % 2]]}}]}}}) for i in range(600)]
    for level in ("none", "values"):
        held(requests, None, Options(normalization=level).with_renderer("own", own), True)
        held(requests, None, Options(normalization=level, redactor=hide).with_renderer("own", own), False)
