"""Digests in plain Python: signatures and fingerprints that are a public contract, rules, options, edge cases."""

import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapeloom.functions.extension import Clause
from shapeloom.functions.jsoncompat import Undecodable, decode, encode, number, ordered
from shapeloom.functions.request import InvalidRequest, capped, digest, index_pattern
from shapeloom.functions.tree import NATIVE
from shapeloom.options import InvalidOption, Options
from shapeloom.plans import cases


def q(query, **more):
    return digest(json.dumps({"query": query, **more}))


@pytest.mark.parametrize("name", cases.CASES)
def test_case(name):
    case, marks = cases.CASES[name], {"v": "click", "n": "123", "m": "23", "u": "9"}
    import re

    fill = lambda t: re.sub(r"\$([vnmu])", lambda x: marks[x.group(1)], t)
    found = digest(fill(case.request), case.index, case.options, with_rules=True)
    assert (found["q"], found["sig"]) == tuple(capped(fill(x), case.options.max_length) for x in (case.q, case.sig))
    if case.rules is not None:
        assert " ".join(f"{r['rule']}x{r['count']}" for r in found["rules"]) == case.rules


@pytest.mark.parametrize(
    "request_, index, expected",
    [
        ({"sort": {"@timestamp": "desc"}, "query": {"match_none": []}, "size": 50}, "logs-2026.08.20", "q4:3d2f59f81444"),
        ({"query": {"match": {"note": "x"}}, "size": 10}, "logs-2026.08.20", "q4:c2c79d39a171"),
    ],
)
def test_pinned_fingerprints(request_, index, expected):
    assert digest(json.dumps(request_), index)["hash"] == expected


def test_native_types_are_46():
    assert len(NATIVE) == 46 and len(cases.METRIC + cases.BUCKET + cases.PIPELINE + cases.BARE) + len("terms date_histogram histogram percentiles filter".split()) == 65


def test_order_of_siblings_does_not_matter():
    a, b = {"term": {"a": 1}}, {"exists": {"field": "b"}}
    assert q({"bool": {"filter": [a, b]}})["hash"] == q({"bool": {"filter": [b, a]}})["hash"] == q({"bool": {"must": [b], "filter": a}})["hash"]


def test_values_do_not_reach_the_signature():
    assert q({"term": {"a": "x"}})["hash"] == q({"term": {"a": "y"}})["hash"] != q({"match": {"a": "x"}})["hash"]


def test_caps_do_not_reach_the_fingerprint():
    few, many = ([{"term": {"a": i}} for i in range(n)] for n in (20, 30))
    one, two = q({"bool": {"must": few}}), q({"bool": {"must": many}})
    assert "+8 more" in one["sig"] and one["hash"] != two["hash"]
    long = q({"terms": {"f" * 600: [1]}})
    assert len(long["sig"]) == 512 and long["sig"].endswith("…")


def test_integers_and_digit_strings_only():
    assert q({"match_all": {}}, size="10")["q"].endswith("size=10")
    assert "size" not in q({"match_all": {}}, size=10.0)["q"] and "size" not in q({"match_all": {}}, size=True)["q"]


def test_deep_nesting_is_read_or_refused():
    deep = lambda n: '{"query":' + '{"bool":{"must":' * n + '{"term":{"a":1}}' + "}}" * n + "}"
    assert digest(deep(200))["sig"] == "q=(a:?)"
    with pytest.raises(InvalidRequest):
        digest(deep(300))
    with pytest.raises(InvalidRequest):
        digest("[" * 100_000)


@pytest.mark.parametrize("text", ["", "17", '"x"', "null", '{"a"', "{'a':1}", '{"a":NaN}', '{"a":"\\ud800"}'])
def test_what_is_no_request(text):
    with pytest.raises(InvalidRequest):
        digest(text)


def test_wrapper_takes_unpadded_base64_and_refuses_the_rest():
    inner = base64.b64encode(b'{"term":{"a":1}}').decode()
    assert q({"wrapper": {"query": inner.rstrip("=")}})["sig"] == "q=(a:?)"
    assert q({"wrapper": {"query": inner[:4] + "\n" + inner[4:]}})["sig"] == "q=(a:?)"
    assert q({"wrapper": {"query": "%%%"}})["sig"] == "q=(wrapper(?))"


def test_numbers_and_orders():
    assert [number(x) for x in (1.0, 0.1, 1e25, 0.00001, 2.5, 1e14)] == ["1", "0.1", "1.0E+25", "1.0E-5", "2.5", "1.0E+14"]
    assert ordered(["10", "9", "b", "a"])[:2] == ["9", "10"] and ordered(["b", "a"]) == ["a", "b"]
    assert encode({"a": [1.0, 1.5, "é/"]}) == '{"a":[1,1.5,"\\u00e9\\/"]}'


def test_empty_objects_are_lists_and_numbered_objects_too():
    assert decode("{}") == [] and decode('{"0":1,"1":2}') == [1, 2] and decode('{"1":2}') == {"1": 2}
    assert decode("9223372036854775808") == 9223372036854775808.0
    with pytest.raises(Undecodable):
        decode("{,}")


@pytest.mark.parametrize(
    "name, pattern",
    [("logs-2026.08.13", "logs-*"), ("b, a", "a,b"), ("logs-2024.01.01,logs-2024.01.02", "logs-*"), ("app-000012", "app-*"), ("v2-x", "v2-x"), ("x-2024-01", "x-*"), ("", ""), ("2024", "*")],
)
def test_index_pattern(name, pattern):
    assert index_pattern(name) == pattern


def test_options():
    assert Options.from_dict({"normalization": "structural", "maxValues": None, "hashLength": 99}) == Options("structural", max_values=None, hash_length=64)
    for bad in ({"nope": 1}, {"maxValues": "5"}, {"aggNames": 1}, {"normalization": "all"}, {"hashLength": True}):
        with pytest.raises(InvalidOption):
            Options.from_dict(bad)


def test_extension_and_redactor():
    o = Options().with_renderer("own", lambda body: Clause("own").with_param("k", 3))
    found = digest('{"query":{"own":{}}}', None, o, with_rules=True)
    assert found["q"] == "q=(own(k=3))" and found["hash"].startswith("q4x:") and found["rules"][0]["rule"] == "extension_rendered"
    with pytest.raises(InvalidOption):
        Clause("own").with_param("7", 1)
    hidden = digest('{"query":{"bool":{"must":[{"term":{"a":"s"}},{"query_string":{"query":"s"}}]}}}', None, Options(redactor=lambda f, v: "*"))
    assert hidden["q"] == "q=((s) and a:*)"


leaves = st.one_of(st.text(max_size=5), st.integers(), st.booleans(), st.none(), st.floats(allow_nan=False, allow_infinity=False))
names = st.one_of(st.sampled_from([*NATIVE, "must", "should", "filter", "must_not", "query", "field", "fields", "path", "type", "value", "values", "boost", "minimum_should_match", "0"]), st.text(max_size=4))
bodies = st.recursive(leaves, lambda kids: st.one_of(st.lists(kids, max_size=3), st.dictionaries(names, kids, max_size=3)), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["query", "post_filter", "aggs", "size", "sort", "from", "body", "index", "x"]), bodies, max_size=4), st.sampled_from(["none", "values", "structural"]))
def test_any_object_has_a_digest(request_, level):
    text = json.dumps(request_)
    first, again = (digest(text, "i", Options(normalization=level), with_rules=True) for _ in range(2))
    assert first == again and len(first["hash"]) == 15
