"""Requests of our own with the signatures whose fingerprints are a public contract, and a slow log in both layouts."""

import base64
import io
import json

import pytest
from pyspark.sql import functions as F

from shapeloom.cli import main
from shapeloom.functions.request import digest
from shapeloom.operators.rank import rank_shapes, summary
from shapeloom.options import Options
from shapeloom.sources import slowlog

T = lambda f, v="x": {"term": {f: v}}
M = lambda f, v="x": {"match": {f: v}}
R = lambda f, **b: {"range": {f: b}}
B = lambda **slots: {"bool": slots}
STRUCTURAL = Options(normalization="structural", agg_names=True)
NEWEST = [{"@timestamp": {"order": "desc"}}]

#: name: (request, index, options, signature, fingerprint)
PINNED = {
    "filtered log": ({"query": B(filter=[T("service"), R("@timestamp", gte="a", lt="b")], must_not=T("status", 500)), "size": 50, "sort": NEWEST, "_source": ["a"]}, "logs-2026.01.31", Options(), "logs-* | q=(@timestamp >= ? and @timestamp < ? and not status:? and service:?) | size=50 sort=@timestamp:desc", "fe168406e702"),
    "panel": ({"size": 0, "query": B(filter=[T("env"), R("@timestamp", gte="now-1h")]), "aggs": {"h": {"terms": {"field": "host", "size": 10}, "aggs": {"e": {"sum": {"field": "error_count"}}, "p": {"percentiles": {"field": "latency_ms", "percents": [95]}}}}}}, "logs-2026.01.31", Options(), "logs-* | q=(@timestamp >= ? and env:?) | aggs=terms(host,10)>{p95(latency_ms), sum(error_count)} | size=0", "63a1ca5c80b9"),
    "boosts": ({"query": B(must=M("title", "y z"), filter=[T("in_stock", True), R("price", gte=1, lte=9)], should=[T("a"), T("b")]), "from": 40, "size": 20, "sort": ["_score", {"price": "asc"}]}, "catalog-v2", Options(), "catalog-v2 | q=(in_stock:? and price >= ? and price <= ? and title:~?) | size=20 from=40 sort=_score:desc,price:asc | should=2", "cde7babeb8a7"),
    "many terms": ({"query": B(filter=[T("country"), {"terms": {"status": list("abcdefgh")}}])}, "orders", Options(), "orders | q=(country:? and status:(? or ? or ? or ? or ? or +3))", "e9794c1be608"),
    "nested": ({"query": {"nested": {"path": "variants", "query": B(must=[T("variants.color"), R("variants.price", lte=5)])}}}, "catalog-v2", Options(), "catalog-v2 | q=(variants:{ variants.color:? and variants.price <= ? })", "24d5e6929ac3"),
    "two indices": ({"index": ["logs-2026.01.30", "logs-2026.01.31"], "body": {"size": 10, "query": B(should=[{"match_phrase": {"message": "a b"}}, M("message")])}}, None, Options(), 'logs-* | q=(message:~? or message:"?") | size=10', "4f1eaee8e165"),
    "opaque": ({"query": B(filter=[{"prefix": {"host": "w"}}, {"exists": {"field": "host"}}, {"span_near": {"clauses": []}}]), "highlight": {"fields": {}}, "collapse": {"field": "x"}}, "metrics-2026.01", Options(), "metrics-* | q=(host:* and host:?* and span_near(?)) | +collapse +highlight", "a235723d04dc"),
    "two of three": ({"query": B(filter=[T("lang")], should=[M("body", w) for w in "abc"], minimum_should_match=2)}, "docs", Options(), "docs | q=(lang:? and (body:~? or body:~? or body:~?){msm=2})", "862a058a0f91"),
    "query string": ({"query": B(must=[{"query_string": {"query": "a AND b"}}, {"wildcard": {"path": "/a*"}}]), "size": 100}, "logs-2026.01.31", Options(), "logs-* | q=(raw(?) and path:*?*) | size=100", "6fb4a2d9c302"),
    "structural": ({"size": 0, "query": B(filter=[{"terms": {"service": ["a", "b"]}}, R("@timestamp", gte=1, lt=2)]), "aggs": {"over_time": {"date_histogram": {"field": "@timestamp", "fixed_interval": "1h"}, "aggs": {"unique_users": {"cardinality": {"field": "user_id"}}}}}}, "logs-2026.01.31", STRUCTURAL, "logs-* | q=(@timestamp >= ? and @timestamp < ? and service:(?)) | aggs=over_time:date_histogram(@timestamp,1h)>unique_users:cardinality(user_id) | size=0", "8b4c9e9aebc2"),
    "after the query": ({"query": B(must=[M("name"), R("price", gte=1, lt=2)]), "post_filter": B(filter=[T("in_stock"), T("brand")]), "aggs": {"b": {"terms": {"field": "brand", "size": 20}}}, "size": 24}, "shop-catalog", Options(), "shop-catalog | q=(name:~? and price >= ? and price < ?) | post=(brand:? and in_stock:?) | aggs=terms(brand,20) | size=24", "ce0146715c07"),
    "relations": ({"query": B(filter=[{"geo_distance": {"distance": "2km", "location": {"lat": 1, "lon": 2}}}, {"geo_bounding_box": {"delivery_area": {"top_left": [0, 1], "bottom_right": [1, 0]}}}, {"has_parent": {"parent_type": "chain", "query": T("active")}}, {"has_child": {"type": "review", "query": R("rating", gte=4)}}]), "size": 50}, "stores", Options(), "stores | q=(delivery_area:geo_bbox() and has_child(review):{ rating >= ? } and has_parent(chain):{ active:? } and location:geo_distance(?)) | size=50", "ccb4fb77328e"),
    "script": ({"query": B(must=[{"more_like_this": {"fields": ["title", "body"], "like": "x"}}, {"script": {"script": {"source": "1"}}}]), "size": 10}, "articles", Options(), "articles | q=(script(?) and title|body:like(?)) | size=10", "522066bb4084"),
    "children": ({"query": {"script_score": {"query": B(filter=[{"parent_id": {"type": "comment", "id": "1"}}, R("created_at", gte=1)]), "script": {"source": "1"}, "min_score": 2}}, "size": 20}, "forum-2026.01", Options(), "forum-* | q=(parent_id(comment):? and created_at >= ?) | size=20 | script_score:min_score", "621e3adba249"),
    "legacy range": ({"query": B(must=[R("@timestamp", **{"from": None, "to": None, "include_lower": True, "include_upper": True, "boost": 1.0})], must_not=[T("status")], filter=[T("service")]), "size": 50, "sort": NEWEST}, "logs-2026.01.31", Options(), "logs-* | q=(@timestamp:* and not status:? and service:?) | size=50 sort=@timestamp:desc", "a3cd3114b946"),
    "histogram": ({"query": {"terms": {"sku": ["1", "2", "3"]}}, "aggs": {"d": {"date_histogram": {"field": "created", "calendar_interval": "day"}}}}, "orders-2026.01.31", Options(), "orders-* | q=(sku:(? or ? or ?)) | aggs=date_histogram(created,day)", "6b6fb17c6640"),
}


@pytest.mark.parametrize("name", PINNED)
def test_pinned(name):
    request, index, options, sig, pinned = PINNED[name]
    found = digest(json.dumps(request), index, options)
    assert (found["sig"], found["hash"]) == (sig, f"q4:{pinned}")


@pytest.mark.parametrize(
    "query, rule",
    [
        (R("a", **{"from": 1, "to": 2}), "range_legacy_bounds"), ({"function_score": {"query": T("a")}}, "function_score_unwrapped"), ({"script_score": {"query": T("a"), "script": {}}}, "script_score_unwrapped"),
        ({"boosting": {"positive": T("a"), "negative": T("b"), "negative_boost": 0.5}}, "boosting_unwrapped"), ({"wrapper": {"query": base64.b64encode(json.dumps(T("a")).encode()).decode()}}, "wrapper_decoded"),
        ({"terms": {"a": {"index": "i", "id": "1", "path": "p"}}}, "terms_lookup"), ({"geo_shape": {"a": {"indexed_shape": {"id": "1", "index": "i"}}}}, "indexed_shape"), ({"percolate": {"field": "q", "index": "i", "id": "1"}}, "percolate_lookup"),
    ],
)
def test_rules_of_clauses(query, rule):
    assert rule in {r["rule"] for r in digest(json.dumps({"query": query}), None, Options(), with_rules=True)["rules"]}


def test_both_sections_of_aggregations_and_ignored_ones():
    found = digest(json.dumps({"aggs": {"a": {"max": {"field": "x"}}}, "aggregations": {"b": {"min": {"field": "x"}}}, "_source": False}), None, Options(), with_rules=True)
    assert found["sig"] == "aggs=max(x), min(x)" and "section_ignored" in {r["rule"] for r in found["rules"]}


def _captured() -> tuple[list[str], list[str]]:
    """Six records, four of the query phase, in the plain layout and in JSON lines, of which every second is escaped twice."""
    picked = [("filtered none", {"sort": NEWEST, "query": {"match_none": {}}, "size": 50}, "logs-2026.08.20", "query"), ("", PINNED["histogram"][0], "orders-2026.08.20", "query"), ("", PINNED["legacy range"][0], "logs-2026.08.20", "query"), ("", {"query": M("note", 'a ] b "c"'), "size": 10}, "logs-2026.08.20", "query")]
    picked += [("", picked[0][1], picked[0][2], "fetch"), ("", picked[2][1], picked[2][2], "fetch")]
    lines, records = [], []
    for i, (_, body, index, phase) in enumerate(picked):
        source = json.dumps(body)
        lines.append(f"[2026-08-20T10:00:0{i},000][WARN ][index.search.slowlog.{phase}] [n] [{index}][0] took[{i}ms], took_millis[{i}], total_hits[1 hits], search_type[X], source[{source}], id[], ")
        records.append(json.dumps({"type": "index_search_slowlog", "timestamp": f"2026-08-20T10:00:0{i}", "component": f"index.search.slowlog.{phase}", "message": f"[{index}][0]", "took_millis": str(i), "source": json.dumps(source)[1:-1] if i % 2 else source}))
    return lines, records


@pytest.mark.parametrize("layout", [0, 1])
def test_captured_logs(spark, tmp_path, layout):
    (tmp_path / "x.log").write_text("\n".join(_captured()[layout]) + "\n")
    lines = slowlog.read(spark, str(tmp_path))
    want = {"q4:3d2f59f81444": (1, 2), "q4:6b6fb17c6640": (1, 1), "q4:a3cd3114b946": (1, 2), "q4:c2c79d39a171": (1, 1)}
    for k, phase in enumerate(("query", "both")):
        assert {r["hash"]: r["count"] for r in rank_shapes(lines, phase, place="place").collect()} == {h: n[k] for h, n in want.items()}
    s = summary(lines)
    assert (s.lines, s.records, s.other_phase, s.failed) == (6, 4, 2, 0)


def test_ranking_parses_and_digests_once(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(_captured()[0]) + "\n")
    ranked = rank_shapes(slowlog.read(spark, str(tmp_path)), place="place").filter(F.col("hash") != "x")
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2


def test_slow_logs_from_standard_input(spark, tmp_path):
    lines = _captured()[0]
    (tmp_path / "a.log").write_text("\n".join([lines[0], "noise", lines[1][:-40], lines[2].replace('{"', "{", 1)]) + "\n")
    out, err = io.StringIO(), io.StringIO()
    assert main(["slowlog", "-", str(tmp_path / "a.log")], stdin=io.StringIO("\n".join(lines) + "\n"), out=out, err=err) == 1
    assert "10 lines" in out.getvalue() and "2 unreadable, reported above" in out.getvalue()
    told = err.getvalue().splitlines()
    assert len(told) == 2 and "a.log line 3:" in told[0] and "a.log line 4:" in told[1]
    assert main(["slowlog"], stdin=io.StringIO("\n".join(lines)), out=out, err=err) == 0
    assert main(["slowlog"], stdin=io.StringIO("noise\n"), out=out, err=err) == 1


def test_what_the_command_refuses(tmp_path):
    err = io.StringIO()
    assert main(["slowlog", str(tmp_path / "none.log")], err=err) == 2 and "can't read" in err.getvalue()
    for bad in (["--max-values", "-3"], ["--max-values", "x"], ["--hash-length", "1.5"]):
        with pytest.raises(SystemExit) as stop:
            main([*bad, "-"], stdin=io.StringIO("{}"))
        assert stop.value.code == 2
