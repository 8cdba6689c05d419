"""Registered queries: every clause, rule and aggregation on requests built from table rows, each with its SQL.

A case is written once, as texts with marks: ``$v`` event_type, ``$n`` event_id, ``$m`` event_id % 50, ``$u`` user_id; in a
request, ``@f@`` is a term clause of field f and $v. From them
come the request of each row of ``events`` for the digest, and the line, signature and fingerprint that SQL puts
together without knowing how to read a request.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import digests
from ..options import Options

MARKS = {"$v": "event_type", "$n": "event_id", "$m": "event_id % 50", "$u": "user_id"}
INDEX = "logs-2024.01.31"
IDX = "logs-*"


def _parts(text: str) -> list[str]:
    return [p for p in re.split(r"(\$[vnmu])", text) if p]


def column(text: str) -> Column:
    """A text with marks as a string of each row."""
    parts = [F.expr(MARKS[p]).cast("string") if p in MARKS else F.lit(p) for p in _parts(text)]
    return F.concat(*parts) if parts else F.lit("")


def sql(text: str) -> str:
    """A text with marks as a SQL expression."""
    return " || ".join(f"({MARKS[p]})::VARCHAR" if p in MARKS else "'" + p.replace("'", "''") + "'" for p in _parts(text)) or "''"


class Case:
    """``q`` and ``sig``: the line after the index; ``full``: the signature without caps, where it differs; ``on``: rules expected."""

    def __init__(self, request: str, q: str, sig: str, full: str | None = None, options: Options = Options(), rules: str | None = None, index: str | None = INDEX, idx: str = IDX):
        pre = f"{idx} | " if idx else ""
        request = re.sub(r"@(\w+)@", r'{"term":{"\1":"$v"}}', request)
        self.request, self.q, self.sig, self.full = request, pre + q, pre + sig, pre + (full or sig)
        self.options, self.rules, self.index = options, rules, index

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), column(self.request).alias("request"), F.lit(self.index).cast("string").alias("index"))
        found = digests(rows, "request", "index", self.options, with_rules=self.rules is not None)
        names = ["id", "q", "sig", "hash"]
        if self.rules is not None:
            return found.select(*names, F.array_join(F.transform("rules", lambda r: F.concat(r["rule"], F.lit("x"), r["count"].cast("string"))), " ").alias("rules"))
        return found.select(*names)

    def oracle(self) -> str:
        o = self.options
        rules = f", '{self.rules}' AS rules" if self.rules is not None else ""
        short = lambda x: f"CASE WHEN length({x}) > {o.max_length} THEN left({x}, {o.max_length - 1}) || '…' ELSE {x} END" if o.max_length != 512 else x
        return f"SELECT event_id AS id, {short(sql(self.q))} AS q, {short(sql(self.sig))} AS sig, '{o.version}:' || left(sha256({sql(self.full)}), {o.hash_length}) AS hash{rules} FROM events"


def clause(body: str, text: str, signature: str, notes: str = "", **more) -> Case:
    """A case of one query clause beside a size."""
    tail = f" | {notes}" if notes else ""
    return Case(f'{{"query":{body},"size":$m}}', f"q=({text}) | size=$m{tail}", f"q=({signature}) | size=$m{tail}", **more)


def _wrapped() -> str:
    return base64.b64encode(b'{"term":{"kind":"fixed"}}').decode()


CASES: dict[str, Case] = {
    "clause_term": clause('@type@', "type:$v", "type:?"),
    "clause_term_object": clause('{"term":{"type":{"value":"$v","boost":2}}}', "type:$v", "type:?", rules="boost_droppedx1 index_patternx1"),
    "clause_terms": clause('{"terms":{"type":["$v","b$m"]}}', "type:($v or b$m)", "type:(? or ?)"),
    "clause_terms_capped": clause('{"terms":{"n":[$n,1,2,3,4,5,6]}}', "n:($n or 1 or 2 or 3 or 4 or +2)", "n:(? or ? or ? or ? or ? or +2)", full="q=(n:(? or ? or ? or ? or ? or ? or ?)) | size=$m"),
    "clause_terms_lookup": clause('{"terms":{"type":{"index":"$v","id":"1","path":"p"}}}', "type:(<terms-lookup>)", "type:raw(?)", "terms_lookup", rules="index_patternx1 terms_lookupx1"),
    "clause_terms_set": clause('{"terms_set":{"tags":{"terms":["$v"],"minimum_should_match_field":"need"}}}', "tags:(<terms-lookup>)", "tags:raw(?)", "terms_lookup"),
    "clause_match": clause('{"match":{"title":"$v"}}', "title:$v", "title:~?"),
    "clause_match_object": clause('{"match":{"title":{"query":"$v $m","operator":"and"}}}', 'title:"$v $m"', "title:~?"),
    "clause_match_bool_prefix": clause('{"match_bool_prefix":{"title":"$v"}}', "title:$v", "title:~?"),
    "clause_match_phrase": clause('{"match_phrase":{"title":"$v"}}', 'title:"$v"', 'title:"?"'),
    "clause_match_phrase_prefix": clause('{"match_phrase_prefix":{"title":{"query":"$v"}}}', 'title:"$v"', 'title:"?"'),
    "clause_prefix": clause('{"prefix":{"type":"$v"}}', "type:$v*", "type:?*"),
    "clause_wildcard": clause('{"wildcard":{"type":{"value":"$v*"}}}', "type:$v*", "type:*?*"),
    "clause_regexp": clause('{"regexp":{"type":"$v.*"}}', "type:/$v.*/", "type:/?/"),
    "clause_fuzzy": clause('{"fuzzy":{"type":{"value":"$v","fuzziness":2}}}', "type:$v", "type:~?"),
    "clause_common": clause('{"common":{"type":{"query":"$v"}}}', "type:$v", "type:~?"),
    "clause_exists": clause('{"exists":{"field":"$v"}}', "$v:*", "$v:*"),
    "clause_range": clause('{"range":{"n":{"lt":$n,"gte":$m}}}', "n >= $m and n < $n", "n >= ? and n < ?"),
    "clause_range_legacy": clause('{"range":{"n":{"from":$m,"to":$n,"include_upper":true,"include_lower":false}}}', "n > $m and n <= $n", "n > ? and n <= ?", rules="index_patternx1 range_legacy_boundsx1"),
    "clause_range_unbounded": clause('{"range":{"n":{"format":"$v","to":null,"from":null}}}', "n:*", "n:*", rules="index_patternx1 range_unboundedx1"),
    "clause_range_null": clause('{"range":{"n":{"gte":null}}}', "n >= null", "n >= ?"),
    "clause_ids": clause('{"ids":{"values":["$n","$m"]}}', "_id:($n or $m)", "_id:(? or ?)"),
    "clause_multi_match": clause('{"multi_match":{"query":"$v","fields":["a","b^2"]}}', "a|b^2:$v", "a|b^2:~?"),
    "clause_combined_fields": clause('{"combined_fields":{"query":"$v"}}', "*:$v", "*:~?"),
    "clause_query_string": clause('{"query_string":{"query":"type:$v AND n:$n"}}', "(type:$v AND n:$n)", "raw(?)"),
    "clause_simple_query_string": clause('{"simple_query_string":{"query":"$v","fields":["a","b"]}}', "a|b:($v)", "a|b:raw(?)"),
    "clause_nested": clause('{"nested":{"path":"items","query":{"term":{"items.type":"$v"}}}}', "items:{ items.type:$v }", "items:{ items.type:? }"),
    "clause_knn": clause('{"knn":{"vec":{"vector":[1,2],"k":$m,"min_score":0.5}}}', "vec:knn(k=$m,min_score=0.5)", "vec:knn(k=?,min_score=?)"),
    "clause_knn_filter": clause('{"knn":{"vec":{"k":$m,"filter":@type@}}}', "type:$v and vec:knn(k=$m)", "type:? and vec:knn(k=?)"),
    "clause_neural": clause('{"neural":{"vec":{"query_text":"$v","k":$m}}}', "vec:neural(query=$v,k=$m)", "vec:neural(query=?,k=?)"),
    "clause_geo_distance": clause('{"geo_distance":{"distance":"$mkm","at":{"lat":1,"lon":2}}}', "at:geo_distance($mkm)", "at:geo_distance(?)"),
    "clause_geo_bounding_box": clause('{"geo_bounding_box":{"validation_method":"strict","at":{"top":$m}}}', "at:geo_bbox()", "at:geo_bbox()"),
    "clause_geo_polygon": clause('{"geo_polygon":{"at":{"points":[$m]}}}', "at:geo_polygon()", "at:geo_polygon()"),
    "clause_geo_shape": clause('{"geo_shape":{"area":{"shape":{"type":"Polygon","coordinates":[$m]},"relation":"WITHIN"}}}', "area:geo_shape(polygon,within)", "area:geo_shape(polygon,within)"),
    "clause_xy_shape": clause('{"xy_shape":{"area":{"shape":{"type":"point","coordinates":[$m]}}}}', "area:xy_shape(point,intersects)", "area:xy_shape(point,intersects)"),
    "clause_indexed_shape": clause('{"geo_shape":{"area":{"indexed_shape":{"id":"$v"},"relation":"disjoint"}}}', "area:geo_shape(indexed,disjoint)", "area:geo_shape(indexed,disjoint)", "indexed_shape", rules="index_patternx1 indexed_shapex1"),
    "clause_script": clause('{"script":{"script":{"lang":"x","source":"n > $n"}}}', "script(n > $n)", "script(?)"),
    "clause_has_child": clause('{"has_child":{"type":"reply","query":@type@}}', "has_child(reply):{ type:$v }", "has_child(reply):{ type:? }"),
    "clause_has_parent": clause('{"has_parent":{"parent_type":"post","query":{"range":{"n":{"gt":$n}}}}}', "has_parent(post):{ n > $n }", "has_parent(post):{ n > ? }"),
    "clause_parent_id": clause('{"parent_id":{"type":"reply","id":"$n"}}', "parent_id(reply):$n", "parent_id(reply):?"),
    "clause_more_like_this": clause('{"more_like_this":{"fields":["a","b"],"like":["$v",{"_id":"1"}]}}', 'a|b:like($v or "<doc>")', "a|b:like(? or ?)"),
    "clause_constant_score": clause('{"constant_score":{"filter":@type@,"boost":2}}', "type:$v", "type:?", rules="constant_score_unwrappedx1 index_patternx1"),
    "clause_function_score": clause('{"function_score":{"query":@type@,"functions":[]}}', "type:$v", "type:?", "function_score", rules="function_score_unwrappedx1 index_patternx1"),
    "clause_script_score": clause('{"script_score":{"query":@type@,"min_score":$m}}', "type:$v", "type:?", "script_score:min_score", rules="index_patternx1 script_score_unwrappedx1"),
    "clause_boosting": clause('{"boosting":{"positive":@type@,"negative":{"match_all":{}}}}', "type:$v", "type:?", "boosting", rules="boosting_unwrappedx1 index_patternx1"),
    "clause_dis_max": clause('{"dis_max":{"queries":[@a@,{"term":{"b":$n}}]}}', "a:$v or b:$n", "a:? or b:?"),
    "clause_hybrid": clause('{"hybrid":{"queries":[{"match":{"a":"$v"}},{"neural":{"b":{"k":$m}}}]}}', "a:$v or b:neural(k=$m)", "a:~? or b:neural(k=?)"),
    "clause_percolate": clause('{"percolate":{"field":"query","document":{"type":"$v"}}}', "query:percolate()", "query:percolate()"),
    "clause_percolate_lookup": clause('{"percolate":{"field":"query","index":"i","id":"$n"}}', "query:percolate(indexed)", "query:percolate(indexed)", "percolate_lookup", rules="index_patternx1 percolate_lookupx1"),
    "clause_rank_feature": clause('{"rank_feature":{"field":"$v","saturation":{}}}', "$v:rank_feature()", "$v:rank_feature()"),
    "clause_distance_feature": clause('{"distance_feature":{"field":"at","pivot":"$md","origin":"now"}}', "at:distance_feature(pivot=$md)", "at:distance_feature(pivot=?)"),
    "clause_intervals": clause('{"intervals":{"text":{"match":{"query":"$v"}}}}', "text:intervals()", "text:intervals()"),
    "clause_wrapper": clause('{"bool":{"must":[{"wrapper":{"query":"' + _wrapped() + '"}},@type@]}}', "kind:fixed and type:$v", "kind:? and type:?", rules="index_patternx1 wrapper_decodedx1"),
    "clause_match_all": clause('{"match_all":{"_name":"$v"}}', "*", "*"),
    "clause_match_none": clause('{"match_none":{"_name":"$v"}}', "none", "none"),
    "clause_malformed": clause('{"bool":{"must":[{"term":"$v"},{"match_phrase":{}},{"exists":{"field":$n}},{"terms":7}]}}', "exists(?) and phrase(?) and term(?) and terms(?)", "exists(?) and phrase(?) and term(?) and terms(?)"),
    "bool_all_slots": clause('{"bool":{"must":[{"match":{"a":"$v"}}],"filter":{"term":{"b":$n}},"must_not":[{"exists":{"field":"c"}}]}}', "a:$v and b:$n and not c:*", "a:~? and b:? and not c:*", rules="index_patternx1 must_filter_mergedx1"),
    "bool_should_filters": clause('{"bool":{"should":[{"term":{"b":$n}},@a@]}}', "a:$v or b:$n", "a:? or b:?", rules="index_patternx1 reorderx1 unwrapx1"),
    "bool_should_boosts": clause('{"bool":{"must":[@a@],"should":[{"exists":{"field":"b"}},{"exists":{"field":"c"}}]}}', "a:$v", "a:?", "should=2", rules="index_patternx1 should_boost_onlyx1 unwrapx1"),
    "bool_minimum": clause('{"bool":{"filter":[@z@],"should":[{"term":{"a":1}},{"term":{"b":$n}},{"term":{"c":3}}],"minimum_should_match":2}}', "(a:1 or b:$n or c:3){msm=2} and z:$v", "(a:? or b:? or c:?){msm=2} and z:?"),
    "bool_minimum_percent": clause('{"bool":{"should":[@a@,{"term":{"b":1}}],"minimum_should_match":"75%"}}', "a:$v or b:1", "a:? or b:?", "msm=75%"),
    "canon_flatten_or": clause('{"bool":{"should":[{"term":{"a":1}},{"bool":{"should":[@b@,{"term":{"c":2}}]}}]}}', "a:1 or b:$v or c:2", "a:? or b:? or c:?", rules="flattenx1 index_patternx1 unwrapx2"),
    "bool_minimum_zero": clause('{"bool":{"must":{"term":{"a":1}},"should":@b@,"minimum_should_match":0}}', "a:1 and b:$v", "a:? and b:?", rules="index_patternx1"),
    "bool_minimum_one": clause('{"bool":{"must":{"term":{"a":1}},"should":[@b@,{"term":{"c":1}}],"minimum_should_match":1}}', "a:1 and (b:$v or c:1)", "a:? and (b:? or c:?)", rules="index_patternx1"),
    "request_both_aggs": Case('{"aggs":{"a":{"max":{"field":"$v"}}},"aggregations":{"b":{"min":{"field":"x"}}},"size":0}', "aggs=max($v), min(x) | size=0", "aggs=max($v), min(x) | size=0"),
    "option_length_cap": clause('{"bool":{"must":[@a@,{"term":{"b":$n}}]}}', "a:$v and b:$n", "a:? and b:?", options=Options(max_length=24)),
    "canon_flatten": clause('{"bool":{"must":[{"bool":{"must":[@a@,{"term":{"b":$n}}]}},{"term":{"c":1}}]}}', "a:$v and b:$n and c:1", "a:? and b:? and c:?", rules="flattenx1 index_patternx1"),
    "canon_dedupe": clause('{"bool":{"must":[@a@,{"term":{"b":1}},@a@]}}', "a:$v and b:1", "a:? and b:?", rules="dedupex1 index_patternx1"),
    "canon_reorder": clause('{"bool":{"must":[{"term":{"b":1}},@a@]}}', "a:$v and b:1", "a:? and b:?", rules="index_patternx1 reorderx1"),
    "canon_drop_match_all": clause('{"bool":{"must":[{"match_all":{}},@a@,{"term":{"b":1}}]}}', "a:$v and b:1", "a:? and b:?", rules="drop_match_allx1 index_patternx1"),
    "canon_absorb_none": clause('{"bool":{"must":[{"match_none":{}},@a@]}}', "none", "none", rules="absorb_match_nonex1 index_patternx1"),
    "canon_unwrap": clause('{"bool":{"should":[@a@,{"match_none":{}}]}}', "a:$v", "a:?", rules="absorb_match_nonex1 index_patternx1 unwrapx2"),
    "canon_empty": clause('{"bool":{"must":[{"match_all":{}},{"match_all":{"_name":"$v"}}]}}', "*", "*", rules="drop_match_allx1 empty_to_match_allx1 index_patternx1"),
    "canon_precedence": clause('{"bool":{"must":[{"term":{"z":1}}],"must_not":[{"bool":{"should":[@a@,{"term":{"b":1}}]}}],"filter":[{"bool":{"should":[{"range":{"n":{"gt":1,"lt":$n}}},{"term":{"c":2}}]}}]}}', "not (a:$v or b:1) and (c:2 or n > 1 and n < $n) and z:1", "not (a:? or b:?) and (c:? or n > ? and n < ?) and z:?"),
    "level_none": clause('{"terms":{"type":["$v",$n]}}', "type:($v or $n)", "type:($v or $n)", options=Options(normalization="none")),
    "level_structural": Case('{"query":{"terms":{"type":["$v",$n]}},"size":10,"from":20}', "q=(type:($v or $n)) | size=10 from=20", "q=(type:(?)) | size=?", full="q=(type:(?)) | size=?", options=Options(normalization="structural"), index=None, idx=""),
    "option_hash": clause('@type@', "type:$v", "type:?", options=Options(hash_version="v9", hash_length=20)),
    "option_clause_cap": clause('{"bool":{"must":[@a@,{"term":{"b":1}},{"term":{"c":2}}]}}', "a:$v and +2 more", "a:? and +2 more", full="q=(a:? and b:? and c:?) | size=$m", options=Options(max_clauses=1)),
    "quoting": Case('{"query":{"term":{"t":"$v ($n)"}},"post_filter":{"term":{"u":""}}}', 'q=(t:"$v ($n)") | post=(u:"")', "q=(t:?) | post=(u:?)"),
    "request_envelope": Case('{"index":["metrics-2024-01-02","logs-7"],"body":{"query":@t@},"timeout":"1s"}', "q=(t:$v)", "q=(t:?)", index=None, idx="logs-*,metrics-*"),
    "request_post_filter": Case('{"query":@a@,"post_filter":{"term":{"b":$n}},"size":1}', "q=(a:$v) | post=(b:$n) | size=1", "q=(a:?) | post=(b:?) | size=1"),
    "request_sections": Case('{"query":@a@,"_source":false,"highlight":{},"collapse":{"field":"f"},"from":20}', "q=(a:$v) | from=20 | +collapse +highlight", "q=(a:?) | from=20 | +collapse +highlight", rules="index_patternx1 section_ignoredx1"),
    "request_sort": Case('{"query":@a@,"sort":["_score",{"$v":{"order":"desc"}},{"x":"asc","y":{}}],"size":"7"}', "q=(a:$v) | size=7 sort=_score:desc,$v:desc,x:asc,y:asc", "q=(a:?) | size=7 sort=_score:desc,$v:desc,x:asc,y:asc"),
    "agg_terms": Case('{"aggs":{"a":{"terms":{"field":"$v","size":$m}}},"size":0}', "aggs=terms($v,$m) | size=0", "aggs=terms($v,$m) | size=0"),
    "agg_date_histogram": Case('{"aggregations":{"a":{"date_histogram":{"field":"$v","calendar_interval":"1d"}}},"size":0}', "aggs=date_histogram($v,1d) | size=0", "aggs=date_histogram($v,1d) | size=0"),
    "agg_histogram": Case('{"aggs":{"a":{"histogram":{"field":"$v","interval":2.50}}},"size":0}', "aggs=histogram($v,2.5) | size=0", "aggs=histogram($v,2.5) | size=0"),
    "agg_percentile": Case('{"aggs":{"a":{"percentiles":{"field":"$v","percents":[95.0]}}},"size":0}', "aggs=p95($v) | size=0", "aggs=p95($v) | size=0"),
    "agg_percentiles": Case('{"aggs":{"a":{"percentiles":{"field":"$v","percents":[50,99.90]}}},"size":0}', "aggs=percentiles($v,[50,99.9]) | size=0", "aggs=percentiles($v,[50,99.9]) | size=0"),
    "agg_filter": Case('{"aggs":{"a":{"filter":{"term":{"$v":1}},"aggs":{"b":{"avg":{"field":"$v"}}}}},"size":0}', "aggs=filter()>avg($v) | size=0", "aggs=filter()>avg($v) | size=0"),
    "agg_nested_order": Case('{"aggs":{"a":{"terms":{"field":"f"},"aggs":{"y":{"sum":{"field":"$v"}},"x":{"max":{"field":"g"}}}}},"size":0}', "aggs=terms(f)>{max(g), sum($v)} | size=0", "aggs=terms(f)>{max(g), sum($v)} | size=0"),
    "agg_names": Case('{"aggs":{"own":{"terms":{"field":"$v"}}},"size":0}', "aggs=own:terms($v) | size=0", "aggs=own:terms($v) | size=0", options=Options(agg_names=True)),
}

OPAQUE = "agentic field_masking_span sltr span_containing span_first span_multi span_near span_not span_or span_term span_within template type anything_else".split()
METRIC = "avg sum min max value_count cardinality stats extended_stats median_absolute_deviation percentile_ranks weighted_avg geo_bounds geo_centroid boxplot matrix_stats rate scripted_metric t_test".split()
BUCKET = "adjacency_matrix auto_date_histogram children date_range diversified_sampler geo_distance geohash_grid geotile_grid global ip_range missing multi_terms parent range sampler significant_text variable_width_histogram significant_terms rare_terms".split()
PIPELINE = "avg_bucket bucket_script bucket_selector bucket_sort cumulative_cardinality cumulative_sum derivative extended_stats_bucket max_bucket min_bucket moving_avg moving_fn moving_percentiles normalize percentiles_bucket serial_diff stats_bucket sum_bucket".split()
BARE = "filters nested reverse_nested composite top_hits".split()


def _each(names: list[str], request: str, line: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """Every row with every name of a list: ``#`` in request and line is the name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("name", F.explode(F.array(*map(F.lit, names))))
        before, after = request.split("#")
        rows = rows.select(F.col("event_id").alias("id"), "name", F.concat(column(before), F.col("name"), column(after)).alias("request"))
        return digests(rows).select("id", "name", "q", "sig", "hash")

    before, after = line.split("#")
    text = f"{sql(before)} || name || {sql(after)}"
    return query, f"SELECT event_id AS id, name, {text} AS q, {text} AS sig, 'q4:' || left(sha256({text}), 12) AS hash FROM events CROSS JOIN (SELECT unnest({names!r}) AS name)"


EACH = {
    "clauses_opaque": _each(OPAQUE, '{"query":{"#":{"field":"$v"}},"size":$m}', "q=(#(?)) | size=$m"),
    "aggs_metric": _each(METRIC, '{"aggs":{"a":{"#":{"field":"$v"}}},"size":0}', "aggs=#($v) | size=0"),
    "aggs_bucket": _each(BUCKET, '{"aggs":{"a":{"#":{"field":"$v"}}},"size":0}', "aggs=#($v) | size=0"),
    "aggs_pipeline": _each(PIPELINE, '{"aggs":{"a":{"#":{"buckets_path":"$v"}}},"size":0}', "aggs=#() | size=0"),
    "aggs_bare": _each(BARE, '{"aggs":{"a":{"#":{"field":"$v"}}},"size":0}', "aggs=#() | size=0"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{k: c.query for k, c in CASES.items()}, **{k: q for k, (q, _) in EACH.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: c.oracle() for k, c in CASES.items()}, **{k: s for k, (_, s) in EACH.items()}}


def sample(name: str, **marks) -> tuple[dict, str]:
    """A case's request for given values of the marks, decoded, and its expected signature: for tests."""
    fill = lambda t: re.sub(r"\$([vnmu])", lambda m: str(marks[m.group(1)]), t)
    return json.loads(fill(CASES[name].request)), fill(CASES[name].sig)
