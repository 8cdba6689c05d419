"""Registered queries of sources, ranking, workload plans and capture, each with its SQL.

Requests are built from all rows of ``events``: ``value`` is the time taken, ``ts`` the time, a field's number the shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import digests, index_pattern, register, with_digest
from ..functions.extension import Clause
from ..operators.rank import SORTS, nearest_rank, rank_shapes, ranked, shapes, top_per_bucket
from ..options import Options
from ..sources.bodies import of_text
from ..sources.capture import observed
from ..sources.records import as_line, rewrite
from ..sources.slowlog import records
from . import cases, workload

SPLIT = "2024-01-15 00:00:00"
#: In both dialects: a shape that ends at the split and one that begins there.
FIELD = f"CASE WHEN user_id % 7 = 5 AND ts >= TIMESTAMP '{SPLIT}' THEN 9 ELSE user_id % 7 END"
RELEASE = "CASE WHEN user_id % 7 = 3 THEN 'r0' ELSE 'r' || CAST(user_id % 2 AS STRING) END"
TOOK = "CAST(floor(value) AS INT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _request() -> Column:
    return F.expr(f"concat('{{\"query\":{{\"bool\":{{\"filter\":[{{\"exists\":{{\"field\":\"a_', event_type, '\"}}}},{{\"term\":{{\"b_', {FIELD}, '\":', event_id, '}}}}]}}}}}}')")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest log of all events: flat rows."""
    rows = _events(spark, sf_dir).select("event_id", "ts", F.expr(TOOK).alias("took"), F.expr(RELEASE).alias("release"), _request().alias("request"))
    found = rows.select("event_id", "ts", "took", "release", "request", F.lit("logs-2024.01.31").alias("index"))
    return digests(found, "request", "index").select("event_id", "ts", "took", "release", "hash", "sig", "idx", "q")


LOG = f"""
WITH own AS (SELECT event_id, ts, {TOOK} AS took, {RELEASE.replace("STRING", "VARCHAR")} AS release,
  'logs-* | q=(a_' || event_type || ':* and b_' || ({FIELD}) || ':?)' AS sig,
  'logs-* | q=(a_' || event_type || ':* and b_' || ({FIELD}) || ':' || event_id || ')' AS q FROM events),
log AS (SELECT *, 'q4:' || left(sha256(sig), 12) AS hash FROM own)
"""


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).withColumns({"took_ms": F.col("took").cast("double"), "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")})


def _ranking(sort: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    key = SORTS[sort]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ranked(shapes(_searches(spark, sf_dir), "event_id"), sort, 20)
        return found.select("hash", "sig", "idx", "count", "measured", "total_ms", F.round("mean_ms", 3).alias("mean_ms"), "p95_ms", "max_ms", "slowest", "first", "last")

    return query, f"""{LOG}
SELECT hash, min(sig) AS sig, 'logs-*' AS idx, count(*) AS count, count(took) AS measured, sum(took)::DOUBLE AS total_ms, round(avg(took), 3) AS mean_ms,
  quantile_disc(took, 0.95)::DOUBLE AS p95_ms, max(took)::DOUBLE AS max_ms, first(q ORDER BY took DESC, event_id) AS slowest,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last
FROM log GROUP BY hash ORDER BY {'mean_ms' if sort == 'mean' else 'count' if sort == 'count' else key} DESC, count DESC, hash LIMIT 20"""


_BODY = "'{\"query\":{\"term\":{\"t\":\"' || event_type || '] x\"}},\"size\":' || (event_id % 50)::VARCHAR || '}'"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both appenders, cut ones and others."""
    body = "concat('{\"query\":{\"term\":{\"t\":\"', event_type, '] x\"}},\"size\":', event_id % 50, '}')"
    phase = "CASE WHEN event_id % 5 = 0 THEN 'fetch' ELSE 'query' END"
    plain = f"concat('[T', event_id, '][WARN ][i.s.s.', {phase}, '  ] [node] [logs-2024.01.0', event_id % 9 + 1, '][0] took[1ms], took_millis[', {TOOK}, '], stats[], source[', {body}, CASE WHEN event_id % 11 = 0 THEN '' ELSE '], id[], ' END)"
    as_json = f"concat('{{\"timestamp\": \"T', event_id, '\", \"component\": \"i.s.s.', {phase}, '\", \"message\": \"[logs-2024.01.0', event_id % 9 + 1, '][0]\", \"took_millis\": \"', {TOOK}, '\", \"source\": \"', replace({body}, '\"', '\\\\\"'), '\"}}')"
    return _events(spark, sf_dir).selectExpr("event_id AS id", f"CASE WHEN event_id % 13 = 0 THEN 'other line' WHEN event_id % 2 = 0 THEN {plain} ELSE {as_json} END AS value")


def slowlog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(_lines(spark, sf_dir), "value", "id")


_RECORDS = f"""
WITH kinds AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'noise' WHEN event_id % 2 = 0 AND event_id % 11 = 0 THEN 'cut' ELSE 'record' END AS status FROM events),
records AS (SELECT event_id AS id, status, event_type, event_id % 50 AS m,
  CASE WHEN status = 'record' THEN {_BODY} END AS source, CASE WHEN status = 'record' THEN 'logs-2024.01.0' || (event_id % 9 + 1)::VARCHAR END AS "index",
  CASE WHEN status = 'record' THEN ({TOOK})::DOUBLE END AS took_ms, CASE WHEN status = 'record' THEN 'T' || event_id::VARCHAR END AS ts,
  CASE WHEN status = 'record' THEN CASE WHEN event_id % 5 = 0 THEN 'fetch' ELSE 'query' END END AS phase FROM kinds)
"""


def slowlog_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_shapes(slowlog_records(spark, sf_dir), "fetch", "p95", None, place="id")
    return found.select("hash", "sig", "idx", "count", "total_ms", "p95_ms", "max_ms", "first", "last")


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of both kinds; a batch of two for every third."""
    one = "concat('{\"query\":{\"term\":{\"t\":\"', event_type, '\"}}}')"
    batch = f"concat('{{\"index\":\"own-', event_id % 3, '\"}}\\n', {one}, '\\n\\n{{}}\\n{{\"size\":', event_id % 50, '}}\\n{{\"index\":\"left\"}}\\n')"
    rows = _events(spark, sf_dir).selectExpr("event_id AS id", "CASE WHEN event_id % 7 = 0 THEN 'PUT' ELSE 'post' END AS method", "CASE WHEN event_id % 3 = 0 THEN concat('/base/logs-', event_id, '/_msearch?x=1') ELSE '/base/a+b%2Cc/_search' END AS path", f"CASE WHEN event_id % 3 = 0 THEN {batch} ELSE {one} END AS request_body", f"concat('{{ \"took\": ', {TOOK}, ', \"hits\": 1}}') AS response_head")
    return digests(observed(rows, "base"), "body", "index").select("id", "position", "took", "idx", "sig", "hash")


_CAPTURE = f"""
WITH x AS (SELECT * FROM events WHERE event_id % 7 <> 0),
found AS (
  SELECT event_id AS id, NULL::INT AS position, {TOOK}::BIGINT AS took, 'a+b,c' AS idx, 'a+b,c | q=(t:?)' AS sig FROM x WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 0, NULL, 'own-*', 'own-* | q=(t:?)' FROM x WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 1, NULL, 'logs-*', 'logs-* | size=' || (event_id % 50)::VARCHAR FROM x WHERE event_id % 3 = 0)
SELECT *, 'q4:' || left(sha256(sig), 12) AS hash FROM found"""


def _index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "concat(' logs-2024.01.', lpad(event_id % 28 + 1, 2, '0'), ',metrics-', event_id, '-v2 , audit_20240131,app-2024-', event_type)"
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.expr(name).alias("name"))


def index_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index_names(spark, sf_dir)
    return rows.select("id", index_pattern("name").alias("pattern"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("event_id AS id", "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '17' ELSE concat('{\"size\":', event_id % 50, '}') END AS query", "concat('i-', event_id) AS index", "event_type AS other")
    return rewrite(rows)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), cases.column('{"query":{"term":{"t":"$v"}},"size":$m}').alias("request"))
    return with_digest(rows, dedupe=True).select("id", "digest.q", "digest.sig", "digest.hash")


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), cases.column('{"query":{"term":{"t":"$v"}},"size":$m}').alias("request"))
    rows = rows.selectExpr("id", "search_digest(request, 'logs-7') AS d")
    return rows.selectExpr("id", "d.q AS q", "d.sig AS sig", "search_digest_hash(d.full) AS hash")


def _joined_terms(body: dict) -> Clause | None:
    return Clause("joined", body["at"], {"k": body.get("k")}) if isinstance(body, dict) and "at" in body else None


def extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = cases.clause('{"bool":{"must":[{"own":{"at":"f","k":$n}},{"own":{"k":"$v"}}]}}', "", "", options=Options().with_renderer("own", _joined_terms))
    return case.query(spark, sf_dir)


def extension_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), cases.column('{"query":{"own":{"at":"f","k":"$v"}}}').alias("request"), F.lit("logs-7").alias("index"))
    found = digests(rows, "request", "index", Options().with_renderer("own", _joined_terms), with_rules=True)
    return found.select("id", F.array_join(F.transform("rules", lambda r: F.concat(r["rule"], F.lit("x"), r["count"].cast("string"))), " ").alias("rules"))


def sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured searches as lines of a digest log, read back."""
    lines = capture(spark, sf_dir).select(as_line().alias("value"))
    return lines.select(F.from_json("value", "id bigint, idx string, sig string, hash string, took bigint").alias("x")).select("x.*")


def ndjson_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request a line, with blank lines and carriage returns between."""
    text = F.concat(F.lit("\r\n \n"), cases.column('{"query":{"term":{"t":"$v"}},"size":$m}'), F.lit("\r\n"))
    rows = of_text(_events(spark, sf_dir).select(F.col("event_id").alias("id"), text.alias("text")), "text")
    return digests(rows, "request").select("id", "q", "sig", "hash")


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index names as they are, numbers in them in their order."""
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("{}").alias("request"), F.expr("concat('logs-', event_id, '-x,a-10, a-9')").alias("index"))
    return digests(rows, "request", "index", Options(index_normalizer="identity")).select("id", "idx")


def json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the JSON layout: a source that is text, text escaped twice, or an object."""
    plain = "concat('{\"query\":{\"term\":{\"t\":\"', event_type, '\"}}}')"
    escape = lambda x: f"replace(replace({x}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    source = f"CASE event_id % 3 WHEN 0 THEN concat('\"', {escape(plain)}, '\"') WHEN 1 THEN concat('\"', {escape(escape(plain))}, '\"') ELSE concat('{{\"size\":', event_id % 50, '}}') END"
    lines = _events(spark, sf_dir).selectExpr("event_id AS id", f"concat('{{\"took_millis\":\"', event_id, '\",\"source\":', {source}, '}}') AS value")
    return records(lines, "value", "id").select("id", "source", "took_ms", "phase", "status")


def unknown_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that don't name their phase count with any."""
    rows = _events(spark, sf_dir).selectExpr("concat('{\"size\":', event_id % 50, '}') AS source", "CAST(NULL AS STRING) AS index", "CAST(event_id AS DOUBLE) AS took_ms", "'' AS ts", "CASE event_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'fetch' END AS phase")
    return rank_shapes(rows, "query", top=None).select("hash", "sig", "count")


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = cases.clause('{"bool":{"must":[{"term":{"secret":"$v"}},{"term":{"t":$n}}]}}', "", "", options=Options(redactor=lambda field, value: "***" if field == "secret" else value))
    return case.query(spark, sf_dir)


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("event_id AS id", "CASE event_id % 4 WHEN 0 THEN '{\"a' WHEN 1 THEN '17' WHEN 2 THEN NULL ELSE '{}' END AS request")
    return digests(rows).select("id", F.col("error").isNull().alias("ok"), "hash")


def _one(sig: str, q: str, version: str = "q4") -> str:
    return f"SELECT event_id AS id, {cases.sql(q)} AS q, {cases.sql(sig)} AS sig, '{version}:' || left(sha256({cases.sql(sig)}), 12) AS hash FROM events"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query shapes by the time they took."""
    return _RANKINGS["rank_total"][0](spark, sf_dir)


_RANKINGS = {f"rank_{s}": _ranking(s) for s in SORTS}
_HALVES = f"""{LOG}, h AS (SELECT hash, min(sig) AS sig, count(*) FILTER (WHERE ts < TIMESTAMP '{SPLIT}') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '{SPLIT}') AS after,
  quantile_disc(took, 0.95) FILTER (WHERE ts < TIMESTAMP '{SPLIT}') AS pb, quantile_disc(took, 0.95) FILTER (WHERE ts >= TIMESTAMP '{SPLIT}') AS pa, min(ts) AS first_seen, max(ts) AS last_seen FROM log GROUP BY hash)"""
_SHIFT = "(ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22')"
_BACK = "(ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    **_RANKINGS,
    "slowlog_records": (slowlog_records, f'{_RECORDS} SELECT id, source, "index", took_ms, ts, phase, status FROM records'),
    "slowlog_rank": (
        slowlog_rank,
        f"""{_RECORDS} SELECT 'q4:' || left(sha256(sig), 12) AS hash, sig, 'logs-*' AS idx, count(*) AS count, sum(took_ms) AS total_ms, quantile_disc(took_ms, 0.95) AS p95_ms, max(took_ms) AS max_ms, min(ts) AS first, max(ts) AS last
FROM (SELECT *, 'logs-* | q=(t:?) | size=' || m::VARCHAR AS sig FROM records WHERE phase = 'fetch') GROUP BY sig""",
    ),
    "capture_searches": (capture, _CAPTURE),
    "index_pattern": (index_patterns, "SELECT event_id AS id, 'app-2024-' || event_type || ',audit_*,logs-*,metrics-*-v2' AS pattern FROM events".replace("'app-2024-'", "'app-*-'")),
    "log_rewrite": (
        rewritten,
        """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '{"error":"the request can''t be decoded: it is neither object nor list"}'
ELSE '{"idx":"i-*","q":"' || s || '","sig":"' || s || '","hash":"q4:' || left(sha256(s), 12) || '"}' END AS query, 'i-' || event_id AS "index", event_type AS other FROM (SELECT *, 'i-* | size=' || (event_id % 50)::VARCHAR AS s FROM events)""",
    ),
    "digest_dedupe": (deduped, _one("q=(t:?) | size=$m", "q=(t:$v) | size=$m")),
    "sql_function": (sql_function, _one("logs-* | q=(t:?) | size=$m", "logs-* | q=(t:$v) | size=$m")),
    "extension_clause": (extension, _one("logs-* | q=(f:joined(k=?) and own(?)) | size=$m", "logs-* | q=(f:joined(k=$n) and own(?)) | size=$m", "q4x")),
    "extension_rule": (extension_rule, "SELECT event_id AS id, 'extension_renderedx1 index_patternx1' AS rules FROM events"),
    "log_sink": (sink, f"SELECT id, idx, sig, hash, took FROM ({_CAPTURE})"),
    "ndjson_requests": (ndjson_requests, _one("q=(t:?) | size=$m", "q=(t:$v) | size=$m")),
    "index_identity": (identity, "SELECT event_id AS id, 'a-10,a-9,logs-' || event_id || '-x' AS idx FROM events"),
    "slowlog_json_forms": (json_forms, """SELECT event_id AS id, CASE event_id % 3 WHEN 2 THEN '{"size":' || event_id % 50 || '}' ELSE '{"query":{"term":{"t":"' || event_type || '"}}}' END AS source, event_id::DOUBLE AS took_ms, NULL::VARCHAR AS phase, 'record' AS status FROM events"""),
    "phase_unknown_kept": (unknown_phase, "SELECT 'q4:' || left(sha256(sig), 12) AS hash, sig, count(*) AS count FROM (SELECT 'size=' || event_id % 50 AS sig FROM events WHERE event_id % 3 <> 1) GROUP BY sig"),
    "workload_candidates": (
        lambda s, d: workload.regressed(log(s, d), SPLIT, top=None, candidate_limit=3).select("hash", "p95_before", "p95_after"),
        f"{_HALVES} SELECT hash, pb AS p95_before, pa AS p95_after FROM h WHERE before > 0 AND hash IN (SELECT hash FROM log GROUP BY hash ORDER BY count(*) DESC, hash LIMIT 3)",
    ),
    "workload_flat": (
        lambda s, d: workload.worst_p95(workload.flat(log(s, d).select("ts", "took", "release", F.struct("hash", "sig", F.lit("").alias("q"), F.lit("").alias("idx")).alias("os"))), 3).select("hash", "count"),
        f"{LOG} SELECT hash, count(*) AS count FROM log GROUP BY hash ORDER BY quantile_disc(took, 0.95) DESC, hash LIMIT 3",
    ),
    "redaction": (redaction, _one("logs-* | q=(secret:? and t:?) | size=$m", "logs-* | q=(secret:*** and t:$n) | size=$m")),
    "request_errors": (errors, "SELECT event_id AS id, event_id % 4 = 3 AS ok, CASE WHEN event_id % 4 = 3 THEN 'q4:' || left(sha256(''), 12) END AS hash FROM events"),
    "workload_worst_p95": (lambda s, d: workload.worst_p95(log(s, d), 3), f"{LOG} SELECT hash, min(sig) AS sig, count(*) AS count, quantile_disc(took, 0.95) AS p95 FROM log GROUP BY hash ORDER BY p95 DESC, hash LIMIT 3"),
    "workload_worth_fixing": (lambda s, d: workload.worth_fixing(log(s, d), 5), f"{LOG} SELECT hash, min(sig) AS sig, count(*) AS count, sum(took)::BIGINT AS total, quantile_disc(took, 0.5) AS median FROM log GROUP BY hash ORDER BY total DESC, hash LIMIT 5"),
    "workload_time_by_shape": (lambda s, d: workload.time_by_shape(log(s, d)), f"{LOG} SELECT hash, min(sig) AS sig, count(*) AS count, sum(took)::BIGINT AS total, quantile_disc(took, 0.5) AS median FROM log GROUP BY hash ORDER BY total DESC, hash LIMIT 10"),
    "workload_regressed": (
        lambda s, d: workload.regressed(log(s, d), SPLIT, top=None).withColumn("ratio", F.round("ratio", 6)),
        f"{_HALVES} SELECT hash, sig, pb AS p95_before, pa AS p95_after, round(CASE WHEN pb = 0 OR pa IS NULL THEN 0.0 ELSE pa::DOUBLE / pb END, 6) AS ratio FROM h WHERE before > 0",
    ),
    "workload_new_shapes": (lambda s, d: workload.new_shapes(log(s, d), SPLIT), f"{_HALVES} SELECT hash, sig, after, first_seen FROM h WHERE before = 0 AND after > 0"),
    "workload_stopped_shapes": (lambda s, d: workload.stopped_shapes(log(s, d), SPLIT), f"{_HALVES} SELECT hash, sig, before, last_seen FROM h WHERE after = 0 AND before > 0"),
    "workload_one_release": (lambda s, d: workload.one_release_only(log(s, d)), f"{LOG} SELECT hash, min(sig) AS sig, count(*) AS count, min(release) AS release FROM log GROUP BY hash HAVING count(DISTINCT release) = 1"),
    "workload_p95_over_time": (
        lambda s, d: workload.p95_over_time(log(s, d), "1 day", 5),
        f"{LOG}, worst AS (SELECT hash, quantile_disc(took, 0.95) AS p FROM log GROUP BY hash ORDER BY p DESC, hash LIMIT 5) SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, hash, count(*) AS count, quantile_disc(took, 0.95) AS p95 FROM log WHERE hash IN (SELECT hash FROM worst) GROUP BY ALL",
    ),
    "workload_against_shifted": (
        lambda s, d: workload.against_shifted(log(s, d), "2024-01-15", "2024-01-22", "7 days", None).withColumn("ratio", F.round("ratio", 6)),
        f"""{LOG}, h AS (SELECT hash, min(sig) AS sig, count(*) FILTER (WHERE {_BACK}) AS before, count(*) FILTER (WHERE {_SHIFT}) AS after, quantile_disc(took, 0.95) FILTER (WHERE {_BACK}) AS p95_before, quantile_disc(took, 0.95) FILTER (WHERE {_SHIFT}) AS p95_after FROM log WHERE {_BACK} OR {_SHIFT} GROUP BY hash)
SELECT *, round(CASE WHEN before > 0 THEN CASE WHEN p95_before = 0 OR p95_after IS NULL THEN 0.0 ELSE p95_after::DOUBLE / p95_before END END, 6) AS ratio FROM h""",
    ),
    "top_per_day": (
        lambda s, d: top_per_bucket(_searches(s, d).withColumn("day", F.substring("ts", 1, 10)), "day", 2).drop("sig"),
        f"{LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, hash, sum(took)::DOUBLE AS total_ms, count(*) AS count, row_number() OVER (PARTITION BY day ORDER BY total_ms DESC, count(*) DESC, hash)::INT AS rank FROM log GROUP BY day, hash QUALIFY rank <= 2",
    ),
    "nearest_rank": (
        lambda s, d: _events(s, d).groupBy("event_type").agg(nearest_rank("value", 0.95).alias("p95"), nearest_rank("value", 0.5).alias("median")),
        "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**cases.queries(), **{k: q for k, (q, _) in QUERIES.items()}}


def oracle_sql() -> dict[str, str]:
    return {**cases.oracle_sql(), **{k: s for k, (_, s) in QUERIES.items()}}
