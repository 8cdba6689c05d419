"""Columns, sources, ranking, plans, streaming and the command line on Spark."""

import io
import json

import pytest
from pyspark.sql import functions as F

from shapeloom.cli import main
from shapeloom.functions.columns import digests, index_pattern, with_digest
from shapeloom.functions.request import digest
from shapeloom.functions.request import index_pattern as plain_pattern
from shapeloom.operators import report
from shapeloom.operators.rank import rank_shapes, ranked, shapes, summary
from shapeloom.plans import workload
from shapeloom.sources import bodies, capture, records, slowlog
from shapeloom.streaming import slowlog as stream

BODY = '{"query":{"term":{"t":"a] \\"b"}},"size":5}'


def plain(ts, took, body=BODY, phase="query", index="logs-2024.01.02"):
    return f"[{ts}][WARN ][i.s.s.{phase}   ] [n] [{index}][0] took[1ms], took_millis[{took}], total_hits[0], source[{body}], id[], "


def test_columns_equal_plain_python(spark):
    rows = [(json.dumps({"query": {"term": {"a": i}}, "size": i}), f"logs-2024.01.0{i}") for i in range(5)] + [("{", "x"), (None, None), ("{}", None)]
    df = spark.createDataFrame(rows, "request string, index string")
    for row in digests(df, "request", "index").collect():
        if row["error"] is None:
            want = digest(row["request"], row["index"])
            assert (row["idx"], row["q"], row["sig"], row["hash"]) == (want["idx"], want["q"], want["sig"], want["hash"])
        else:
            assert row["hash"] is None and row["request"] in ("{", None)
    once = with_digest(df, "request", "index", dedupe=True).selectExpr("request", "digest.hash")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, with_digest(df, "request", "index").selectExpr("request", "digest.hash").collect()), key=str)
    for bad, message in (("{", "decoded"), (None, "null")):
        with pytest.raises(Exception, match=message):
            digests(spark.createDataFrame([(bad, "x"), ("{}", None)], "request string, index string"), "request", "index", strict=True).collect()


def test_one_evaluation_and_none_when_unused(spark):
    df = spark.createDataFrame([("{}",)], "request string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert plan(digests(df).select("sig", "hash", "q")).count("ArrowEvalPython") == 1
    assert plan(digests(df).select("request")).count("ArrowEvalPython") == 0


def test_index_pattern_column(spark):
    names = ["logs-2026.08.13", " b ,a,", "app-000012_x", "2024-01-02-03", "a-1-2-3", "x1-2y", "", "l-20240102.7", "7"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", index_pattern("n").alias("p"))
    assert {r["n"]: r["p"] for r in df.collect()} == {n: plain_pattern(n) for n in names}


def test_both_appenders_and_lines_that_are_no_records(spark):
    twice = json.dumps(BODY)[1:-1]
    lines = [
        plain("T1", 7), json.dumps({"timestamp": "T2", "component": "i.s.s.fetch", "message": "[logs-2024.01.02][0]", "took_millis": "8", "source": BODY}),
        json.dumps({"elasticsearch.slowlog.source": twice, "elasticsearch.index.name": "i", "elasticsearch.slowlog.took_millis": 1.5}), "started", plain("T3", 9)[:-20].replace("]", "", 0)[:100] + " source[{\"a\":\"", "", json.dumps({"source": {"size": 1}}),
    ]
    found = slowlog.records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string"), "value", "i").orderBy("i").collect()
    assert [r["status"] for r in found] == ["record", "record", "record", "noise", "cut", "noise", "record"]
    assert found[0][1:6] == (BODY, "logs-2024.01.02", 7.0, "T1", "query") and found[1]["phase"] == "fetch" and found[1]["took_ms"] == 8
    assert found[2]["source"] == BODY and found[2]["index"] == "i" and found[2]["took_ms"] == 1.5 and found[6]["source"] == '{"size":1}'


def test_statistics_are_nearest_rank_and_ties_go_to_the_first(spark):
    rows = [("h", "s", "i", f"q{t}", float(t), f"{t:02}", t) for t in range(1, 21)] + [("h", "s", "i", "later", 20.0, "99", 30), ("n", "s2", "i", "only", None, None, 31)]
    df = spark.createDataFrame(rows, "hash string, sig string, idx string, q string, took_ms double, ts string, at int")
    one, none = ranked(shapes(df.filter("at <> 30"), "at"), "total").collect()
    assert (one["count"], one["total_ms"], one["mean_ms"], one["p95_ms"], one["max_ms"], one["slowest"], one["first"], one["last"]) == (20, 210, 10.5, 19, 20, "q20", "01", "20")
    assert (none["measured"], none["total_ms"], none["slowest"]) == (0, None, "only")
    assert shapes(df, "at").filter("hash = 'h'").first()["slowest"] == "q20"


def test_ranking_from_files(spark, tmp_path):
    lines = [plain("T1", 5), plain("T2", 30, '{"size":1}'), plain("T3", 1, phase="fetch"), plain("T4", 2, "{oops}"), "noise", "source[{"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    found = slowlog.read(spark, str(tmp_path))
    s = summary(found)
    assert (s.lines, s.records, s.shapes, s.total_ms, s.failed, s.other_phase) == (6, 3, 2, 35.0, 2, 1)
    rows = rank_shapes(found, place="place").collect()
    assert [r["sig"] for r in rows] == ["logs-* | size=1", "logs-* | q=(t:?) | size=5"]
    out, err = io.StringIO(), io.StringIO()
    assert main(["slowlog", "-s", "max", str(tmp_path)], out=out, err=err) == 1
    assert "6 lines, 3 records, 2 shapes, 35 ms total (1 record from another phase, see --phase; 2 unreadable" in out.getvalue() and "max*" in out.getvalue()
    assert json.loads(report.as_json([r.asDict() for r in rows]))[0]["slowest"] == {"took_ms": 30.0, "text": "logs-* | size=1"}


def test_bodies_and_command_line(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"size":1}\n\n{"size":2}\n{\n')
    assert bodies.ndjson(spark, str(tmp_path)).count() == 3 and bodies.whole(spark, str(tmp_path)).count() == 1
    out, err = io.StringIO(), io.StringIO()
    assert main(["--ndjson", "-i", "logs-1", str(tmp_path / "x.ndjson")], out=out, err=err) == 1
    assert [x.split("\t")[1] for x in out.getvalue().splitlines()] == ["logs-* | size=1", "logs-* | size=2"] and "line 4" in err.getvalue()
    assert main(["--hash", "-"], stdin=io.StringIO("{}"), out=out) == 0 and main([str(tmp_path / "no")], err=err) == 2
    with pytest.raises(SystemExit):
        main(["--json", "--hash", "-"])


def test_capture():
    batch = '{"index":["a","b"]}\n{"size":1}\n\nnot json\n{"size":2}\n{"index":"left"}'
    assert capture.extract("post", "/x/_msearch", batch) == [("a,b", '{"size":1}', 0), ("x", '{"size":2}', 1)]
    assert capture.extract("GET", "/p/a%20b/_search?x=/y", "{}", "p") == [("a b", "{}", None)]
    for method, path, body, base in (("PUT", "/_search", "{}", ""), ("GET", "/a/b/_search", "{}", ""), ("GET", "/_search", "", ""), ("GET", "/px/_search", "{}", "p"), ("GET", "/_count", "{}", "")):
        assert capture.extract(method, path, body, base) == []


def test_observed_and_rewritten(spark):
    df = spark.createDataFrame([(1, "GET", "/i/_search", "{}", '{"took": 12,', 200), (2, "POST", "/_msearch", "{}\n{}\n{}\n{}", '{"took":5', 200), (3, "GET", "/i/_search", "{}", None, None)], "id int, method string, path string, request_body string, response_head string, status int")
    assert [(r["id"], r["position"], r["took"]) for r in capture.observed(df).orderBy("id", "position").collect()] == [(1, None, 12), (2, 0, None), (2, 1, None), (3, None, None)]
    rows = records.rewrite(spark.createDataFrame([("{}", "i-1", 1), ("x", None, 2), (None, None, 3)], "query string, index string, other int")).orderBy("other").collect()
    assert json.loads(rows[0]["query"])["idx"] == "i-*" and "error" in json.loads(rows[1]["query"]) and rows[2]["query"] is None and rows[0]["index"] == "i-1"


def test_workload_scenario(spark):
    """Four shapes over six hours: a slowdown in hour 4, a release in hour 5."""
    from datetime import datetime, timedelta
    from decimal import ROUND_HALF_UP, Decimal

    base, rows = datetime(2026, 8, 19, 10), []
    for name, rate, ms, late, first in (("work", 1200, 8, 8, 0), ("regressed", 60, 42, 910, 0), ("deployed", 90, 25, 25, 5), ("slow", 5, 1400, 1400, 0)):
        for h in range(first, 6):
            for i in range(rate):
                took = (Decimal(late if h >= 4 else ms) * (1 + Decimal((i % 7) - 3) * Decimal("0.06"))).quantize(Decimal(1), ROUND_HALF_UP)
                rows.append((base + timedelta(seconds=h * 3600 + i * 3600 // rate), int(took), "v2" if h >= 5 else "v1", name, name))
    log = spark.createDataFrame(rows, "ts timestamp, took int, release string, hash string, sig string").cache()
    assert log.count() == 7680
    assert [(r["hash"], r["p95"]) for r in workload.worst_p95(log).collect()] == [("slow", 1484), ("regressed", 1019), ("deployed", 30)]
    assert [(r["hash"], r["total"], r["median"]) for r in workload.worth_fixing(log).collect()] == [("regressed", 118560, 47), ("work", 57588, 8), ("slow", 39480, 1316), ("deployed", 2271, 25)]
    first = workload.regressed(log, "2026-08-19 14:00:00").first()
    assert (first["hash"], first["p95_before"], first["p95_after"], round(first["ratio"], 2)) == ("regressed", 50, 1074, 21.48)
    assert [r["hash"] for r in workload.new_shapes(log, "2026-08-19 15:00:00").collect()] == ["deployed"] and workload.stopped_shapes(log, "2026-08-19 15:00:00").count() == 0
    assert [r["hash"] for r in workload.one_release_only(log).collect()] == ["deployed"]
    assert workload.p95_over_time(log, "1 hour", 1).count() == 6
    shifted = {r["hash"]: r for r in workload.against_shifted(log, "2026-08-19 15:00:00", "2026-08-19 16:00:00").collect()}
    assert shifted["deployed"]["ratio"] is None and shifted["work"]["ratio"] == 1.0
    assert workload.regressed(log, "2026-08-19 14:00:00", candidate_limit=1).collect()[0]["hash"] == "work"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(plain(f"2026-08-20T21:4{i}:00,000", i) for i in range(6)) + "\nnoise\n")
    q = stream.windowed(stream.lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").agg(F.sum("count"), F.sum("total_ms")).first() == (6, 15.0)


def test_entry_and_oracles(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
