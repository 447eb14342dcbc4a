"""Recordings as folders of JSON lines, and table functions of SQL."""

import json
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from webgrain.functions import hosts
from webgrain.operators import table_functions as tf
from webgrain.sources import captures, recorded


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _run(scenario, repeat, status, ms, *spent):
    return {"scenario_id": scenario, "repeat": repeat, "mode": "live", "status": status, "pipeline_ms": ms, "measurements": [{"stage": s, "duration_ms": d} for s, d in spent]}


@pytest.fixture
def folder(tmp_path):
    def write(name, manifest, *lines):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(manifest if isinstance(manifest, str) else json.dumps(manifest))
        (tmp_path / name / "results.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    write("old", {"model": "m1", "sdkVersion": None, "hashes": {"a": "1", "b": "2"}}, _run("x", 0, "ok", 100.0), _run("y", 0, "failed", 30.0), "no json")
    write("new", {"model": "m2", "evaluationPolicy": "dimensions-v1", "hashes": {"a": "1", "c": "3"}}, _run("x", 0, "failed", 80.0, ("query", 20.0), ("answer", 50.0), ("guard", 5.0)), _run("y", 0, "ok", 10.0, ("assess", 15.0)))
    write("bad", "[1]", _run("x", 1, "ok", 1.0))
    return str(tmp_path)


def test_recorded_runs(spark, folder):
    rows = recorded.recorded_runs(spark, folder)
    assert sorted((r.run, str(r.scenario_id), str(r.broken)) for r in rows.collect()) == [("bad", "x", "None"), ("new", "x", "None"), ("new", "y", "None"), ("old", "None", "no json"), ("old", "x", "None"), ("old", "y", "None")]
    assert "EqualTo(status,ok)" in _plan(rows.where("status = 'ok'"))
    one = rows.where("run = 'new' AND status = 'ok'")
    scan = one._jdf.queryExecution().executedPlan()
    assert [r.scenario_id for r in one.collect()] == ["y"]
    assert scan.collectLeaves().head().metrics().get("numOutputRows").get().value() == 1  # other runs' files are not read
    before, after = (rows.where((F.col("run") == n) & F.col("broken").isNull()) for n in ("old", "new"))
    assert recorded.cohort_differences(before, after).count() == 0
    assert [tuple(r) for r in recorded.cohort_differences(before, rows.where("run = 'bad'")).orderBy("scenario_id", "repeat").collect()] == [("x", 0, 1, 0), ("x", 1, 0, 1), ("y", 0, 1, 0)]
    got = [tuple(r) for r in recorded.compared(before, after).orderBy("scenario_id").collect()]
    assert got == [("x", 0, "live", "ok", "failed", 100.0, 80.0, 70.0, 10.0, 20.0, 1), ("y", 0, "live", "failed", "ok", 30.0, 10.0, 15.0, 0.0, 0.0, 1)]


def test_manifests(spark, folder):
    said = recorded.manifests(spark, folder)
    assert [(r.run, r.broken) for r in said.where("key IS NULL").collect()] == [("bad", "[1]")]
    assert {(r.key, r.value) for r in said.where("run = 'old'").collect()} == {("model", "m1"), ("sdkVersion", None), ("hashes.a", "1"), ("hashes.b", "2")}
    got = {r.key: (r.before, r.after, r.same) for r in recorded.manifest_differences(said, "old", "new").collect()}
    assert len(got) == 10 and {k for k, v in got.items() if not v[2]} == {"model", "hashes.b", "hashes.c"}
    assert got["evaluationPolicy"] == ("dimensions-v1", "dimensions-v1", True) and got["judgeModel"] == (None, None, True) and got["hashes.b"] == ("2", None, False)


def _response(k, status=200, kind="text/html"):
    return (k, "https://a.com/", "https://a.com/", status, kind, {"Content-Type": kind}, f"<p>{k} é".encode(), "http", "r1" if k < 3 else "r2")


def test_recorded_responses(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = spark.createDataFrame([_response(1), _response(2, 500), _response(3, kind="image/png"), _response(4)], f"{recorded.RESPONSE}, run string")
    recorded.write_recorded(rows, path)
    got = recorded.recorded_responses(spark, path)
    assert sorted(tuple(r[c] for c in rows.columns) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    assert {r.capture_id: r.source_error for r in captures.checked(got).collect()} == {1: None, 2: "UPSTREAM_HTTP", 3: "UNSUPPORTED_CONTENT_TYPE", 4: None}
    plan = _plan(got.where("status = 200 AND content_type = 'text/html'"))
    assert "EqualTo(status,200)" in plan and "EqualTo(content_type,text/html)" in plan

    def drained():
        out = recorded.recorded_responses(spark, path, stream=True).drop("headers").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.capture_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drained() == [1, 2, 3, 4]
    recorded.write_recorded(rows.where("capture_id = 4").withColumn("capture_id", F.lit(5).cast("long")), path)
    assert drained() == [1, 2, 3, 4, 5]  # what was read before is not read again


def test_parsers_in_sql(spark):
    tf.register_parsers(spark)
    block = '<div class="result"><a class="result__a" href="https://{0}.com/">T{0}</a><p class="result__snippet">S</p></div>'
    pages = [(1, "".join(block.format(x) for x in "abca")), (2, "<p>No results."), (3, '<form id="challenge-form">'), (4, None), (5, "<p>other")]
    spark.createDataFrame(pages, "id long, body string").createOrReplaceTempView("result_pages")
    got = spark.sql("SELECT p.id, h.* FROM result_pages p, LATERAL block_hits(p.body, 2) h ORDER BY id, rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, "Ta", "https://a.com/", "S", None), (1, 2, "Tb", "https://b.com/", "S", None), (3, None, None, None, None, "BOT_CHALLENGE"), (4, None, None, None, None, "PARSE_CHANGED"), (5, None, None, None, None, "PARSE_CHANGED")]
    lite = spark.sql("SELECT * FROM lite_hits('<table><tr><td><a class=\"result-link\" href=\"https://l.com/\">L</a></td></tr></table>', 5)").first()
    assert (lite.rank, lite.title, lite.url) == (1, "L", "https://l.com/")
    script = spark.sql("""SELECT * FROM script_hits('DDG.pageLayout.load("d",[{"t":"A","u":"https://s.com/","a":"B"},{"n":"/next"}]);', 5)""").collect()
    assert [(r.title, r.url, r.snippet) for r in script] == [("A", "https://s.com/", "B")]


def test_a_provider_as_a_table_function(spark):
    def search(request):
        query = request["query"]
        hit = {"title": f"About {query}", "url": "https://a.com/?utm_source=x", "snippet": "", "rank": 1}
        if query == "slow":
            time.sleep(5)
        if query == "limited":
            raise tf.Failed("RATE_LIMITED")
        if query == "raises":
            raise KeyError("x")
        return {"many": [hit] * 1001, "untitled": [hit, hit | {"title": " "}], "none": [], "twice": [hit, hit | {"rank": 2}], "number": 7}.get(query, [hit, hit | {"url": "https://b.com/", "rank": 2}])

    tf.register_provider(spark, "my_search", search, seconds=1.0)
    queries = ["q", "slow", "limited", "raises", "many", "untitled", "none", "twice", "number", " ", None]
    spark.createDataFrame([(k, q, k % 2) for k, q in enumerate(queries)], "id long, query string, host int").createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM my_search(TABLE(asked) PARTITION BY (host), 'id') ORDER BY id, rank").collect()
    assert got[0].__fields__ == ["id", "rank", "title", "url", "snippet", "error"]
    assert [(r.id, r.rank, r.url) for r in got if not r.error] == [(0, 1, "https://a.com/"), (0, 2, "https://b.com/"), (7, 1, "https://a.com/")]
    assert {r.id: r.error for r in got if r.error} == {1: "TIMEOUT", 2: "RATE_LIMITED", 3: "UNKNOWN", 4: "PARSE_CHANGED", 5: "PARSE_CHANGED", 8: "PARSE_CHANGED", 9: "INVALID_INPUT", 10: "INVALID_INPUT"}
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM my_search(TABLE(SELECT 1 AS id), 'id')").collect()
    for name in ("", "x" * 101, "a\nb", None):
        with pytest.raises(ValueError):
            tf.register_provider(spark, name, search)


def test_equal_requests_of_a_partition_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def search(request):
        with open(log, "a") as f:
            f.write("x")
        return [{"title": request["query"], "url": "https://a.com/", "snippet": "", "rank": 1}]

    tf.register_provider(spark, "counted_search", search)
    spark.range(6).selectExpr("id", "concat('q', id % 2) AS query").createOrReplaceTempView("equal_requests")
    got = spark.sql("SELECT * FROM counted_search(TABLE(equal_requests) PARTITION BY (query), 'id')").collect()
    assert sorted((r.id, r.title) for r in got) == [(k, f"q{k % 2}") for k in range(6)]
    assert len(open(log).read()) == 2


def test_a_retriever_as_a_table_function(spark):
    def retrieve(request):
        if request["url"].endswith("odd"):
            return {"status": "200"}
        return {"final_url": request["url"], "status": 200, "content_type": "text/html", "headers": {"Content-Type": "text/html"}, "body": b"<p>x", "fetch_method": "http"}

    tf.register_retriever(spark, "my_fetch", retrieve)
    rows = spark.createDataFrame([(1, "https://a.com/"), (2, "http://127.0.0.1/"), (3, None), (4, "https://a.com/odd")], "id long, url string")
    rows.withColumn("url_error", hosts.outbound_error(F.col("url"))).createOrReplaceTempView("wanted")
    got = spark.sql("SELECT * FROM my_fetch(TABLE(wanted), 'id')")
    assert {r.id: r.error for r in got.collect()} == {1: None, 2: "UNSAFE_URL", 3: "UNSAFE_URL", 4: "UPSTREAM_HTTP"}
    kept = captures.checked(got.where("error IS NULL").withColumn("requested_url", F.col("final_url"))).first()
    assert (kept.source_error, bytes(kept.body)) == (None, b"<p>x")
