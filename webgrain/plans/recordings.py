"""Queries on recordings and on table functions."""

from pyspark.sql import functions as F

from ..operators import table_functions
from ..sources import recorded, shared
from .registry import query

_STAGES = {"signup": "query", "purchase": "answer", "view": "assess", "click": "guard"}
_STAGE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGES.items()) + " ELSE 'read' END"


@query(
    f"""WITH e AS (SELECT user_id, event_id % 2 AS side, {_STAGE} AS stage, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS cents FROM events),
    r AS (SELECT user_id, side, CASE WHEN count(*) FILTER (stage = 'read') > 0 THEN 'failed' ELSE 'ok' END AS status, sum(cents) AS ms, sum(CASE WHEN stage IN ('query', 'answer', 'assess') THEN cents ELSE 0 END) AS model,
        sum(CASE WHEN stage = 'query' THEN cents ELSE 0 END) AS query, count(*) FILTER (stage IN ('answer', 'assess')) AS calls FROM e GROUP BY 1, 2)
    SELECT CAST(b.user_id AS VARCHAR) AS scenario_id, a.status AS before, b.status AS after, CAST(a.ms AS BIGINT) AS old_ms, CAST(b.ms AS BIGINT) AS ms, CAST(b.model AS BIGINT) AS model_ms, CAST(b.ms - b.model AS BIGINT) AS wait_ms,
        CAST(b.query AS BIGINT) AS query_ms, CAST(b.calls AS INTEGER) AS answer_calls FROM (SELECT * FROM r WHERE side = 1) b LEFT JOIN (SELECT * FROM r WHERE side = 0) a ON a.user_id = b.user_id"""
)
def run_comparison(spark, read):
    """Two runs of events, a scenario for each user, written as recordings and compared case by case."""
    e, stage = read("events"), F.lit("read")
    for k, v in _STAGES.items():
        stage = F.when(F.col("event_type") == k, v).otherwise(stage)
    spent = F.struct(stage.alias("stage"), F.lit(None).cast("string").alias("model"), F.round(F.coalesce("value", F.lit(0)) * 100).alias("duration_ms"), F.lit(None).cast("string").alias("error"))
    rows = e.groupBy(F.col("user_id").cast("string").alias("scenario_id"), F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("run")).agg(F.collect_list(spent).alias("measurements"))
    total = F.aggregate("measurements", F.lit(0.0), lambda n, m: n + m["duration_ms"])
    status = F.when(F.exists("measurements", lambda m: m["stage"] == "read"), "failed").otherwise("ok")
    rows = rows.select("run", "scenario_id", F.lit("live").alias("mode"), F.lit(0).alias("repeat"), status.alias("status"), total.alias("pipeline_ms"), "measurements")
    place = shared.run_dir(spark, "runs")
    recorded.write_recorded(rows, place)
    runs = recorded.recorded_runs(spark, place)
    out = recorded.compared(*[runs.where(F.col("run") == n) for n in ("old", "new")])
    return out.select("scenario_id", "before", "after", *[F.col(c).cast("long").alias(c) for c in ("old_ms", "ms", "model_ms", "wait_ms", "query_ms")], "answer_calls")


@query(
    """SELECT page_id, sha256(encode(html)) AS body_sha256 FROM (SELECT page_id, html, CASE page_id % 4 WHEN 1 THEN 500 ELSE 200 END AS status, CASE page_id % 3 WHEN 1 THEN 'image/png' ELSE 'text/html' END AS kind FROM pages)
    WHERE status = 200 AND kind = 'text/html'"""
)
def recorded_captures(spark, read):
    """Pages written as recorded responses, read back under conditions on status and media type."""
    k, kind = F.col("page_id"), F.when(F.col("page_id") % 3 == 1, "image/png").otherwise("text/html")
    rows = read("pages").select(
        k.alias("capture_id"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.when(k % 4 == 1, 500).otherwise(200).alias("status"), kind.alias("content_type"),
        F.create_map(F.lit("Content-Type"), kind).alias("headers"), F.col("html").cast("binary").alias("body"), F.lit("http").alias("fetch_method"), (k % 2).cast("string").alias("run"),
    )
    place = shared.run_dir(spark, "captures")
    recorded.write_recorded(rows, place)
    kept = recorded.recorded_responses(spark, place).where("status = 200 AND content_type = 'text/html' AND broken IS NULL")
    return kept.select(F.col("capture_id").alias("page_id"), F.sha2("body", 256).alias("body_sha256"))


@query(
    r"""WITH d AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN 1 END::INTEGER AS rank, CASE WHEN doc_id % 7 > 1 THEN coalesce(source, 'none') || ' ' || doc_id END AS title, CASE WHEN doc_id % 7 > 1 THEN 'https://example.com/d/' || doc_id END AS url,
        CASE WHEN doc_id % 7 > 1 THEN left(t, 10000) END AS snippet, CASE doc_id % 7 WHEN 0 THEN 'PARSE_CHANGED' WHEN 1 THEN 'BOT_CHALLENGE' END AS error FROM d"""
)
def result_page_functions(spark, read):
    """Documents as result pages, read in SQL by a table function; a snippet has at most 10,000 characters, as the operator says."""
    table_functions.register_parsers(spark)
    text = F.coalesce("text", F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    link = F.concat(F.lit('<a class="result__a" href="https://example.com/d/'), "doc_id", F.lit('?utm_source=x">'), F.coalesce("source", F.lit("none")), F.lit(" "), "doc_id", F.lit("</a>"))
    block = F.concat(F.lit('<div class="result">'), link, F.lit('<div class="result__snippet">'), text, F.lit("</div></div>"))
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<p>"), link)).when(F.col("doc_id") % 7 == 1, F.concat(F.lit('<form id="challenge-form"></form>'), block)).otherwise(block)
    payloads = read("documents").select("doc_id", body.alias("body"))
    return spark.sql("SELECT p.doc_id, h.* FROM {payloads} p, LATERAL block_hits(p.body, 20) h", payloads=payloads)
