"""Queries on search requests and verdict details."""

from pyspark.sql import functions as F

from ..operators import policy
from ..sources import requests as r
from .registry import query


@query(
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '-2' ELSE '-1' END AS safe, CASE c_nationkey % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'w' WHEN 2 THEN 'm' WHEN 3 THEN 'y' END AS df FROM customer"""
)
def provider_parameters(spark, read):
    segment = F.col("c_mktsegment")
    safe = F.when(segment == "BUILDING", "strict").when(segment == "MACHINERY", "off")
    span = F.element_at(F.array(*map(F.lit, ("day", "week", "month", "year", None))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return read("customer").select("c_custkey", r.safe_search(safe).alias("safe"), r.time_range(span).alias("df"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'us-en' WHEN 1 THEN 'ca-en' WHEN 2 THEN 'jp-jp' WHEN 3 THEN 'uk-en' WHEN 4 THEN 'xx-yy' END AS code FROM part"
)
def region_codes(spark, read):
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), k)
    return read("part").select("p_partkey", r.region_code(pick("en", None, "ja", "EN", None, "ja"), pick(None, "ca", None, "gb", None, "US"), pick(None, None, None, None, " xx-yy ", None)).alias("code"))


@query(
    """SELECT doc_id, CASE WHEN length(trim(q)) > 400 OR length(trim(q)) < 1 THEN 'query' WHEN l < 1 OR l > 20 THEN 'limit' END AS error
    FROM (SELECT doc_id, replace(replace(left(text, 380 + doc_id % 60), chr(10), 'x'), chr(9), 'x') AS q, doc_id % 25 AS l FROM documents)"""
)
def search_validation(spark, read):
    q = F.replace(F.replace(F.expr("left(text, 380 + doc_id % 60)"), F.lit("\n"), F.lit("x")), F.lit("\t"), F.lit("x"))
    none = F.lit(None).cast("string")
    rows = read("documents").select("doc_id", q.alias("query"), (F.col("doc_id") % 25).alias("limit"), *[none.alias(c) for c in ("safe_search", "time_range", "locale", "language", "region")])
    return rows.select("doc_id", r.search_error(rows).alias("error"))


@query(
    """SELECT o_orderkey, list_filter([CASE WHEN a THEN 'PATTERN_DETECTED' END, CASE WHEN b THEN 'SEGMENT_COUNT_LIMIT' END, CASE WHEN c THEN 'CHARACTER_BUDGET_LIMIT' END, CASE WHEN d AND NOT b AND NOT c THEN 'INSPECTION_INCOMPLETE' END], lambda x: x IS NOT NULL)::VARCHAR AS codes
    FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS c, o_orderkey % 7 < 3 AS d FROM orders)"""
)
def reason_code_order(spark, read):
    k, no = F.col("o_orderkey"), F.lit(False)
    codes = policy.reason_codes(k % 2 == 0, k % 3 == 0, k % 5 == 0, no, no, k % 7 < 3)
    return read("orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(policy.ordered_codes(codes), ", "), F.lit("]")).alias("codes"))


@query("SELECT page_id, regexp_matches(html, 'challenge-form|bots use DuckDuckGo too') AS challenged FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN html || '<form id=\"challenge-form\">' ELSE html END AS html FROM pages)")
def challenge_detection(spark, read):
    html = F.when(F.col("page_id") % 9 == 0, F.concat("html", F.lit('<form id="challenge-form">'))).otherwise(F.col("html"))
    return read("pages").select("page_id", r.challenged(html).alias("challenged"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'query' WHEN c_custkey % 11 = 0 THEN 'limit' WHEN c_custkey % 7 = 1 THEN 'safe_search' WHEN c_custkey % 7 = 2 THEN 'time_range' WHEN c_custkey % 5 = 0 THEN 'locale'
    WHEN c_custkey % 5 = 1 AND c_custkey % 2 = 0 THEN 'language' WHEN c_custkey % 5 = 2 AND c_custkey % 2 = 0 THEN 'region' WHEN c_custkey % 5 = 3 THEN 'locale_with_language_or_region' END AS error FROM customer"""
)
def search_fields(spark, read):
    """All fields of a search request, each wrong in some rows."""
    k = F.col("c_custkey")
    rows = read("customer").select(
        "c_custkey", F.when(k % 13 == 0, F.repeat(F.lit("q"), 401)).otherwise(" weather ").alias("query"), F.when(k % 11 == 0, 21).otherwise(5).alias("limit"),
        F.when(k % 7 == 1, "maybe").otherwise("strict").alias("safe_search"), F.when(k % 7 == 2, "hour").otherwise("week").alias("time_range"),
        F.when(k % 5 == 0, "\x01de").when(k % 5 == 3, "de-de").alias("locale"), F.when(k % 5 == 1, F.when(k % 2 == 0, "deu").otherwise("de")).when(k % 5 == 3, "de").alias("language"),
        F.when(k % 5 == 2, F.when(k % 2 == 0, "1A").otherwise("de")).alias("region"),
    )
    return rows.select("c_custkey", r.search_error(rows).alias("error"))
