"""Queries on sets of hits: duplicates, limits, ranks, waves, joins and fallbacks."""

from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators import containment, hits, timing
from .registry import query
from .texts import TRACK_SQL

HITS_SQL = f"SELECT page_id % 25 AS query_id, page_id AS pos, {TRACK_SQL.format('url')} AS url FROM pages"


def _hits(read):
    return read("pages").select((F.col("page_id") % 25).alias("query_id"), F.col("page_id").alias("pos"), u.tracking_free(F.col("url")).alias("url"))


@query(
    f"""WITH h AS ({HITS_SQL}), d AS (SELECT query_id, url, min(pos) AS pos FROM h GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM d) SELECT query_id, url, pos, rank FROM r WHERE rank <= 5"""
)
def hits_rerank_limit(spark, read):
    return hits.reranked(_hits(read), "query_id", "url", "pos", 5).select("query_id", "url", "pos", "rank")


@query(
    """WITH h AS (SELECT user_id AS q, event_id AS pos, event_type AS url FROM events),
    a AS (SELECT q, count(*) AS n FROM (SELECT q, url FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) AS k FROM h) WHERE k <= 4 GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT q, least(4, count(DISTINCT url)) AS n FROM h GROUP BY 1)
    SELECT a.q, a.n AS limit_first, b.n AS distinct_first FROM a JOIN b ON a.q = b.q"""
)
def limit_order(spark, read):
    h = read("events").select(F.col("user_id").alias("q"), F.col("event_id").alias("pos"), F.col("event_type").alias("url"))
    a = hits.limited_then_distinct(h, "q", "url", "pos", 4).groupBy("q").agg(F.count("*").alias("limit_first"))
    b = hits.reranked(h, "q", "url", "pos", 4).groupBy("q").agg(F.count("*").alias("distinct_first"))
    return a.join(b, "q")


@query("SELECT l_orderkey, l_linenumber, CAST(ceil(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) / 2.0) AS BIGINT) AS wave FROM lineitem")
def host_concurrency_waves(spark, read):
    rows = read("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").withColumn("pos", F.struct("l_orderkey", "l_linenumber"))
    return hits.waves(rows, "l_suppkey", "pos", 2).select("l_orderkey", "l_linenumber", "wave")


@query("SELECT o_orderkey, coalesce(c_nationkey, 0) AS rank FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def rank_lookup_join(spark, read):
    ranks = read("customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    return read("orders").join(ranks, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_nationkey", F.lit(0)).alias("rank"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def evidence_semi(spark, read):
    return read("documents").select("doc_id", "source").join(read("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def citation_anti(spark, read):
    return read("documents").select("doc_id", "source").join(read("labels").select("doc_id"), "doc_id", "left_anti")


_COHORT = "SELECT user_id, event_type, count(*) AS n, sum(CAST(value * 100 AS BIGINT)) AS cents FROM events WHERE event_id % 2 = {} GROUP BY 1, 2"


@query(
    f"""WITH a AS ({_COHORT.format(0)}), b AS ({_COHORT.format(1)})
    SELECT a.user_id, a.event_type, a.n AS base_n, b.n AS cand_n, b.n - a.n AS delta FROM a JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type"""
)
def cohort_join(spark, read):
    rows = read("events").select("user_id", "event_type", F.col("event_id") % 2 == 0)
    sides = [rows.where(~rows[2] if k else rows[2]).groupBy("user_id", "event_type").agg(F.count("*").alias(n)) for k, n in enumerate(("base_n", "cand_n"))]
    return sides[0].join(sides[1], ["user_id", "event_type"]).withColumn("delta", F.col("cand_n") - F.col("base_n"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def longest_per_key(spark, read):
    return hits.first_of_each(read("documents").select("source", "doc_id", "n_chars"), ["source"], F.desc("n_chars"), "doc_id")


@query("SELECT 'document' AS kind, doc_id AS id, n_chars AS n FROM documents UNION ALL SELECT 'turn', conv_id, length(text) FROM conversations")
def union_evidence(spark, read):
    a = read("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    return a.unionByName(read("conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.length("text").cast("long").alias("n")))


@query(
    r"""WITH b AS (SELECT item_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT item_id, doc_id FROM b JOIN d ON contains(t, q)"""
)
def quote_containment(spark, read):
    """Which documents contain a passage, blanks and case aside."""
    clean = lambda c: F.lower(F.regexp_replace(c, "\\s+", " "))
    docs, quotes = read("documents").select("doc_id", clean("text").alias("t")), read("benchmark").select("item_id", clean("text").alias("q"))
    return containment.contained(docs, "doc_id", "t", quotes, "item_id", "q")


@query(
    """WITH a AS (SELECT user_id, event_id, event_type IN ('click', 'purchase') AS ok, value > 20 AS retryable FROM events),
    b AS (SELECT *, coalesce(max(CASE WHEN ok OR NOT retryable THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM a)
    SELECT user_id, event_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM b WHERE closed = 0) WHERE k = 1"""
)
def fallback_first_success(spark, read):
    rows = read("events").select("user_id", "event_id", F.col("event_type").isin("click", "purchase").alias("ok"), (F.col("value") > 20).alias("retryable"))
    return hits.first_success(rows, "user_id", "event_id").select("user_id", "event_id", "ok")


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not_started' WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'overall_timeout'
    WHEN event_type = 'click' OR value > 30 THEN 'page_timeout' ELSE 'page_failure' END AS kind FROM events"""
)
def failure_classification(spark, read):
    e, kind = F.col("event_id"), F.col("event_type")
    code = F.when(kind == "view", None).when(kind == "click", "TIMEOUT").otherwise("HTTP")
    return read("events").select("event_id", hits.failure_kind(e % 11 != 0, code, F.col("value"), 30, e % 7).alias("kind"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 60000 WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 500 = 0 THEN 60000 ELSE least(300000, (event_id % 500) * 1000) END
    WHEN event_id % 4 = 2 THEN 90000 ELSE 60000 END AS ms FROM (SELECT CAST(event_id AS BIGINT) AS event_id FROM events)"""
)
def retry_after_ms(spark, read):
    k = F.col("event_id") % 4
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    header = F.when(k == 1, (F.col("event_id") % 500).cast("string")).when(k == 2, "Fri, 02 Jan 2026 03:05:35 GMT").when(k == 3, "soon")
    return read("events").select("event_id", timing.retry_after_ms(header, now).alias("ms"))


@query(
    """SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' OR value < 5 THEN ts + INTERVAL 60 SECOND END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts, false) AS blocked FROM events"""
)
def cooldown_until(spark, read):
    failed = (F.col("event_type") == "error") | (F.col("value") < 5)
    return timing.cooled(read("events"), "user_id", "ts", failed, 60, "event_id").select("event_id", "blocked")


@query(
    """SELECT event_id, max(epoch_us(ts) // 1000 - i * 1100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + i * 1100 AS starts_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""
)
def pacing_schedule(spark, read):
    return timing.paced(read("events"), "user_id", "ts", ["ts", "event_id"], 1100).select("event_id", "starts_ms")


@query(
    """SELECT user_id, min(CASE WHEN a AND b THEN event_id END) AS settled_at, count(*) AS samples FROM
    (SELECT user_id, event_id, event_type = lag(event_type, 1) OVER w AS a, event_type = lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1"""
)
def settle_detect(spark, read):
    return timing.settled(read("events"), "user_id", "event_id", "event_type")
