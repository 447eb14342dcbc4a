"""Streaming queries, drained over what is there."""

from pyspark.sql import functions as F

from ..operators import budget
from ..streaming import incremental, stateful
from .registry import query
from .texts import TRACK_SQL


@query(None)
def stream_guard_counts(spark, read):
    rows = incremental.screened(read.stream("conversations").where(F.col("text").isNotNull()).select("conv_id", "text"))
    return read.drained(rows.groupBy("decision").agg(F.count("*").alias("rows")), "stream_guard_counts", "complete")


@query(f"SELECT count(DISTINCT {TRACK_SQL.format('url')}) AS urls FROM pages")
def stream_ttl_dedupe(spark, read):
    """Pages that arrive within one time to live: a URL once."""
    rows = read.stream("pages").select("page_id", "url", F.expr("timestamp_seconds(1700000000 + page_id % 30)").alias("ts"))
    once = read.drained(incremental.recent_once(rows, "ts", "10 minutes").select("page_id", "key"), "stream_ttl_dedupe")
    return once.agg(F.count("*").alias("urls"))


@query("SELECT date_trunc('minute', ts) AS minute, event_type AS kind, count(*) AS rows FROM events GROUP BY 1, 2")
def stream_minute_counts(spark, read):
    rows = read.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = read.drained(incremental.per_minute(rows, "ts", "event_type"), "stream_minute_counts", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), F.col("event_type").alias("kind"), "rows")


_HOURS = 6


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT user_id, event_type, event_id, n, t AS kept, 'miss' AS outcome FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN e.t < w.kept + {_HOURS * 3_600_000_000} THEN w.kept ELSE e.t END,
    CASE WHEN e.t < w.kept + {_HOURS * 3_600_000_000} THEN 'hit' WHEN e.t < w.kept + {2 * _HOURS * 3_600_000_000} THEN 'expired' ELSE 'miss' END
    FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
    SELECT event_id, outcome FROM w"""
)
def stream_cache_ttl(spark, read):
    """A cache for each user with a time to live and no limit that matters: what each event finds."""
    stateful.with_state(spark)
    rows = read.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = stateful.cached(rows, "user_id", "event_type", "ts", "event_id", _HOURS * 3600, 1000)
    return read.drained(found, "stream_cache_ttl").select(F.col("id").alias("event_id"), "outcome")


@query(None)
def stream_cache_lru(spark, read):
    """The same with room for two names."""
    stateful.with_state(spark)
    rows = read.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = stateful.cached(rows, "user_id", "event_type", "ts", "event_id", 48 * 3600, 2)
    return read.drained(found, "stream_cache_lru").select(F.col("id").alias("event_id"), "outcome", "evicted")


@query(
    f"""SELECT event_id, blocked FROM (SELECT event_id, ts, coalesce(max(CASE WHEN event_type = 'error' THEN ts + INTERVAL {_HOURS} HOUR END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts, false) AS blocked FROM events)
    WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"""
)
def stream_cooldown(spark, read):
    """Events of users within a cooldown, as far as the watermark has come."""
    stateful.with_state(spark)
    rows = read.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stateful.cooled(rows, "user_id", "ts", "event_id", F.col("event_type") == "error", _HOURS * 3600)
    return read.drained(out, "stream_cooldown").select(F.col("id").alias("event_id"), "blocked")


REQUEST_SQL = """WITH e AS (SELECT user_id, event_id, event_id // 5 % 3 AS request, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'data' END AS kind,
CASE WHEN event_id % 997 = 5 THEN -1 ELSE CAST(floor(value * 10) AS BIGINT) END AS decoded, (event_id * 37) % 400 AS encoded FROM events),
g AS (SELECT *, coalesce(sum(CASE WHEN kind <> 'data' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, request ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n, kind <> 'failed' AND encoded < 0 OR kind = 'data' AND decoded < 0 AS bad FROM e),
s AS (SELECT *, sum(CASE WHEN kind = 'data' THEN greatest(decoded, 0) ELSE 0 END) OVER w AS d, sum(CASE WHEN kind = 'data' THEN encoded ELSE 0 END) OVER w AS sent FROM g WINDOW w AS (PARTITION BY user_id, request, n ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, greatest(d, CASE WHEN kind = 'finished' THEN greatest(sent, encoded) ELSE sent END) AS counted FROM s),
x AS (SELECT *, counted - coalesce(lag(counted) OVER (PARTITION BY user_id, request, n ORDER BY event_id), 0) AS delta FROM c),
t AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM t WHERE bad OR total > 3000)
SELECT user_id, event_id, CAST(total - CASE WHEN bad THEN delta ELSE 0 END AS BIGINT) AS total, CASE WHEN bad THEN 'UPSTREAM_HTTP' ELSE 'RESPONSE_TOO_LARGE' END AS code FROM f WHERE k = 1"""


def _requests(events):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise("data")
    decoded = F.when(k % 997 == 5, -1).otherwise(F.floor(F.col("value") * 10))
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.floor(k / 5) % 3).alias("request"), kind.alias("kind"), decoded.cast("long").alias("decoded"), (k * 37 % 400).alias("encoded"))


@query(REQUEST_SQL)
def request_bytes(spark, read):
    """The event with which each user's requests pass the cap, by the larger of their two sizes."""
    return budget.accounted(_requests(read("events")), "user_id", "event_id", 3000)


@query(REQUEST_SQL)
def stream_request_bytes(spark, read):
    """The same from a stream."""
    stateful.with_state(spark)
    out = stateful.accounted(_requests(read.stream("events")), "user_id", "ts", "event_id", 3000, 90 * 86_400)
    return read.drained(out, "stream_request_bytes").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "total", "code")
