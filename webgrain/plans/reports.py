"""Report queries: percentiles, sums, pivots and gates."""

from pyspark.sql import functions as F

from ..operators import budget, policy
from .registry import query


@query(
    """SELECT event_type AS stage, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY 1"""
)
def stage_percentiles(spark, read):
    """Nearest rank: the value at ceil(p * n)."""
    return read("events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("worst")
    )


@query("SELECT o_orderpriority AS stage, CASE WHEN count(x) = count(*) THEN coalesce(sum(x), 0) END AS tokens FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) GROUP BY 1")
def null_propagating_sum(spark, read):
    x = F.when(~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 5 == 0)), F.col("o_custkey"))
    total = F.when(F.count(x) == F.count("*"), F.coalesce(F.sum(x), F.lit(0)))
    return read("orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(total.alias("tokens"))


@query(
    """SELECT o_orderpriority AS stage, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS failed, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS open, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS partial FROM orders GROUP BY 1"""
)
def code_pivot(spark, read):
    out = read("orders").groupBy(F.col("o_orderpriority").alias("stage")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("stage", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("F", "failed"), ("O", "open"), ("P", "partial"))])


@query("SELECT coalesce(event_type, 'all') AS mode, count(*) AS runs, CAST(count_if(value > 25) AS BIGINT) AS slow FROM events GROUP BY GROUPING SETS ((), (event_type))")
def mode_grouping_sets(spark, read):
    out = read("events").rollup("event_type").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 25).alias("slow"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("mode"), "runs", "slow")


@query(
    """SELECT source, count(*) AS labelled, CAST(count_if(quality = 1) AS BIGINT) AS passed, CAST(count_if(toxic = 1) AS DOUBLE) / count(*) AS toxic_rate, CAST(count_if(toxic = 1) AS DOUBLE) / count(*) <= 0.05 AS gate
    FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1"""
)
def corpus_gate(spark, read):
    rows = read("documents").select("doc_id", "source").join(read("labels"), "doc_id")
    rate = F.count_if(F.col("toxic") == 1).cast("double") / F.count("*")
    return rows.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("passed"), rate.alias("toxic_rate"), (rate <= 0.05).alias("gate"))


@query(
    """SELECT user_id, CASE WHEN bool_or(event_type = 'error' OR value < 2) THEN 'failed' WHEN count(*) < 3 THEN 'inconclusive' ELSE 'passed' END AS status FROM events GROUP BY 1"""
)
def judge_status(spark, read):
    broken = F.count_if((F.col("event_type") == "error") | (F.col("value") < 2))
    results = F.when(F.count("*") < 3, F.array(F.lit("unknown"))).otherwise(F.array(F.lit("pass")))
    rows = read("events").groupBy("user_id").agg(broken.alias("broken"), results.alias("results"))
    scores = F.array(*[F.lit(5)] * 5)
    return rows.select("user_id", policy.judged(F.col("broken"), F.lit(True), scores, F.col("results"), F.lit(True)).alias("status"))


@query("SELECT user_id, event_id, sum(least(value, 40)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) > 200 AS over_cap FROM events")
def byte_accounting(spark, read):
    """Running totals of capped sizes against a cap."""
    rows = read("events").select("user_id", "event_id", F.least(budget.wire_size(F.col("value"), F.lit(0.0)), F.lit(40.0)).alias("size"))
    return budget.over_cap(rows, "user_id", "event_id", F.col("size"), 200).select("user_id", "event_id", "over_cap")
