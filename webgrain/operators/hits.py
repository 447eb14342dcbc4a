"""Search hits: ranking, duplicates, limits, fallbacks and bounded work per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def first_of_each(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row per key, the first by order. dropDuplicates would leave the choice to chance."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def reranked(hits: DataFrame, group: str, url: str, position: str, limit: int) -> DataFrame:
    """First occurrence of each URL in a group, ranked anew from 1, up to limit."""
    kept = first_of_each(hits, [group, url], position)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(position)))
    return kept.where(F.col("rank") <= limit)


def limited_then_distinct(hits: DataFrame, group: str, url: str, position: str, limit: int) -> DataFrame:
    """The other order: the first limit hits, and then one of each URL."""
    head = hits.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(position))).where(F.col("__n") <= limit).drop("__n")
    kept = first_of_each(head, [group, url], position)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(position)))


def waves(requests: DataFrame, host: str, position: str, width: int) -> DataFrame:
    """The round in which each request runs if a host serves width at a time."""
    n = F.row_number().over(Window.partitionBy(host).orderBy(position))
    return requests.withColumn("wave", F.ceil(n / width).cast("long"))


def first_success(attempts: DataFrame, key: str, stage: str) -> DataFrame:
    """An ordered chain of attempts, with ok and retryable: the first success that only retryable failures precede.

    A key whose chain stops earlier gets the error at which it stopped. An empty result is a success.
    """
    before = Window.partitionBy(key).orderBy(stage).rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.max(F.when(F.col("ok") | ~F.col("retryable"), 1).otherwise(0)).over(before), F.lit(0)) == 0
    tried = attempts.withColumn("__open", open_).where("__open")
    return first_of_each(tried, [key], F.desc(stage)).drop("__open")


def failure_kind(started: Column, code: Column, elapsed: Column, page_limit: float, overall_left: Column) -> Column:
    """not_started, overall_timeout, page_timeout or page_failure; null for a success."""
    return (
        F.when(~started, "not_started")
        .when(code.isNull(), None)
        .when((code == "TIMEOUT") & (overall_left <= 0), "overall_timeout")
        .when((code == "TIMEOUT") | (elapsed > page_limit), "page_timeout")
        .otherwise("page_failure")
    )


def by_rank(rows: DataFrame, ranks: DataFrame, key: str, url: str) -> DataFrame:
    """Documents or failures with the rank of their hit, 0 if there is none, and their place in that order."""
    known = ranks.groupBy(key, url).agg(F.min("rank").alias("rank"))
    out = rows.join(known, [key, url], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("rank", url)))


def shared_work(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Equal requests do their work once: adds leader, the order of the first with the same key, and waits."""
    first = F.min(order).over(Window.partitionBy(key))
    return requests.withColumn("leader", first).withColumn("waits", F.col(order) > F.col("leader"))


def compact(hits: DataFrame) -> DataFrame:
    """Hits as a tool's answer shows them: provider, title and snippet cut to 100, 200 and 500 characters."""
    cut = lambda c, n: text.first_units(F.col(c), n).alias(c)
    limits = {"provider": 100, "title": 200, "snippet": 500}
    return hits.select(*[cut(c, limits[c]) if c in limits else F.col(f"`{c}`") for c in hits.columns])
