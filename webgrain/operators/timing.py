"""Retry, cooldown, pacing and settling on recorded timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retry_after_ms(header: Column, now: Column, *, default: int = 60_000, most: int = 300_000) -> Column:
    """Seconds, as a plain decimal number, or an HTTP date -> milliseconds; missing, unreadable or past: default; never above most."""
    plain = F.regexp_extract(header, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$", 1)
    seconds = F.when(plain != "", plain.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.coalesce(seconds * 1000, (F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    return F.when(ms.isNull() | (ms <= 0), default).otherwise(F.least(F.ceil(ms), F.lit(most))).cast("long")


def cooled(events: DataFrame, key: str, ts: str, failed: Column, cooldown_s: int, ties: str | None = None) -> DataFrame:
    """Adds until, the end of the cooldown that earlier failures of the key started, and blocked. ties: orders equal times."""
    end = F.when(failed, F.col(ts) + F.make_interval(secs=F.lit(cooldown_s)))
    before = Window.partitionBy(key).orderBy(ts, *([ties] if ties else [])).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("until", F.last(end, ignorenulls=True).over(before))
    return out.withColumn("blocked", F.coalesce(F.col("until") > F.col(ts), F.lit(False)))


def paced(events: DataFrame, key: str, ts: str, order: list[str], gap_ms: int) -> DataFrame:
    """Adds starts_ms: events start when they arrive, but gap_ms after the one before at the earliest.

    start(i) = max(arrival(i), start(i - 1) + gap) unrolls to a running maximum of arrival - i * gap.
    """
    by = Window.partitionBy(key).orderBy(*order)
    i = F.row_number().over(by) * gap_ms
    out = events.withColumn("__i", i).withColumn("__a", F.unix_millis(F.col(ts).cast("timestamp")) - F.col("__i"))
    return out.withColumn("starts_ms", F.max("__a").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i")).drop("__i", "__a")


def settled(samples: DataFrame, key: str, ts: str, signature: str) -> DataFrame:
    """Per key the first sample whose signature the two before it share; null if it never settles."""
    by = Window.partitionBy(key).orderBy(ts)
    same = (F.col(signature) == F.lag(signature, 1).over(by)) & (F.col(signature) == F.lag(signature, 2).over(by))
    return samples.withColumn("__same", F.coalesce(same, F.lit(False))).groupBy(key).agg(F.min(F.when(F.col("__same"), F.col(ts))).alias("settled_at"), F.count("*").alias("samples"))


def preferred_failure(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Of a key's failed attempts (code, retryable), the one to report: the last, but an observed challenge in place of a
    last one that is retryable and says no more."""
    vague = ("BOT_CHALLENGE", "PARSE_CHANGED", "UPSTREAM_HTTP")
    found = attempts.groupBy(key).agg(F.max_by(F.struct("code", "retryable"), order).alias("last"), F.count_if(F.col("code") == "BOT_CHALLENGE").alias("n"))
    challenge = F.col("last.retryable") & F.col("last.code").isin(*vague) & (F.col("n") > 0)
    return found.select(key, F.when(challenge, "BOT_CHALLENGE").otherwise(F.col("last.code")).alias("code"))
