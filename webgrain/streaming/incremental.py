"""The same operators on streams: stateless screening, duplicates within a time limit, counts per minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import guard


def screened(stream: DataFrame, text: str = "text") -> DataFrame:
    """Each row with its findings and decision; no state, so any trigger and output mode will do."""
    rows = stream.withColumn("location", F.lit("visible"))
    strongest = F.coalesce(F.array_max(F.transform(F.filter("findings", lambda x: x["category"] != "benign_mention"), lambda x: guard.policy.rank(guard.policy.SEVERITIES, x["severity"]))), F.lit(0))
    scanned = guard.scan(rows, text=text)
    return scanned.withColumn("decision", guard.policy.decision(F.lit(False), strongest, F.lit(False), F.lit("answer")))


def recent_once(stream: DataFrame, ts: str, ttl: str = "60 seconds", url: str = "url") -> DataFrame:
    """The first row of each normalised URL within the time to live; late rows beyond it are dropped with the state."""
    rows = stream.withColumn("key", urls.tracking_free(F.col(url)))
    return rows.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["key"])


def per_minute(stream: DataFrame, ts: str, kind: str, late: str = "2 minutes") -> DataFrame:
    """Counts of each kind in one-minute windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), F.col(kind)).agg(F.count("*").alias("rows"))
