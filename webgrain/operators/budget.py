"""Inspection budgets: which segments are read, and how many characters of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def marked_head_tail(df: DataFrame, doc: str, ordinal: str, most: int, name: str) -> DataFrame:
    """Adds name: whether a segment is among the first and last of its document, most in all, the odd one in front."""
    by = Window.partitionBy(doc)
    n, k = F.count("*").over(by), F.row_number().over(by.orderBy(ordinal))
    return df.withColumn("__n", n).withColumn("__k", k).withColumn(name, (F.col("__k") <= -(-most // 2)) | (F.col("__k") > F.col("__n") - most // 2)).drop("__n", "__k")


def head_tail_segments(df: DataFrame, doc: str, ordinal: str, most: int) -> DataFrame:
    """The first and last segments of each document, most in all, the odd one in front."""
    return marked_head_tail(df, doc, ordinal, most, "__some").where("__some").drop("__some")


def water_filled(df: DataFrame, doc: str, ordinal: str, length: str, budget: int | Column) -> DataFrame:
    """Adds allocation: the largest common quota that fits the budget, what is left over one by one from the front.

    In the order of their lengths, a segment is read whole if it and as much of every longer one fit; the others
    share the rest. So the quota needs no search, only a running sum.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    whole = Window.partitionBy(doc)
    rising = whole.orderBy(length, ordinal)
    size = F.col(length)
    df = df.withColumn("__total", F.sum(size).over(whole)).withColumn("__n", F.count("*").over(whole))
    df = df.withColumn("__before", F.coalesce(F.sum(size).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("__left", F.col("__n") - F.row_number().over(rising) + 1)
    full = F.col("__before") + F.col("__left") * size <= budget
    # the first segment that is not whole has the quota
    quota = F.max(F.when(~full, F.floor((budget - F.col("__before")) / F.col("__left")))).over(whole)
    df = df.withColumn("__quota", F.when(F.col("__total") <= budget, size).otherwise(quota))
    df = df.withColumn("__base", F.least(size, F.col("__quota"))).withColumn("__rest", budget - F.sum("__base").over(whole))
    short = F.col("__base") < size
    turn = F.sum(short.cast("int")).over(whole.orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    more = F.when(short & (F.col("__total") > budget) & (turn <= F.col("__rest")), 1).otherwise(0)
    return df.withColumn("allocation", (F.col("__base") + more).cast("long")).drop("__total", "__n", "__before", "__left", "__quota", "__base", "__rest")


def over_cap(requests: DataFrame, key: str, order: str, size: Column, cap: float) -> DataFrame:
    """Adds over_cap: whether the running total of a key's sizes has passed the cap."""
    running = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("over_cap", running > cap)


def wire_size(decoded: Column, encoded: Column) -> Column:
    """What a request counts: the larger of its sizes before and after decoding."""
    return F.greatest(F.coalesce(decoded, F.lit(0)), F.coalesce(encoded, F.lit(0)))


def accounted(events: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Network events (key, order, request, kind, decoded, encoded) of pages -> key, order, total, code: the event with which
    a page passes the cap, or that says something impossible; no row for a page that never does.

    kind: data adds to both sizes of its request; finished brings the encoded size to what it states, if that is more;
    failed ends a request without bytes. A request counts the larger of its sizes, and a page all of its requests, those
    that ended too; what comes after an end is a new request. Null or negative sizes are UPSTREAM_HTTP, the cap is
    RESPONSE_TOO_LARGE.
    """
    data, ended = F.col("kind") == "data", F.col("kind").isin("finished", "failed")
    of = Window.partitionBy(key, "request").orderBy(order)
    df = events.withColumn("__n", F.coalesce(F.sum(ended.cast("int")).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = Window.partitionBy(key, "request", "__n").orderBy(order)
    so_far, before = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(Window.unboundedPreceding, -1)
    size = lambda c: F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0))
    decoded = F.sum(F.when(data, size("decoded")).otherwise(0)).over(so_far)
    sent = F.coalesce(F.sum(F.when(data, size("encoded")).otherwise(0)).over(before), F.lit(0))
    encoded = F.when(data, sent + size("encoded")).when(F.col("kind") == "finished", F.greatest(sent, size("encoded"))).otherwise(sent)
    df = df.withColumn("__counted", wire_size(decoded, encoded))
    df = df.withColumn("__delta", F.col("__counted") - F.coalesce(F.lag("__counted").over(one), F.lit(0)))
    df = df.withColumn("__total", F.sum("__delta").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    bad = (F.col("kind") != "failed") & (F.col("encoded").isNull() | (F.col("encoded") < 0) | (data & (F.col("decoded").isNull() | (F.col("decoded") < 0))))
    over = df.where(bad | (F.col("__total") > cap))
    first = over.groupBy(key).agg(F.min_by(F.struct(F.col(order), (F.col("__total") - F.when(bad, F.col("__delta")).otherwise(0)).alias("total"), bad.alias("bad")), order).alias("x"))
    return first.select(key, F.col("x")[order].alias(order), F.col("x.total").alias("total"), F.when(F.col("x.bad"), "UPSTREAM_HTTP").otherwise("RESPONSE_TOO_LARGE").alias("code"))


def admitted(requests: DataFrame, key: str, order: str, running: int, queued: int) -> DataFrame:
    """Adds admission: run, queue, or RATE_LIMITED for what neither the slots nor the queue of a key can hold."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return requests.withColumn("admission", F.when(n <= running, "run").when(n <= running + queued, "queue").otherwise("RATE_LIMITED"))
