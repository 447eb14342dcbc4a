"""What a recorded research run kept to: its budget of reads, searches and decisions, and how its reads were grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
BUDGET = {"read": 3, "search": 3, "decision": 3}
CONCURRENT, HEDGE_MS = 2, 10_000


def budget_use(trace: DataFrame, run: str = "run") -> DataFrame:
    """trace (run, kind, begin_ms, end_ms) -> a row per run: reads, searches, decisions, peak (reads at a time) and violations."""
    edges = trace.where("kind = 'read'").select(run, F.explode(F.array(F.struct(F.col("begin_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    # at equal times, what ends makes room for what begins
    active = F.sum("e.d").over(Window.partitionBy(run).orderBy("e.t", "e.d").rowsBetween(Window.unboundedPreceding, 0))
    peaks = edges.withColumn("active", active).groupBy(run).agg(F.max("active").alias("peak"))
    counts = trace.groupBy(run).agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in BUDGET])
    out = counts.join(peaks, run, "left").withColumn("peak", F.coalesce("peak", F.lit(0)))
    broken = [F.when(F.col(kind) > most, kind) for kind, most in BUDGET.items()] + [F.when(F.col("peak") > CONCURRENT, "concurrent")]
    return out.select(run, *BUDGET, "peak", F.array_compact(F.array(*broken)).alias("violations"))


def batches(reads: DataFrame, run: str = "run") -> DataFrame:
    """reads (run, begin_ms, end_ms, ok) that begin together are a batch -> run, batch, begin_ms, reads, reason.

    The first is initial. A later one is failed if no read was under way, hedge if the batch before began, and the last
    document came, at least HEDGE_MS earlier, and insufficient otherwise.
    """
    starts = reads.groupBy(run, "begin_ms").agg(F.count("*").alias("reads"))
    order = Window.partitionBy(run).orderBy("begin_ms")
    starts = starts.withColumn("batch", F.row_number().over(order)).withColumn("before", F.lag("begin_ms").over(order))
    past = reads.select(F.col(run).alias("p_run"), F.col("begin_ms").alias("p_begin"), F.col("end_ms").alias("p_end"), "ok")
    met = starts.join(past, (F.col(run) == F.col("p_run")) & (F.col("p_begin") < F.col("begin_ms")), "left")  # a run has few reads
    seen = met.groupBy(run, "batch", "begin_ms", "reads", "before").agg(
        F.count_if(F.col("p_end") > F.col("begin_ms")).alias("active"), F.max(F.when(F.col("ok") & (F.col("p_end") <= F.col("begin_ms")), F.col("p_end"))).alias("document")
    )
    since = F.col("begin_ms") - F.greatest(F.col("before"), F.col("document"))
    reason = F.when(F.col("before").isNull(), "initial").when(F.col("active") == 0, "failed").when(since >= HEDGE_MS, "hedge").otherwise("insufficient")
    return seen.select(run, "batch", "begin_ms", "reads", reason.alias("reason"))


def same_cohort(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The keys that only one of two runs has, with the side that has them; no rows if the cohorts are equal."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("baseline")).unionByName(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("candidate")))
