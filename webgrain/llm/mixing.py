"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in each source. Where a source's target is above its size, whole copies come
first; the rest of the budget takes the same share of every length, then more of the longest that still fit, and the
last words by bounded-knapsack dynamic programming over the lengths left. Which documents of a length are
taken is decided by a seeded hash. The plan is made from counts, one row for each source and length; documents are
never gathered, and those of one length are ranked in slices of their hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import Stage, unused

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
#: Words that the dynamic programming may still have to fit.
KNAPSACK = 1 << 14
SLICE = 20_000  # documents of one source, length and slice of the hash, about


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE_PERCENT / 100, most: float = MOST_EPOCHS) -> dict:
    """Source -> target. Sources by code point, null last; what is above most times a source's size is reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, out, budget = dict(weight), {}, share * sum(size.values())
    while left:
        total = sum(left.values())
        full = [s for s, w in left.items() if budget * w / total > most * size[s]]
        if not full:
            out |= {s: budget * w / total for s, w in left.items()}
            break
        for s in full:
            out[s] = float(most * size[s])
            del left[s]
        budget -= sum(out[s] for s in full)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most counts, so that their sum comes as near below budget as it can."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0:
        return take
    share = max(0.0, (budget - KNAPSACK) / total)
    take = np.minimum(counts, np.floor(counts * share).astype(np.int64))
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= KNAPSACK:
            break
        more = min(int(counts[i] - take[i]), (left - KNAPSACK) // int(lengths[i]))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    # sums reachable with binary parts of each length, as bits of one integer
    items = []
    spare = max(0, left)
    for i in np.argsort(lengths, kind="stable"):
        n, step = min(int(counts[i] - take[i]), spare // int(lengths[i])), 1
        while n > 0:
            k = min(step, n)
            items.append((int(i), k, k * int(lengths[i])))
            n, step = n - k, step * 2
    mask, reach = (1 << (spare + 1)) - 1, [1]
    for _, _, w in items:
        reach.append((reach[-1] | reach[-1] << w) & mask)
        if reach[-1] >> spare & 1:
            break
    at = reach[-1].bit_length() - 1
    for j in range(len(reach) - 1, 0, -1):
        i, k, w = items[j - 1]
        if not reach[j - 1] >> at & 1:
            take[i] += k
            at -= w
    return take


def _plan(pdf):
    """One source's counts by length, with its target -> copies of every document, and how many get one more."""
    import pandas as pd

    pdf = pdf.sort_values("size").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    total, target = int((lengths * counts).sum()), float(pdf["target"].iat[0])
    copies = int(target // total) if total else 0
    words = lengths > 0
    more = np.zeros(len(lengths), np.int64)
    more[words] = fit(lengths[words], counts[words], int(round(target - copies * total)))
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "n": counts, "source_size": total, "target": target, "copies": copies, "more": more})


def _draws(slim: DataFrame, plan: DataFrame, stage: Stage) -> DataFrame:
    """slim (source, size, draw) with the plan -> staged (b_source, b_size, bound, at, ties).

    Of each source and length of which some documents, but not all, are taken: the last draw that is taken, how many
    rows have it, and how many of those are taken. Ranked within slices of the draw, so no source is one task's.
    """
    by = ["source", "size", "part"]
    met = slim.join(stage.small(plan).where("p_more > 0 AND p_more < p_n"), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    part = F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("p_n") / SLICE))
    drawn = stage.put(met.select("source", "size", F.col("p_more").alias("more"), "draw", part.alias("part")), "drawn")
    slices = drawn.groupBy(*by).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = stage.put(slices.select(*[F.col(c).alias(f"s_{c}") for c in by], "c", before.alias("before")), "slices")
    same = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("part") == F.col("s_part"))
    # only the slice in which the last draw falls is ranked
    edge = drawn.join(stage.small(slices), same).where("before < more AND more <= before + c")
    ordered = Window.partitionBy(*by).orderBy("draw")
    ranked = edge.select("source", "size", "draw", "more", (F.col("before") + F.row_number().over(ordered)).alias("rank"), (F.col("before") + F.rank().over(ordered) - 1).alias("below"), F.count("*").over(Window.partitionBy(*by, "draw")).alias("at"))
    last = ranked.where("rank = more")
    return stage.put(last.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("draw").alias("bound"), "at", (F.col("more") - F.col("below")).alias("ties")), "bounds")


def _ties_cut(met: DataFrame, some, stage: Stage) -> DataFrame:
    """met with extra for the first ties of the rows in some, of each source and length; ranked within the tasks that wrote them."""
    tied = stage.put(met.where(some).withColumn("row", F.monotonically_increasing_id()), "tied").withColumn("slice", F.shiftright("row", 33))
    by = ["b_source", "b_size", "slice"]
    slices = tied.groupBy(*by).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by[:2]).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = stage.put(slices.select(*[F.col(c).alias(f"{c}_s") for c in by], before.alias("before")), "slices")
    same = F.col("b_source").eqNullSafe(F.col("b_source_s")) & (F.col("b_size") == F.col("b_size_s")) & (F.col("slice") == F.col("slice_s"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    ranked = tied.join(stage.small(slices), same).withColumn("extra", rank <= F.col("ties"))
    return met.where(~some).select(*met.columns).union(ranked.select(*met.columns))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE_PERCENT / 100, most: int = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """docs with four more columns: __size (its words), __source_size, __target and __times (whole copies that the mix
    takes); a name that docs has already gets underscores at its end.

    A word is a run of bytes other than white space; a null text has none. Null is a source of its own, the last.
    Documents without words are never taken. Sources without words get a target of 0. The
    sources' sizes are collected, a row each; all else stays distributed. An empty table gives an empty one.
    Rows that repeat a doc_id, or have none, are documents of their own: the draw goes by the text too, and of rows with
    equal draws just as many are taken as the plan wants.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    added = unused(docs, "size", "source_size", "target", "times")
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, key = at["text"].cast("string"), at["source"].cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    draw = F.xxhash64(at["doc_id"], text, F.lit(seed))
    # the texts are read twice: here, and when the documents are taken
    slim = stage.put(plain.select(key.alias("source"), size.alias("size"), draw.alias("draw")), "sizes")
    counted = stage.put(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = [(r[0], int(r[1])) for r in counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    goals = spark.createDataFrame(list(targets(sizes, weights, share, most).items()), "goal_source string, target double")
    schema = "source string, size long, n long, source_size long, target double, copies long, more long"
    plan = counted.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    plan = plan.groupBy("source").applyInPandas(_plan, schema)
    plan = stage.put(plan.select(*[F.col(c).alias(f"p_{c}") for c in ("source", "size", "n", "source_size", "target", "copies", "more")]), "plan")
    bounds = _draws(slim, plan, stage)

    sized = plain.select("*", key.alias("source"), size.alias("size"), draw.alias("draw"))
    met = sized.join(stage.small(plan), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "left")
    met = met.join(stage.small(bounds), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")), "left")
    some = F.coalesce((F.col("draw") == F.col("bound")) & (F.col("ties") < F.col("at")), F.lit(False))
    met = met.withColumn("extra", (F.col("p_more") == F.col("p_n")) | (F.coalesce(F.col("draw") <= F.col("bound"), F.lit(False)) & ~some))
    if not bounds.where("ties < at").isEmpty():
        met = _ties_cut(met, some, stage)
    times = F.when(F.col("size") > 0, F.col("p_copies") + F.when(F.col("extra"), 1).otherwise(0)).otherwise(0)
    return met.select(*plain.columns, "size", "p_source_size", "p_target", times.cast("long").alias("times")).toDF(*docs.columns, *added)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands as often as the mix takes it, perhaps never."""
    out = mix(docs, **options)
    times = out.columns[-1]
    copies = F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    return out.where(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(unused(docs, "copy")[0])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__times")).alias("taken"))
