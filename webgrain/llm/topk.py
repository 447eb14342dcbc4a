"""Exact top-k by inner product with MaxScore.

A query's terms are its components; a term's postings in a shard are the rows' values of that component. In each shard
a term's contribution lies between two bounds, so the terms are ordered by the width of theirs: the essential terms
are those whose remaining widths could still lift a row over the threshold. Their postings are traversed for all rows
of a block; the other terms are probed, the widest first, only for the rows that are still competitive. Rows lie in
blocks with bounds of their own, and a block whose bound is below the threshold is skipped. Thresholds start from a
bounded sample of the rows, which makes them lower than or equal to the true ones, so nothing is lost. Shards give
their k best for each query, and those are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .staging import Stage, clean

SHARD_ROWS = 1 << 14
QUERY_ROWS = 1 << 11
PILOT_ROWS = 1 << 12  # of the sample that gives the first thresholds
BLOCK_ROWS = 1 << 11


def _exact(values: np.ndarray, queries: np.ndarray) -> np.dtype:
    """The fastest type whose sums of products are exact."""
    most = float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, values.shape[1])
    return np.dtype(float) if most < 2**53 else np.dtype(np.int64) if most < 2**63 else np.dtype(object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def essential(rest: np.ndarray, least: int | None) -> int:
    """How many of the ordered terms are essential: the fewest whose remaining bounds, rest, cannot reach the threshold."""
    short = np.flatnonzero(rest < least) if least is not None else ()
    return int(short[0]) if len(short) else len(rest) - 1


def maxscore(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score): each query's k best rows of one shard, but for rows below floor and the query's own."""
    kind = _exact(rows, queries)
    # blocks of rows that point the same way have narrower bounds
    order = np.lexsort((ids, np.abs(rows).argmax(1))) if rows.shape[1] else np.argsort(ids)
    ids, rows, queries = ids[order], rows[order].astype(kind), queries.astype(kind)
    blocks = [(rows[a : a + BLOCK_ROWS], ids[a : a + BLOCK_ROWS]) for a in range(0, len(rows), BLOCK_ROWS)]
    bounds = [(b.min(0), b.max(0)) for b, _ in blocks]
    out = []
    for q, query_id, least in zip(queries, query_ids.tolist(), floor.tolist(), strict=True):
        got_s, got_i = np.zeros(0, kind), np.zeros(0, np.int64)
        low = [np.minimum(q * a, q * b) for a, b in bounds]
        high = [np.maximum(q * a, q * b) for a, b in bounds]
        for j in sorted(range(len(blocks)), key=lambda j: -high[j].sum()):
            if least is not None and high[j].sum() < least:
                break
            block, own = blocks[j]
            terms = np.argsort(-(high[j] - low[j]).astype(float), kind="stable")
            rest = np.concatenate([np.cumsum(high[j][terms][::-1])[::-1], np.zeros(1, kind)])
            n = essential(rest, least)
            alive, score = np.arange(len(own)), block[:, terms[:n]] @ q[terms[:n]]
            while n < len(terms):
                keep = score + rest[n] >= least
                alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
                more = terms[n : n + 8]
                score = score + block[np.ix_(alive, more)] @ q[more]
                n += len(more)
            if least is not None:
                keep = score >= least
                alive, score = alive[keep], score[keep]
            keep = own[alive] != query_id
            got_s, got_i = np.concatenate([got_s, score[keep]]), np.concatenate([got_i, own[alive[keep]]])
            top = _best(got_s, got_i, k)
            got_s, got_i = got_s[top], got_i[top]
            if len(got_s) == k and (least is None or got_s[-1] > least):
                least = got_s[-1]
        out += [(query_id, i, int(s)) for i, s in zip(got_i.tolist(), got_s.tolist(), strict=True)]
    return out


def _frame(found):
    import pandas as pd

    most = (1 << 63) - 1
    return pd.DataFrame([(q, i, max(-most - 1, min(most, s))) for q, i, s in found], columns=["query_id", "vec_id", "score"]).astype("int64")


def _search(k: int):
    def run(rows, queries):
        found = []
        for n in sorted(set(queries["x"].map(len))):
            r, q = rows[rows["x"].map(len) == n], queries[queries["x"].map(len) == n]
            floor = q["floor"].astype(object).where(q["floor"].notna(), None).to_numpy()
            if len(r):
                found += maxscore(r["vec_id"].to_numpy(), vectors.stacked(r["x"]), q["vec_id"].to_numpy(), vectors.stacked(q["x"]), floor, k)
        return _frame(found)

    return run


def scaled(embeddings: DataFrame, factor: int) -> DataFrame:
    """vec_id and floor(factor * component) of the rows that take part, one for each vec_id (the least vector)."""

    usable = (F.col("v").isNotNull()) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = clean(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform("v", lambda x: F.floor(x * factor).cast("long")).alias("x"))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, factor: int = 1024) -> DataFrame:
    """The k rows of embeddings (vec_id, embedding) with the highest integer inner products with each query vector.

    Returns query_id, rank (from 1), vec_id, score; fewer than k if there are fewer candidates. Ties go to the smaller
    vec_id. A query is never its own candidate. Null vec_ids, and vectors that are null or hold null or non-finite
    components, take no part; vectors of different lengths do not meet. Rows that repeat a vec_id count once, with the
    least vector. Components beyond the range of a long are clamped to it, as scores are. Empty tables give no rows.
    """
    spark = embeddings.sparkSession
    stage = Stage(spark, "topk")
    schema = "query_id long, vec_id long, score long"
    rows = stage.put(scaled(embeddings, factor), "rows")
    asked = stage.put(scaled(queries, factor), "queries")
    n_rows, n_asked = rows.count(), asked.count()
    shards, parts = -(-n_rows // SHARD_ROWS) or 1, -(-n_asked // QUERY_ROWS) or 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(parts)))
    near = F.xxhash64("vec_id", F.lit(3)) / F.lit(2.0**64) + 0.5 < min(1.0, PILOT_ROWS / max(1, n_rows))
    pilot = rows.where(near).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    first = pilot.groupBy("part").cogroup(asked.withColumn("floor", F.lit(None).cast("long")).groupBy("part")).applyInPandas(_search(k), schema)
    floors = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("floor")).where(f"c >= {k}").select("query_id", "floor")
    floors = stage.put(floors, "floors")
    known = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "x", "part", "floor")
    known = known.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    dealt = rows.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).alias("r_shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("r_part"))
    best = dealt.groupBy("r_shard", "r_part").cogroup(known.groupBy("shard", "part")).applyInPandas(_search(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM q JOIN v ON v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
