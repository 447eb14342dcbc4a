"""Hard negatives by bit-sliced integer products.

Rows lie in blocks whose integer components are cut into bit planes: x = least + sum of 2^k * plane_k. A row's score with
an anchor is then a weighted sum of products of planes, and the planes are taken from the most significant down. With
k planes left, each component's rest lies between 0 and 2^k - 1, so the score lies in an interval that halves with each
plane. A row is dropped once its interval cannot qualify any more: for positives, when its upper end is below the k-th
best lower end; for negatives, when it misses every score window of the anchor, or is surely worse than enough rows
that are surely inside. What is left after the last plane has its exact score. The first planes, whose
intervals are still wider than the scores are apart, are taken for many anchors at once.

Blocks of rows meet blocks of anchors of the same size, so each pair moves as much of the one as of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors
from .staging import Stage, clean

BLOCK_ROWS = 1 << 13
#: Scores that the leading planes hold at once.
SCORES = 1 << 20
MOST = (1 << 63) - 1
_BLOCK = "block long, width int, ids binary, labels binary, x binary"
_FOUND = "anchor_id long, positive_id long, vec_id long, positive_score long, score long"


class Sliced:
    """Integer rows as bit planes over their least component, the most significant first."""

    def __init__(self, rows: np.ndarray):
        self.n, self.width = rows.shape
        self.least = int(rows.min()) if rows.size else 0
        span = (int(rows.max()) - self.least) if rows.size else 0
        above = rows.astype(np.uint64) - np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)  # modulo 2^64, so never too large
        self.left = list(range(span.bit_length() - 1, -1, -1))  # planes left below each plane
        self.planes = [np.packbits((above >> np.uint64(k)) & np.uint64(1) > 0, axis=1) for k in self.left]
        self.most = max(abs(self.least), abs(self.least + (1 << span.bit_length())))

    def plane(self, at: int, rows: np.ndarray | slice, kind) -> np.ndarray:
        return np.unpackbits(self.planes[at][rows], axis=1, count=self.width).astype(kind)

    def exact(self, queries: np.ndarray) -> tuple[type, type]:
        """Types in which products of a plane, and whole scores, are exact."""
        per = max((abs(int(x)) for x in (queries.min(initial=0), queries.max(initial=0))), default=0) * max(1, self.width)
        whole = float if 2 * per * max(1, self.most) < 1 << 53 else object
        return (np.float32 if per < 1 << 24 else whole), whole


Judge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def survivors(sliced: Sliced, queries: np.ndarray, rows: np.ndarray, judges: list[Judge]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its rows (numbers out of rows) that its judge never dropped, with their exact scores.

    judges[i](lower, upper) says which rows may still qualify, given the ends of their scores' intervals.
    """
    small, kind = sliced.exact(queries)
    step = max(1, SCORES // max(1, len(rows)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step].astype(kind)
        below, above = np.minimum(q, 0).sum(1), np.maximum(q, 0).sum(1)
        scores = np.repeat((sliced.least * q.sum(1))[:, None], len(rows), 1)
        narrow, done = q.astype(small).T, 0
        while done < len(sliced.left):
            k = sliced.left[done]
            scores = scores + (1 << k) * (sliced.plane(done, rows, small) @ narrow).T.astype(kind)
            done += 1
            if len(rows) and ((1 << k) - 1) * (above - below).max() < (scores.max(1) - scores.min(1)).max():
                break  # from here on intervals may tell rows apart
        for i in range(len(q)):
            own, score, at = rows, scores[i], done
            while True:
                rest = (1 << sliced.left[at - 1]) - 1 if at else 0
                keep = judges[a + i](score + rest * below[i], score + rest * above[i])
                own, score = own[keep], score[keep]
                if at == len(sliced.left) or not len(own):
                    break
                score = score + (1 << sliced.left[at]) * (sliced.plane(at, own, small) @ q[i].astype(small)).astype(kind)
                at += 1
            yield a + i, own, score


def _kth(values: np.ndarray, k: int):
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def among_best(k: int) -> Judge:
    """Rows that may be among the k best."""

    def judge(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= _kth(lower, k) if len(lower) > k else np.ones(len(lower), bool)

    return judge


def among_best_within(windows: list[tuple[int, int]], k: int) -> Judge:
    """Rows that may be among the k best of those whose scores lie in one of the windows (ends included)."""
    windows = [w for w in dict.fromkeys(windows) if w[0] <= w[1]]

    def judge(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lower), bool)
        for low, high in windows:
            may = (upper >= low) & (lower <= high)
            sure = lower[may & (lower >= low) & (upper <= high)]
            out |= may & (upper >= _kth(sure, k)) if len(sure) >= k else may
        return out

    return judge


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _clamped(score) -> int:
    return max(-MOST - 1, min(MOST, int(score)))


def _rows_of(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(block["ids"], np.int64)
    return ids, np.frombuffer(block["labels"], np.int64), np.frombuffer(block["x"], np.int64).reshape(len(ids), block["width"])


def _positives(k: int):
    """Each anchor's k best rows of its own label in a block of rows."""

    def one(rows: dict, anchors: dict) -> list:
        (ids, labels, x), (q_ids, q_labels, q) = _rows_of(rows), _rows_of(anchors)
        sliced, found = Sliced(x), []
        for label in np.intersect1d(labels, q_labels):
            own, asked = np.flatnonzero(labels == label), np.flatnonzero(q_labels == label)
            # one more than k, as an anchor may be a row of the block itself
            for i, at, score in survivors(sliced, q[asked], own, [among_best(k + 1)] * len(asked)):
                anchor = q_ids[asked[i]]
                other = ids[at] != anchor
                at, score = at[other], score[other]
                found += [(anchor, ids[at[j]], ids[at[j]], _clamped(score[j]), _clamped(score[j])) for j in _best(score, ids[at], k)]
        return found

    return one


def _negatives(k: int, low: int, high: int):
    """For each anchor and positive, the k best rows of other labels in a block whose scores lie in the window."""

    def one(rows: dict, anchors: dict) -> list:
        (ids, labels, x), (q_ids, q_labels, q) = _rows_of(rows), _rows_of(anchors)
        pairs = [list(zip(np.frombuffer(p, np.int64).tolist(), np.frombuffer(s, np.int64).tolist(), strict=True)) for p, s in zip(anchors["positive_ids"], anchors["positive_scores"], strict=True)]
        sliced, found = Sliced(x), []
        for label in np.unique(q_labels):
            others, asked = np.flatnonzero(labels != label), np.flatnonzero(q_labels == label)
            windows = [[(-(-low * s // 100), high * s // 100) for _, s in pairs[i]] for i in asked]
            for i, at, score in survivors(sliced, q[asked], others, [among_best_within(w, k) for w in windows]):
                for (positive, s), (least, most) in zip(pairs[asked[i]], windows[i], strict=True):
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    found += [(q_ids[asked[i]], positive, ids[at[inside[j]]], s, _clamped(score[inside[j]])) for j in _best(score[inside], ids[at[inside]], k)]
        return found

    return one


def _meeting(one: Callable[[dict, dict], list]):
    names = [f.split(" ")[0] for f in _FOUND.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                yield pd.DataFrame(one(r["r"], r["a"]), columns=names).astype("int64")

    return run


def usable(embeddings: DataFrame, factor: int) -> DataFrame:
    """vec_id, label and floor(factor * component) of the rows that take part, one for each vec_id (the least)."""
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = clean(embeddings, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", F.transform("v", lambda x: F.floor(x * factor).cast("long")).alias("x"))).alias("r")).select("vec_id", "r.label", "r.x")


def _blocks(rows: DataFrame, n: int, more: str = "") -> DataFrame:
    """Rows (vec_id, label, x and arrays of longs) dealt over n blocks of packed numbers, by vector length."""
    extra = [c.split(" ")[0] for c in more.split(", ") if c]

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        raw = lambda values: np.asarray(values, np.int64).tobytes()
        row = [int(frame["block"].iloc[0]), int(frame["width"].iloc[0]), raw(frame["vec_id"]), raw(frame["label"]), raw(vectors.stacked(frame["x"]))]
        return pd.DataFrame([row + [[raw(v) for v in frame[c]] for c in extra]], columns=["block", "width", "ids", "labels", "x", *extra])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")).withColumn("width", F.size("x"))
    return dealt.groupBy("block", "width").applyInPandas(packed, _BLOCK + (", " + more if more else ""))


def _meet(stage: Stage, rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], one: Callable[[dict, dict], list]) -> DataFrame:
    """What one finds in each pair of a block of rows and a block of anchors.

    Both sides are dealt by the whole key of the join and meet by sorting. Spark judges a side by the staged files, and not by the
    copies made for the other side's blocks, so without the hint it would send all copies of the anchors through the driver.
    """
    tasks = min(4 * sizes[0] * sizes[1], 20_000)
    each = lambda df, name, other, n: df.select(F.struct(*df.columns).alias(name), F.col("width").alias(f"{name}_w"), F.col("block").alias(f"{name}_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(f"{name}_{other}"))
    r = each(rows, "r", "other", sizes[1]).repartition(tasks, "r_k", "r_other", "r_w")
    a = each(anchors, "a", "other", sizes[0]).repartition(tasks, "a_other", "a_k", "a_w")
    pairs = r.join(a.hint("merge"), (F.col("r_k") == F.col("a_other")) & (F.col("r_other") == F.col("a_k")) & (F.col("r_w") == F.col("a_w"))).select("r", "a")
    return pairs.mapInPandas(_meeting(one), _FOUND)


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, factor: int = 256, low: int = 50, high: int = 95) -> DataFrame:
    """For each row that the condition anchors (on vec_id) picks, and each of its positives, the hardest negatives.

    Positives are an anchor's highest-scoring other rows of the same label, negatives the highest-scoring rows of other labels
    with low * positive's score <= 100 * score <= high * positive's score; fewer where there are fewer. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score. Ties go to the smaller vec_id. Null vec_ids
    or labels, and vectors that are null or hold null or non-finite components, take no part; vectors of different
    lengths do not meet. Rows that repeat a vec_id count once, with the least label and vector. Components and scores
    beyond the range of a long are clamped to it. An empty table gives no rows.
    """
    stage = Stage(embeddings.sparkSession, "hard-negatives")
    rows = stage.put(usable(embeddings, factor), "rows")
    asked = rows.where(anchors)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(anchors, 1)).alias("a")).first()
    sizes = -(-counts["n"] // BLOCK_ROWS) or 1, -(-counts["a"] // BLOCK_ROWS) or 1
    blocks = stage.put(_blocks(rows, sizes[0]), "blocks")
    near = _meet(stage, blocks, stage.put(_blocks(asked, sizes[1]), "anchors"), sizes, _positives(positives))
    best = _ranked(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p"))
    known = asked.join(best, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", F.col("p.positive_id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    hunted = stage.put(_blocks(known, sizes[1], "positive_ids array<binary>, positive_scores array<binary>"), "hunted")
    found = _ranked(_meet(stage, blocks, hunted, sizes, _negatives(negatives, low, high)), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each 50th row, with every seventh row's label moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
o AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT o.anchor_id, o.positive_id, CAST(row_number() OVER (PARTITION BY o.anchor_id, o.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, o.positive_score, s.score AS negative_score
  FROM o JOIN s ON s.anchor_id = o.anchor_id WHERE o.k <= 5 AND NOT s.same AND 50 * o.positive_score <= 100 * s.score AND 100 * s.score <= 95 * o.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
