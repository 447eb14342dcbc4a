"""Substring dedup with a count-min prefilter.

A window is n consecutive words of one document. A word is removed if a window covers it whose word sequence
also starts in a document with a smaller doc_id.

1. One pass over the texts gives each document's fingerprint and, from each task, a count-min sketch. A window
   is counted under its minimiser (the smallest hash of its 5-word grams), which is shared by all windows that
   are equal, so the merged sketch never underestimates how often a window occurs, with a fifth of the insertions.
   Counters hold 0, 1 or "2 and more" as two bit planes, which merge by OR and AND.
2. Documents of at least n words with the same words as a smaller doc_id go whole and take no further part.
3. Only windows that the sketch estimates as repeated are emitted, under a 96-bit hash of their words. What repeats within
   a part of a task's texts is settled there: of each window only the rows of the part's smallest doc_id go on, so that a
   passage of very many documents brings its groups few rows; a text's other windows are one row with all their starts.
   One shuffle then brings equal windows together, each with the smallest doc_id of all. They go from the texts into it,
   and are written nowhere else.
4. A document's removed windows merge to spans, and a last pass over the texts takes them out.

The sketch has a fixed size, so a larger corpus lets more unrepeated windows through to step 3; none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkernel as tk
from .staging import Stage, clean, unused
from .tokens import input_bytes

U = np.uint64
GRAM = 5
SEGMENT_BITS = 1 << 22  # cells of one piece of the sketch
MIN_CELLS, MAX_CELLS = 1 << 22, 1 << 28  # of both rows; a cell has two bits


def cells_for(input_bytes: int) -> int:
    """Cells for an input of that many bytes of Parquet, a power of two within the bounds."""
    want = MIN_CELLS
    while want < MAX_CELLS and want < input_bytes // 2:
        want *= 2
    return want


def _minimisers(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and text number of each window, and its minimiser."""
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))
    if not len(text):
        return text, text, np.zeros(0, U)
    count = np.maximum(size - n + 1, 0)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][text]
    low = tk.windows(hashes, min(GRAM, n), 31)
    width, span = n - min(GRAM, n) + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return start, text, low[start]


def _cells(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    half = cells // 2
    return (tk.mix(keys, 41) & U(half - 1)).astype(np.int64), (tk.mix(keys, 42) & U(half - 1)).astype(np.int64) + half


class Sketch:
    """Two count-min rows of counters that stop at two: plane a has a bit for one or more, b for two or more."""

    def __init__(self, cells: int):
        self.a, self.b = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)

    @staticmethod
    def _set(plane: np.ndarray, cells: np.ndarray) -> None:
        if len(cells):
            byte = cells >> 3
            at = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            plane[byte[at]] |= np.bitwise_or.reduceat((1 << (cells & 7)).astype(np.uint8), at)

    def add(self, keys: np.ndarray) -> None:
        for cells in _cells(keys, len(self.a) * 8):
            cells.sort()
            new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
            once, again = cells[new], np.unique(cells[~new])
            self._set(self.b, again)
            self._set(self.b, once[(self.a[once >> 3] >> (once & 7).astype(np.uint8)) & 1 > 0])
            self._set(self.a, once)


def _scan(n: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "f1", "f2", "piece", "task", "a", "b"]
        sketch = None
        for batch in (p for b in batches for p in tk.parts(b)):
            hashes, first = tk.word_hashes(*tk.buffers(batch.column("text")))
            _, text, low = _minimisers(hashes, first, n)
            if len(low):
                sketch = sketch or Sketch(cells)
                sketch.add(low[np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])])])
            size = np.diff(first)
            place = (np.arange(len(hashes)) - np.repeat(first[:-1], size)).astype(U)
            sums = []
            for seed in (51, 52):
                # the two prefix sums of the hashes, mixed with their places
                total = np.concatenate([[U(0)], np.cumsum(tk.mix(hashes ^ (place * U(tk.BASE)), seed), dtype=U)])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            none = pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), none[0], none[0], none[1], none[1]], names)
        if sketch:
            task, step = TaskContext.get().partitionId(), min(SEGMENT_BITS // 8, len(sketch.a))
            for k in range(len(sketch.a) // step):
                a, b = sketch.a[k * step : (k + 1) * step], sketch.b[k * step : (k + 1) * step]
                if a.any():
                    planes = [pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (a, b)]
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k]), pa.array([task], pa.int64()), *planes], names)

    return run


def _merge(step: int):
    def run(pdf):
        import pandas as pd

        a, b = np.zeros(step, np.uint8), np.zeros(step, np.uint8)
        for x, y in zip(pdf["a"], pdf["b"], strict=True):
            x, y = (np.frombuffer(pa.decompress(z, step, "zstd", asbytes=True), np.uint8) for z in (x, y))
            b |= y | (a & x)
            a |= x
        return pd.DataFrame({"piece": [pdf["piece"].iat[0]], "a": [pa.compress(a.tobytes(), "zstd", asbytes=True)], "b": [pa.compress(b.tobytes(), "zstd", asbytes=True)]})

    return run


def merged(sketches: DataFrame, cells: int, fan: int = 64) -> DataFrame:
    """Pieces (piece, task, a, b) -> (piece, a, b), in two rounds so that no task reads every task's sketch."""
    step = min(SEGMENT_BITS, cells) // 8
    schema = "piece long, a binary, b binary"
    some = sketches.groupBy("piece", F.pmod("task", F.lit(fan))).applyInPandas(_merge(step), schema)
    return some.groupBy("piece").applyInPandas(_merge(step), schema)


def _repeats(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows also start in a document with a smaller id among these."""
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = ids[order] > least
    return out


def _emit(n: int, cells: int, shared):
    """Windows that the sketch estimates as repeated: two hashes of the words, the document and the start. Those that are known
    to repeat an earlier document's are a row for each text, with their starts and a hash of the document only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = None
        for batch in (p for b in batches for p in tk.parts(b)):
            if plane is None:
                step = min(SEGMENT_BITS, cells) // 8
                plane = np.zeros(cells // 8, np.uint8)
                for k, b in shared.value:
                    plane[k * step : (k + 1) * step] = np.frombuffer(pa.decompress(b, step, "zstd", asbytes=True), np.uint8)
            hashes, first = tk.word_hashes(*tk.buffers(batch.column("text")))
            start, text, low = _minimisers(hashes, first, n)
            if not len(low):
                continue
            live = np.ones(len(low), bool)
            for c in _cells(low, cells):
                live &= (plane[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
            start, text = start[live], text[live]
            if not len(start):
                continue
            one, two = tk.windows(hashes, n, 61)[start], tk.windows(hashes ^ U(tk.BASE), n, 62)[start]
            ids = np.asarray(batch.column("doc_id").fill_null(0))[text]
            one, two, at = one.view(np.int64), (two >> U(32)).astype(np.uint32).view(np.int32), (start - first[:-1][text]).astype(np.int32)
            known, names = _repeats(one, two, ids), ["w1", "w2", "doc", "pos", "known"]
            rest = [pa.array(x[~known]) for x in (one, two, ids, at)]
            yield pa.RecordBatch.from_arrays([*rest, pa.nulls(len(rest[0]), pa.list_(pa.int32()))], names)
            if known.any():
                of, at = text[known], at[known]
                begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                docs, none = ids[known][begin], pa.nulls(len(begin), pa.int32())
                starts = pa.ListArray.from_arrays(np.append(begin, len(of)).astype(np.int32), at)
                yield pa.RecordBatch.from_arrays([pa.array(tk.mix(docs.astype(np.int64).view(U), 63).view(np.int64)), none, pa.array(docs), none, starts], names)

    return run


def _spans(n: int):
    """Sorted starts of removed windows -> the spans of words that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column("at"):
                at = np.sort(at.values.to_numpy(zero_copy_only=False)).astype(np.int64)
                cut = np.flatnonzero(at[1:] > at[:-1] + n)
                out.append(np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + n], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.list_(pa.int64()))], ["gone_id", "spans"])

    return run


def _take_out(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in tk.parts(b)):
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                gone = 0
                if spans:
                    kept, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        b = len(words) if b < 0 else b
                        kept += words[at:a]
                        gone, at = gone + b - a, b
                    text = b" ".join(kept + words[at:]).decode()
                texts.append(text)
                n_removed.append(gone)
            made = {"text": pa.array(texts, pa.string()), "__n_words": pa.array(n_words, pa.int64()), "__n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


def remove_repeats(docs: DataFrame, n: int = 13) -> DataFrame:
    """docs with the words of repeated n-word windows taken out of text, and __n_words and __n_removed (with more
    underscores, if docs has such names).

    A text that loses words is the kept words joined by one space; any other is unchanged. Null and blank texts
    have no words. A text of fewer than n words has no window and keeps all. Rows with a null doc_id neither
    lose words nor make others lose any. Rows that repeat a doc_id keep each other's words.
    Where they have unlike texts, what is found in one is taken out of all at the same places, as the spans go by doc_id;
    beside a whole copy, a text of fewer than n words loses all. Columns other than
    doc_id and text pass through, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "substring")
    cells = cells_for(input_bytes(docs))
    plain = clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = stage.put(plain.mapInArrow(tk.task(_scan(n, cells)), "doc_id long, n_words long, f1 long, f2 long, piece long, task long, a binary, b binary"), "scan")
    sketch = merged(scanned.where("piece IS NOT NULL").select("piece", "task", "a", "b"), cells).select("piece", "b")
    # bounded by MAX_CELLS / 8 bytes, whatever the input
    shared = spark.sparkContext.broadcast([(r["piece"], bytes(r["b"])) for r in sketch.collect()])

    whole = scanned.where(f"piece IS NULL AND n_words >= {n} AND doc_id IS NOT NULL").select("doc_id", "n_words", "f1", "f2")
    of = ["n_words", "f1", "f2"]
    again = whole.groupBy(*of).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    again = stage.put(again, "again")
    copies = stage.put(whole.join(stage.small(again), of).where("doc_id > rep").select(F.col("doc_id").alias("copy")).distinct(), "copies")
    # a doc_id with several texts goes on as it is
    several = whole.groupBy(F.col("doc_id").alias("copy")).agg(F.count("*").alias("c")).where("c > 1").select("copy")
    copies = stage.put(copies.join(several, "copy", "left_anti"), "whole")
    stage.drop(scanned)

    first = plain.where("doc_id IS NOT NULL").join(stage.small(copies), F.col("doc_id") == F.col("copy"), "left_anti")
    found = first.mapInArrow(tk.task(_emit(n, cells, shared)), "w1 long, w2 int, doc long, pos int, known array<int>")
    least = found.withColumn("x", F.min("doc").over(Window.partitionBy("w1", "w2")))
    hits = least.where("known IS NOT NULL OR doc > x").select("doc", F.coalesce("known", F.array("pos")).alias("at"))
    starts = hits.groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("at"))
    spans = starts.mapInArrow(_spans(n), "gone_id long, spans array<long>")
    spans = stage.put(spans.union(copies.select("copy", F.array(F.lit(0).cast("long"), F.lit(-1).cast("long")))), "spans")

    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").cast("string").alias("text") if c == "text" else F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)])
    joined = plain.join(stage.small(spans), F.col(f"__c{names.index('doc_id')}") == F.col("gone_id"), "left").select(*plain.columns, F.col("spans").alias("__spans"))
    schema = T.StructType([*plain.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())])
    return joined.mapInArrow(tk.task(_take_out(schema.names)), schema).toDF(*names, *unused(docs, "n_words", "n_removed"))


def without_repeats(docs: DataFrame, n: int = 13) -> DataFrame:
    """docs, with the same columns, the repeated windows out of text; n_chars follows the text."""
    out = remove_repeats(docs, n)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    # an untouched text still has its own white space
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


_WS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP10_SQL = rf"""
WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM v),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM m WHERE f < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
o AS (SELECT t.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""
