"""Best-fit decreasing packing of token sequences.

A segment tree indexed by remaining capacity finds the tightest open window. Overlong documents are first cut into
full windows. Each task packs groups of about a million tokens; the windows that stay open at the end of a group are
packed again with those of the other groups, as items of their filled length, so little padding is left even when
the input comes in many small partitions. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .staging import Stage, clean
from .tokens import END_ID, default_path, encoder, kept

WINDOW = 2048
GROUP_TOKENS = 1 << 20


class Capacities:
    """Open windows by remaining capacity; each node of the tree counts those below it."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at, count = self.leaves + capacity, self.count
        while at:
            count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least that capacity."""
        at, count = self.leaves + need, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.open[capacity].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each item, and the number of windows. Equal lengths keep their order; 0 < length <= window."""
    bins, offsets, tree, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if found := tree.take(need) if need < window else None:
            left, at = found
        else:
            left, at, made = window, made, made + 1
        bins[i], offsets[i] = at, window - left
        if left > need:
            tree.add(left - need, at)
    return bins, offsets, made


def _pack(path: str, end_id: int, window: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, groups = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, groups
            docs, starts, lengths, totals, ids = (np.concatenate(x) if k < 4 else [y for z in x for y in z] for k, x in enumerate(zip(*held, strict=True)))
            bins, offsets, made = best_fit_decreasing(lengths, window)
            fill = np.bincount(bins, lengths, made).astype(np.int64)
            held, size = [], 0
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "fill"]
            number = bins + (task << 40) + (groups << 24)
            groups += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=None if docs.dtype != object else np.array([d is None for d in docs])), *map(pa.array, (starts, lengths)), pa.array(ids, pa.binary()), *map(pa.array, (totals, number, offsets, fill[bins]))], names)

        for batch in (p for b in batches for p in tk.parts(b, 1 << 20)):
            flat, at = encoder(path).encode(*tk.buffers(batch.column("text")), end_id)
            total = np.diff(at)
            pieces = -(-total // window)
            doc = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, total[doc] - start)
            flat = flat.astype("<u4")
            begin = at[:-1][doc] + start
            ids = [flat[a : a + n].tobytes() for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            held.append((np.array(batch.column("doc_id").to_pylist(), object)[doc], start, length, total[doc], ids))
            size += int(total.sum())
            if size >= group_tokens:
                yield from flush()
        if held:
            yield from flush()

    return run


def _repack(window: int):
    """Open windows (sequence_id, fill) of one task's share -> where each lies in the window that it joins."""

    def run(parts):
        import pandas as pd

        held = []

        def flush():
            pdf = pd.concat(held)
            bins, offsets, made = best_fit_decreasing(pdf["fill"].to_numpy(), window)
            lead = np.full(made, -1, np.int64)
            np.maximum.at(lead, bins, np.where(offsets == 0, pdf["sequence_id"].to_numpy(), -1))
            return pd.DataFrame({"was": pdf["sequence_id"], "now": lead[bins], "base": offsets})

        for pdf in parts:
            held.append(pdf)
            if sum(map(len, held)) >= 200_000:
                yield flush()
                held = []
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """docs (doc_id, text; other columns are ignored) -> pieces of windows: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, a null one's none, and then end_id; so every row has a piece.
    Repeated rows and null doc_ids are documents of their own. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "packing")
    path = path or default_path()
    plain = clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, fill long"
    pieces = stage.put(plain.mapInArrow(tk.task(_pack(path, end_id, window, group_tokens), kept(path)), schema), "pieces")
    # each window has one piece at offset 0; those at a power of two need no padding
    loose = pieces.where(f"offset = 0 AND fill < {window} AND (fill & (fill - 1)) != 0").select("sequence_id", "fill")
    n = loose.count()
    moved = loose.repartition(max(1, -(-n // 200_000)), "sequence_id").sortWithinPartitions("sequence_id")
    moved = stage.put(moved.mapInPandas(_repack(window), "was long, now long, base long"), "moved")
    out = pieces.join(stage.small(moved), F.col("sequence_id") == F.col("was"), "left")
    return out.select("doc_id", "start", "length", "ids", "doc_tokens", F.coalesce("now", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
