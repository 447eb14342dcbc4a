"""Token ids in files: a wavelet matrix per shard.

A shard holds the ids of consecutive documents in ascending doc_id order. Its ids are renumbered by falling count,
so few bit planes are needed and the upper ones are mostly zero. Each plane lies in the file as blocks of BLOCK bits,
each compressed by itself, with the number of ones before each block. So rank and select inflate one block of a plane,
and a shard answers access (the token at a place), count (of a token before a place) and locate (the j-th place of
a token) from one file, reading the index and a block for each plane.

File: magic, the number of index parts and their lengths as unsigned 64-bit, the index parts (document ids and
their null flags, tokens of each document, the shard's vocabulary, zeros of each plane, ones before each block, lengths
of the blocks; each zstd-compressed), and the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as tk
from .staging import Stage, clean
from .tokens import END_ID, default_path, encoder, input_bytes, kept

MAGIC = b"WGWM0002"
SHARD_TOKENS = 2 << 20
BLOCK = 1 << 18  # bits of a block
PARTS, PART_BYTES = (12, 20_000), 23  # least and most parts of a table, and bits of a part's bytes of Parquet


class Plane:
    """n bits in blocks: ones has the ones before each block and in all, load(k) gives the k-th block's bytes."""

    def __init__(self, n: int, ones: np.ndarray, load: Callable[[int], np.ndarray]):
        self.n, self.ones, self.load = n, ones, load
        self.before = {1: ones, 0: np.minimum(np.arange(len(ones)) * BLOCK, n) - ones}
        self._now, self._held = -1, np.zeros(0, np.uint8)

    def block(self, k: int) -> np.ndarray:
        if k != self._now:
            self._now, self._held = k, self.load(k)
        return self._held

    def bit(self, at: int) -> int:
        return int(self.block(at // BLOCK)[at % BLOCK >> 3] >> (at & 7)) & 1

    def rank(self, at: int) -> int:
        """Ones before place at."""
        k, inside = divmod(at, BLOCK)
        if not inside:
            return int(self.ones[k])
        held = self.block(k)
        tail = (int(held[inside >> 3]) & ((1 << (inside & 7)) - 1)).bit_count() if inside & 7 else 0
        return int(self.ones[k]) + int(np.bitwise_count(held[: inside >> 3]).sum(dtype=np.int64)) + tail

    def select(self, bit: int, j: int) -> int:
        """Place of the j-th (from 0) one or zero."""
        k = int(np.searchsorted(self.before[bit], j, "right")) - 1
        bits = np.unpackbits(self.block(k), count=min(BLOCK, self.n - k * BLOCK), bitorder="little")
        return k * BLOCK + int(np.flatnonzero(bits == bit)[j - int(self.before[bit][k])])

    def bits(self) -> np.ndarray:
        blocks = [self.load(k) for k in range(len(self.ones) - 1)]
        return np.unpackbits(np.concatenate(blocks) if blocks else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """Bit planes from the highest bit down; below each plane, the zeros' tokens come before the ones'."""

    def __init__(self, n: int, planes: list[Plane], zeros: np.ndarray):
        self.n, self.planes, self.zeros = n, planes, zeros

    @staticmethod
    def build(values: np.ndarray, levels: int) -> Iterator[np.ndarray]:
        """The bits of each plane, from the highest down."""
        for k in range(levels):
            bits = (values >> (levels - 1 - k)) & 1 > 0
            yield bits
            values = np.concatenate([values[~bits], values[bits]])

    def values(self) -> np.ndarray:
        """All values, from the lowest plane up."""
        out = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for k in range(len(self.planes) - 1, -1, -1):
            bits = self.planes[k].bits()
            above = np.empty_like(out)
            above[~bits] = out[: self.zeros[k]]
            above[bits] = out[self.zeros[k] :] | out.dtype.type(1 << (len(self.planes) - 1 - k))
            out = above
        return out

    def access(self, at: int) -> int:
        out = 0
        for k, plane in enumerate(self.planes):
            ones = plane.rank(at)
            if plane.bit(at):
                out, at = 2 * out + 1, int(self.zeros[k]) + ones
            else:
                out, at = 2 * out, at - ones
        return out

    def _stretch(self, value: int, at: int) -> tuple[int, int]:
        """Where the occurrences of value before place at lie below the lowest plane."""
        first = 0
        for k, plane in enumerate(self.planes):
            a, b = plane.rank(first), plane.rank(at)
            if value >> (len(self.planes) - 1 - k) & 1:
                first, at = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                first, at = first - a, at - b
        return first, at

    def count(self, value: int, at: int) -> int:
        """Occurrences of value before place at."""
        a, b = self._stretch(value, at)
        return b - a

    def locate(self, value: int, j: int) -> int:
        """Place of the j-th occurrence (from 0) of value, or -1: select, from the lowest plane up."""
        first, end = self._stretch(value, self.n)
        if not 0 <= j < end - first:
            return -1
        at = first + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = self.planes[k].select(bit, at - int(self.zeros[k]) * bit)
        return at


class TokenShard:
    """Documents' ids in one file."""

    def __init__(self, docs: list[int | None], counts: np.ndarray, vocabulary: np.ndarray, matrix: WaveletMatrix):
        self.docs, self.counts, self.vocabulary, self.matrix = docs, counts, vocabulary, matrix
        self.begins = np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def write(docs: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
        """The file of a shard."""
        seen = np.bincount(ids)
        present = np.flatnonzero(seen)
        vocabulary = present[np.argsort(-seen[present], kind="stable")].astype(np.uint32)
        number = np.zeros(len(seen), np.uint32)
        number[vocabulary] = np.arange(len(vocabulary))
        levels = max(1, int(len(vocabulary) - 1).bit_length())
        zeros, ones, blocks = [], [], []
        for bits in WaveletMatrix.build(number[ids].astype(np.uint16 if levels <= 16 else np.uint32), levels):
            zeros.append(len(bits) - int(bits.sum()))
            ends = np.arange(0, len(bits), BLOCK)
            ones += [0, *np.cumsum(np.add.reduceat(bits, ends, dtype=np.int64) if len(ends) else []).tolist()]
            packed = np.packbits(bits, bitorder="little")
            blocks += [pa.compress(packed[a // 8 : (a + BLOCK) // 8].tobytes(), "zstd", asbytes=True) for a in ends.tolist()]
        index = [np.array([0 if d is None else d for d in docs], "<i8"), np.array([d is None for d in docs], np.uint8), counts.astype("<i8"), vocabulary.astype("<u4")]
        index += [np.array(zeros, "<i8"), np.array(ones, "<i8"), np.array([len(x) for x in blocks], "<i8")]
        packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in index]
        head = struct.pack(f"<{1 + 2 * len(index)}Q", len(index), *[x.nbytes for x in index], *map(len, packed))
        return b"".join([MAGIC, head, *packed, *blocks])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> TokenShard:
        """A shard whose file is read by read(offset, length): the index now, blocks when they are asked for."""
        if read(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<Q", read(8, 8))
        sizes = struct.unpack(f"<{2 * n}Q", read(16, 16 * n))
        at, parts = 16 + 16 * n, []
        for size, packed in zip(sizes[:n], sizes[n:], strict=True):
            parts.append(pa.decompress(read(at, packed), size, "zstd", asbytes=True) if size else b"")
            at += packed
        docs, null, counts, vocabulary, zeros, ones, lengths = (np.frombuffer(x, kind) for x, kind in zip(parts, ("<i8", "u1", "<i8", "<u4", "<i8", "<i8", "<i8"), strict=True))
        total = int(counts.sum())
        per = -(-total // BLOCK)
        offsets = at + np.concatenate([[0], np.cumsum(lengths)])

        def plane(k: int) -> Plane:
            def load(block: int) -> np.ndarray:
                i = k * per + block
                bits = min(BLOCK, total - block * BLOCK)
                return np.frombuffer(pa.decompress(read(int(offsets[i]), int(lengths[i])), -(-bits // 8), "zstd", asbytes=True), np.uint8)

            return Plane(total, ones[k * (per + 1) : (k + 1) * (per + 1)], load)

        names = [None if gone else d for d, gone in zip(docs.tolist(), null.tolist(), strict=True)]
        return cls(names, counts, vocabulary, WaveletMatrix(total, [plane(k) for k in range(len(zeros))], zeros))

    @classmethod
    def from_bytes(cls, raw: bytes) -> TokenShard:
        return cls.open(lambda at, n: raw[at : at + n])

    def ids(self) -> np.ndarray:
        return self.vocabulary[self.matrix.values()] if self.matrix.n else np.zeros(0, np.uint32)

    def _number(self, token: int) -> int:
        at = np.flatnonzero(self.vocabulary == token)
        return int(at[0]) if len(at) else -1

    def token(self, doc: int, at: int) -> int:
        """The token at a place of the shard's doc-th document."""
        return int(self.vocabulary[self.matrix.access(int(self.begins[doc]) + at)])

    def count(self, token: int) -> int:
        k = self._number(token)
        return 0 if k < 0 else self.matrix.count(k, self.matrix.n)

    def locate(self, token: int, j: int) -> tuple[int, int] | None:
        """Document number and place of the token's j-th occurrence."""
        k = self._number(token)
        at = -1 if k < 0 else self.matrix.locate(k, j)
        if at < 0:
            return None
        doc = int(np.searchsorted(self.begins, at, "right")) - 1
        return doc, at - int(self.begins[doc])


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, docs, counts, held, size, made = TaskContext.get().partitionId(), [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, held, size, made
            file = TokenShard.write(docs, np.concatenate(counts), np.concatenate(held))
            row = [[task], [made], [len(docs)], [size], [file]]
            docs, counts, held, size, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(row)], ["part", "shard", "n_docs", "n_tokens", "file"])

        for batch in (p for b in batches for p in tk.parts(b, 2 << 20)):
            ids, at = encoder(path).encode(*tk.buffers(batch.column("text")), end_id)
            docs += batch.column("doc_id").to_pylist()
            counts.append(np.diff(at))
            held.append(ids)
            size += len(ids)
            if size >= shard_tokens:
                yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, stage: Stage, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes docs (doc_id, text; others ignored) in ascending doc_id order, a row per shard: part, shard, n_docs,
    n_tokens, file (the shard's bytes). The rows are Parquet files in the shared folder, so any store that Spark
    reaches can hold them; (part, shard) is the documents' order.

    A null text has no ids but the end's. A null doc_id comes first. Rows that repeat a doc_id are ordered by a hash of
    their texts, so that they need not meet in one task.
    """
    plain = clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    path = path or default_path()
    n = min(max(PARTS[0], input_bytes(docs) >> PART_BYTES), PARTS[1])
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = plain.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return stage.put(dealt.mapInArrow(tk.task(_write(path, end_id, shard_tokens), kept(path)), "part long, shard long, n_docs long, n_tokens long, file binary"), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file")), strict=True):
            found = TokenShard.from_bytes(raw)
            ids = found.ids().astype("<u4")
            spans = zip(found.begins[:-1].tolist(), found.begins[1:].tolist(), strict=True)
            crcs = [zlib.crc32(ids[a:b]) for a, b in spans]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.full(n, shard)), pa.array(found.docs, pa.int64()), pa.array(found.begins[:-1]), pa.array(found.counts), pa.array(crcs, pa.int64())],
                ["part", "shard", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame, stage: Stage) -> DataFrame:
    """Each document of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # shards before this one: within its part, and then parts; the second window has a row per part, PARTS at most
    sizes = shards.select("part", "shard", "n_tokens")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    totals = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    starts = sizes.join(totals, F.col("part") == F.col("p")).select(F.col("part").alias("at_part"), F.col("shard").alias("at_shard"), (F.col("before") + F.col("parts_before")).alias("first"))
    starts = stage.put(starts, "starts")
    docs = shards.select("part", "shard", "file").mapInArrow(tk.task(_read), "part long, shard long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    out = docs.join(stage.small(starts), (F.col("part") == F.col("at_part")) & (F.col("shard") == F.col("at_shard")))
    return out.select("doc_id", (F.col("begin") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "token-files")
    return read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), stage), stage)
