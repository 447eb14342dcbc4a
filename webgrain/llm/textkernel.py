"""Vectorised words, word hashes and shingles over Arrow text buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the same on UTF-8 bytes as on code
points. Word hashes have 64 bits, mixed from eight bytes at a time; two different words share one with a probability of
about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that one pass of the kernel covers, unless one word is longer; it bounds the temporary arrays.
SEGMENT = 1 << 20
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


#: What a Python worker keeps between tasks. Workers are reused, so a task drops what others have left.
KEPT: dict[str, object] = {}


def settle(keep: str = "") -> None:
    """Drops all kept state but one entry, and gives freed memory back to the system."""
    for name in [k for k in KEPT if k != keep]:
        del KEPT[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable, keep: str = "") -> Callable:
    """run, a function over a task's batches, with memory settled before and after it."""

    def wrapped(batches):
        settle(keep)
        try:
            yield from run(batches)
        finally:
            settle(keep)

    return wrapped


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h + U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _segment(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of data; a word also ends before each place in breaks."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SEP[data]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[breaks] = True
    before = np.empty(n + 1, bool)
    before[1:] = word
    before[0] = False
    start = np.flatnonzero(word & (cut[:-1] | ~before[:-1]))
    if not len(start):
        return np.zeros(0, U), start, start
    after = np.empty(n, bool)
    after[:-1] = word[1:]
    after[-1] = False
    end = np.flatnonzero(word & (cut[1:] | ~after)) + 1
    return _hash(data, start, end), start, end


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start[i]:end[i]], by eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    size = end - start
    out = mix((lanes[start] & _HEAD[np.minimum(size, 8)]) ^ (size.astype(U) * U(BASE)))
    todo, done = np.flatnonzero(size > 8), 8
    while len(todo):
        lane = lanes[start[todo] + done] & _HEAD[np.minimum(size[todo] - done, 8)]
        out[todo] = mix(out[todo] * U(BASE) + lane, 3)
        done += 8
        todo = todo[size[todo] > done]
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of all words of the texts, and the first word's number of each text."""
    if lower:
        data = LOWER[data]
    found, starts, ends, at, end = [], [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + SEGMENT, end)
        if to < end:
            k = np.searchsorted(offsets, to, "right") - 1
            if int(offsets[k]) > at:
                to = int(offsets[k])
            else:  # inside a text: to the next white space
                stop = int(offsets[k + 1])
                while to < stop and not SEP[data[to]]:
                    gap = np.flatnonzero(SEP[data[to : min(to + 4096, stop)]])
                    to += int(gap[0]) if len(gap) else min(4096, stop - to)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        h, s, e = _segment(data[at:to], inside)
        found.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(found), start, np.concatenate(ends), np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i + 1]], and the first word's number of each text."""
    found, _, _, first = words(data, offsets, lower)
    return found, first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def parts(batch: pa.RecordBatch, most: int = 8 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about that many bytes at most, one row at least."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_K = mix(np.arange(1, 65, dtype=U), 11) | U(1)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += hashes[j : j + n] * _K[j]
    return mix(total, seed + k)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of a text's word hashes; with fewer words, the sequence as one."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(k, len(hashes)), 100))
