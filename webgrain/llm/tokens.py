"""Whole texts to token ids with a public tokenizer, each distinct chunk encoded once per worker.

A chunk is a run without ASCII white space. The tokenizer file splits at white space and has no rule that crosses
it, so a text's ids are its chunks' ids joined (tests compare with plain encodes). Chunks of ASCII
and plain accented letters go to the same model already lower-cased and split, which the file's normaliser and
splitting rule would leave as they are; all others go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame

from . import textkernel as tk

END_ID = 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


U = np.uint64
#: Chunks that a worker remembers; beyond it, it starts anew. It bounds memory and changes no result.
REMEMBERED = 800_000
_SLOTS = 1 << 21
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: The splitting rule for which the shortcut holds.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Table:
    """Open addressing from 64-bit hashes to numbers, looked up by whole arrays."""

    def __init__(self):
        self.keys, self.values = np.zeros(_SLOTS, U), np.zeros(_SLOTS, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers, -1 if absent."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & U(_SLOTS - 1)).astype(np.int64)
        there = self.keys[slot]
        hit = there == hashes
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)
            there = self.keys[slot[left]]
            hit = there == hashes[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        """Distinct absent hashes get the numbers from first on."""
        left, slot = np.arange(len(hashes)), (hashes & U(_SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = hashes[left[free]]
            won = self.keys[slot[left]] == hashes[left]
            self.values[slot[left[won]]] = first + left[won]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)


class Encoder:
    def __init__(self, path: str):
        # a task has one core, and threads of the library's own would only take memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._stated = self._tokenizer.normalizer, self._tokenizer.pre_tokenizer
        self._plain = None
        stated = json.loads(self._tokenizer.to_str())
        rules = (stated.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if rules[0].get("pattern") == {"Regex": _RULE} and stated["model"].get("end_of_word_suffix") == "</w>":
            self._plain = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.is_end = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
            self.is_end[[v for k, v in self._tokenizer.get_vocab().items() if k.endswith("</w>")]] = True
        self.forget()

    @property
    def whole(self):
        """The tokenizer as its file states it."""
        self._tokenizer.normalizer, self._tokenizer.pre_tokenizer = self._stated
        return self._tokenizer

    @property
    def plain(self):
        """The same model for chunks that are split already; None if the file's rules are others."""
        if self._plain:
            self._tokenizer.normalizer, self._tokenizer.pre_tokenizer = self._plain
            return self._tokenizer
        return None

    def forget(self) -> None:
        self.table = _Table()
        self.pool, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def _append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(flat)] = flat
        self.sizes[self.known : self.known + len(sizes)] = sizes
        self.starts[self.known : self.known + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = self.used + len(flat), self.known + len(sizes)

    def _learn(self, chunks: list[bytes], hashes: np.ndarray) -> None:
        texts = [c.decode() for c in chunks]
        pieces: dict[str, int] = {}
        quick, counts, parts, slow = [], [], [], []
        for i, c in enumerate(texts):
            if self._plain and _PLAIN.fullmatch(c) and "<|" not in c:
                found = _PIECES.findall(c.lower())
                quick.append(i)
                counts.append(len(found))
                parts += [pieces.setdefault(p, len(pieces)) for p in found]
            else:
                slow.append(i)
        order, flats, sizes = [], [], []
        if pieces:
            names = list(pieces)
            joined = [" ".join(names[k : k + 256]) for k in range(0, len(names), 256)]
            plain = self.plain
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in plain.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(names):
                begin, part = np.concatenate([[0], ends[:-1]]), np.array(parts)
                length = (ends - begin)[part]
                flats.append(ids[np.repeat(begin[part] - (np.cumsum(length) - length), length) + np.arange(length.sum())])
                sizes.append(np.add.reduceat(length, np.cumsum(counts) - counts))
                order += quick
            else:
                slow += quick
        whole = self.whole
        for k in range(0, len(slow), 4096):
            got = [e.ids for e in whole.encode_batch_fast([texts[i] for i in slow[k : k + 4096]], add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in got], np.int64))
            flats.append(np.array([t for x in got for t in x], np.uint32))
            order += slow[k : k + 4096]
        self.table.add(hashes[order], self.known)
        self._append(np.concatenate(flats), np.concatenate(sizes))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[offsets[i]:offsets[i + 1]], each followed by end_id, and where each text's begin."""
        hashes, start, end, first = tk.words(data, offsets)
        if self.known > REMEMBERED:
            self.forget()
        codes = self.table.find(hashes)
        if len(absent := np.flatnonzero(codes < 0)):
            fresh, at = np.unique(hashes[absent], return_index=True)
            if self.known + len(fresh) > _SLOTS // 2:
                if not self.known:  # more distinct chunks than the table holds
                    return self._long(data, offsets, end_id)
                self.forget()
                return self.encode(data, offsets, end_id)
            at = absent[at]
            self._learn([data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], fresh)
            codes[absent] = self.table.find(hashes[absent])
        return self._join(codes, first, end_id)

    def _long(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Straight through the tokenizer."""
        got = self.whole.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
        ids = [np.array([*e.ids, *([] if end_id is None else [end_id])], np.uint32) for e in got]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def _join(self, codes: np.ndarray, first: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = total[first]
        shift = np.repeat(self.starts[codes] - total[:-1], sizes)
        ids = self.pool[shift + np.arange(total[-1])]
        if end_id is not None:
            ids = np.insert(ids, at[1:], end_id).astype(np.uint32)
            at = at + np.arange(len(at))
        return ids, at


def kept(path: str) -> str:
    return f"encoder {path}"


def encoder(path: str) -> Encoder:
    """One per worker process and file, until a task of another kind runs there."""
    if kept(path) not in tk.KEPT:
        tk.KEPT[kept(path)] = Encoder(path)
    return tk.KEPT[kept(path)]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of an input's size; it only picks numbers of tasks and sizes of sketches."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 55 else 1 << 28  # beyond: unknown
