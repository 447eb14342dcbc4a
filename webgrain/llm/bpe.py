"""Byte-level BPE from a public tokenizer's file: encoding by a trie of distinct words, and decoding.

The encoding of a word's prefix is the encoding of a shorter prefix and one more token, its last. So a prefix's whole
encoding is known from its last token and the prefix where that token begins. The distinct words of a batch are put
into a trie, whose nodes are prefixes, and the trie is walked depth first: each node takes the one token that ends
there and may follow the last token of the node where it begins. Prefixes that words share are encoded once. Two
tokens may follow one another if no merge crosses the border between them before both are whole.

Texts are cut into units, each at a space that follows another character than white space. No word of the file's
splitting rule crosses such a place, so a text's ids are its units' ids joined, and a worker remembers what it has
encoded (tests compare with the library's own encodes).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .staging import Stage, clean

#: Units that a worker remembers, beyond those of one part of a batch; it bounds memory and changes no result.
REMEMBERED = 600_000
#: Characters that are cut into units at once, unless there is no place to cut.
STEP = 1 << 20
#: Units that are looked up at once.
LOOKUP = 1 << 20
_CUT = re.compile(r"(?<=\S)(?= )")  # Python's white space holds all that the splitting rule takes for such
_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_NEVER = 1 << 62
#: Lengths that a token may have that ends as no longer one does.
SHORT = (2, 1)
#: Pairs of tokens that a worker remembers.
PAIRS = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_names() -> list[str]:
    """The character that stands for each byte in the file: printable ones for themselves, the others by number from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def segments(text: str, most: int = STEP) -> Iterator[str]:
    """A text in pieces of about most characters, cut between units."""
    at = 0
    while len(text) - at > most and (found := _CUT.search(text, at + most)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class ByteVocabulary:
    """What a tokenizer's file, byte-level BPE only, says of its tokens. special: whether the strings of its added tokens are
    tokens in a text."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model, split = stated["model"], stated["pre_tokenizer"]
        added = stated["added_tokens"]
        plain = not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges") or stated["normalizer"])
        own = split["type"] == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
        if model["type"] != "BPE" or not plain or not own or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a plain byte-level BPE file")
        number = {c: b for b, c in enumerate(byte_names())}
        self.size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.pieces = [b""] * self.size
        for t, i in model["vocab"].items():
            self.pieces[i] = bytes(number[c] for c in t)
        self._read(model, number)
        self.special = {t["content"]: t["id"] for t in added} if special else {}
        self._between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for t in added:
            self.pieces[t["id"]] = bytes(number[c] for c in t["content"]) if all(c in number for c in t["content"]) else t["content"].encode()

    def _read(self, model: dict, number: dict[str, int]) -> None:
        """What else is taken from the file's model."""

    def units(self, text: str) -> Iterator[list[str]]:
        """A text's units, by pieces of bounded size; an added token is a unit of its own."""
        for part in self._between.split(text) if self._between else (text,):
            if part in self.special:
                yield [part]
            elif part:
                yield from map(_CUT.split, segments(part))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids[offsets[k]:offsets[k + 1]]. Ids that the file does not have stand for nothing; bytes that are no UTF-8 become U+FFFD."""
        sizes = np.array([len(p) for p in self.pieces] + [0], np.int64)
        flat = np.frombuffer(b"".join(self.pieces) + b"\0", np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = bytearray()
            for k in range(a, b, STEP):
                part = np.minimum(np.asarray(ids[k : min(b, k + STEP)]).astype(np.int64), self.size)
                part[part < 0] = self.size
                n = sizes[part]
                text += flat[np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
            out.append(text.decode("utf-8", "replace"))
        return out


class ByteBPE(ByteVocabulary):
    """The vocabulary with its merges."""

    def _read(self, model: dict, number: dict[str, int]) -> None:
        from tokenizers import pre_tokenizers

        self.ids = {self.pieces[i]: i for i in model["vocab"].values()}
        self.merges: dict[int, int] = {}  # rank of a pair of ids
        self.formed, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.ids[bytes(number[c] for c in x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.ids[self.pieces[a] + self.pieces[b]]
            if self.formed[made] >= 0 or a * self.size + b in self.merges:
                raise ValueError("a token with two merges")
            self.merges[a * self.size + b] = rank
            self.formed[made], self.left[made], self.right[made] = rank, a, b
        if any(len(p) > 1 and self.formed[i] < 0 for p, i in self.ids.items()):
            raise ValueError("a token without a merge")
        ending: dict[bytes, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                ending.setdefault(p[-3:], {1, 2}).add(len(p))
        self._ending = {end: tuple(sorted(found, reverse=True)) for end, found in ending.items()}  # how long tokens are, by their last three bytes
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._follows: dict[int, bool] = {}

    def follows(self, x: int, y: int) -> bool:
        """Whether y directly after x stays so: no merge takes the right end of x with the left end of y. From the whole
        tokens down, what was merged last is taken apart first; of equal merges the left one came first."""
        until_x = until_y = _NEVER  # when the piece that is looked at was merged into the next larger one
        while True:
            rank = self.merges.get(x * self.size + y)
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if self.formed[x] > self.formed[y]:
                until_x, x = self.formed[x], self.right[x]
            elif self.formed[y] >= 0:
                until_y, y = self.formed[y], self.left[y]
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct word. Words in order are the trie's depth-first walk: the path to a node is a stack, which
        has each ancestor's last token and how long that is; what the next word shares of it stays."""
        ids, size, known, ending, out = self.ids, self.size, self._follows, self._ending, {}
        if len(known) > PAIRS:
            known.clear()
        words = sorted(set(words))
        last, length = ([0] * (max(map(len, words), default=0) + 1) for _ in range(2))  # by depth
        before = b""
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            for depth in range(shared + 1, len(word) + 1):
                for n in ending.get(word[depth - 3 : depth], SHORT) if depth > 2 else SHORT:
                    begin = depth - n
                    if begin < 0 or (token := ids.get(word[begin:depth])) is None:
                        continue
                    if begin:
                        pair = last[begin] * size + token
                        fits = known.get(pair)
                        if fits is None:
                            fits = known[pair] = self.follows(last[begin], token)
                        if not fits:
                            continue
                    last[depth], length[depth] = token, n
                    break
                else:
                    raise ValueError("a byte without a token")
            depth, found = len(word), []
            while depth:
                found.append(last[depth])
                depth -= length[depth]
            found.reverse()
            out[word] = found
            before = word
        return out

    def words(self, unit: str) -> list[bytes]:
        """A unit by the file's splitting rule. Beyond ASCII the library says which characters are letters."""
        if _LETTERS.fullmatch(unit):
            return [unit.encode()]
        if unit.isascii():
            return [w.encode() for w in self._words.findall(unit)]
        return [unit[a:b].encode() for _, (a, b) in self._library.pre_tokenize_str(unit)]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        words = [[] if u in self.special else self.words(u) for u in units]
        known = self.encode_words(w for ws in words for w in ws)
        return [[self.special[u]] if u in self.special else known[ws[0]] if len(ws) == 1 else [t for w in ws for t in known[w]] for u, ws in zip(units, words, strict=True)]


class Pool:
    """Runs of numbers under the numbers of their units."""

    def __init__(self, dtype=np.uint32):
        self.flat, self.starts, self.sizes = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used = self.known = 0

    def add(self, runs: list) -> None:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        self.extend(np.fromiter(chain.from_iterable(runs), self.flat.dtype, int(sizes.sum())), sizes)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Runs that stand one after another in flat."""
        total = len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = flat
        self.sizes[self.known : self.known + len(sizes)] = sizes
        self.starts[self.known : self.known + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = self.used + total, self.known + len(sizes)

    def joined(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these units one after another, and where each begins, the end included."""
        sizes = self.sizes[codes]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[codes] - at[:-1], sizes) + np.arange(at[-1])], at


class Remembered:
    """Numbers of units, each learned once until too many are known."""

    most: int | None = None  # REMEMBERED, unless a kind of its own takes more memory for each

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}

    def learn(self, units: list[str]) -> None:
        raise NotImplementedError

    def split(self, text: str) -> Iterator[list[str]]:
        raise NotImplementedError

    def codes(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts as numbers, and the first one's place of each text, the end included."""
        if len(self.known) > (self.most or REMEMBERED):
            self.forget()
        out, sizes, waiting = [], [], []
        for text in texts:
            n = 0
            for units in self.split(text):
                n += len(units)
                waiting += units
                if len(waiting) >= LOOKUP:
                    out.append(self._numbers(waiting))
                    waiting = []
            sizes.append(n)
        out.append(self._numbers(waiting))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)

    def _numbers(self, units: list[str]) -> np.ndarray:
        known = self.known
        if fresh := list({u for u in units if u not in known}):
            fresh.sort()
            self.learn(fresh)
            first = len(known)
            known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))


class Encoder(Remembered):
    def __init__(self, path: str, special: bool = True):
        self.bpe = ByteBPE(path, special)
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.pool = Pool()

    def learn(self, units: list[str]) -> None:
        self.pool.add(self.bpe.encode_units(units))

    def split(self, text: str) -> Iterator[list[str]]:
        return self.bpe.units(text)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin, the end included."""
        codes, first = self.codes(texts)
        ids, at = self.pool.joined(codes)
        return ids, at[first]


def strings(column: pa.Array) -> list[str]:
    """A text column; a null is empty, and bytes that are no UTF-8 are U+FFFD."""
    data, offsets = tk.buffers(column)
    raw = memoryview(data)
    return [str(raw[a:b], "utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def kept(name: str, make):
    if name not in tk.KEPT:
        tk.KEPT[name] = make()
    return tk.KEPT[name]


def _encoding(path: str, special: bool):
    name = f"bpe {path} {special}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in tk.parts(b, 4 << 20)):
            ids, at = kept(name, lambda: Encoder(path, special)).encode(strings(part.column("text")))
            column = pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return tk.task(run, name)


def encode(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """docs (doc_id, text; others ignored) -> doc_id, ids (array of int): the ids of each whole text.

    A row in, a row out, repeated ones too; a null or empty text has no ids, a null doc_id stays. special: whether the
    strings of added tokens in a text are those tokens, as the library does unless told otherwise. Nothing is shuffled.
    """
    Stage(docs.sparkSession, "bpe")
    plain = clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(_encoding(path or default_path(), special), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with text. Null ids and ids that the file does not have stand for nothing."""
    path = path or default_path()
    name = f"pieces {path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = kept(name, lambda: ByteVocabulary(path))
            column = batch.column("ids")
            offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = bpe.decode(column.flatten().fill_null(-1).to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = clean(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(tk.task(run, name), "doc_id long, ids array<int>, text string")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and the text that they decode to, as digests; a row per document, none for an empty table."""
    rows = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
