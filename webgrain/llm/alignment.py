"""Alignment of two public tokenizers' tokens, and corpus counts of linked ids.

Both tokenizers cut the same bytes, a space and the text. Tokens of the two that overlap are the edges of a bipartite
graph; its connected components, found by union-find, are exactly the smallest groups that both tokenizers end
together, and every pair of a component's members is a link. Neither tokenizer has a token that crosses a space after
another character than white space, so a text is cut there into units: a unit's ids and groups are the same
wherever it stands, and a worker works each distinct one out once.

Texts are aligned in blocks of bounded size, which are written with the distinct linked pairs of each block and in how
many of its documents each is linked. Only those pairs are shuffled: their sums over all blocks are the corpus counts,
and each block gets the counts of its own pairs back.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .bpe import ByteVocabulary, Pool, Remembered, kept, strings
from .bpe import default_path as byte_path
from .staging import Stage, clean

#: Bytes of text of a block, unless one text is longer.
BLOCK_BYTES = 8 << 20
_SPACE = "▁"
_ENCODED = "block long, docs binary, nulls binary, sizes binary, codes binary, numbers binary, links binary, n_links binary, `groups` binary, pairs array<struct<a int, b int, n long>>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, `groups` string"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece file whose pieces begin with their spaces. It adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in n.lstrip(_SPACE) for n in names):
            raise ValueError("a piece with a space inside")
        self.bytes = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
        self.lone = [self.model.piece_to_id(_SPACE)]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Units begin with a space, which the model adds itself; of nothing it would make nothing."""
        return [self.lone if u == " " else ids for u, ids in zip(units, self.model.encode([u[1:] for u in units], num_threads=1), strict=True)]


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected component of each token of the one and the other, numbered in order; tokens are given by where they
    end, both lists end at the same place.

    Between two neighbouring ends lies one token of each kind: an edge. Union-find over all edges at once: roots that an edge
    joins are hooked onto the smaller one, and paths are halved until each token points at its root.
    """
    n = len(ends_a)
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), n + np.searchsorted(ends_b, cuts)
    parent = np.arange(n + len(ends_b))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (above := parent[parent]).tobytes() != parent.tobytes():
            parent = above
    number = np.cumsum(parent[:n] == np.arange(n)) - 1  # a component's root is its first token of the first kind
    return number[parent[:n]], number[parent[n:]]


class Aligner(Remembered):
    """Units with their ids, groups and links. A unit's links are pairs a * size + b, repeated as they occur."""

    most = 300_000

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.a, self.b = ByteVocabulary(path_a, special=False), Pieces(path_b)
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True  # their strings are plain text
        self.size = len(self.b.bytes)
        self.a_lengths, self.b_lengths = (np.array([len(p) for p in x], np.int64) for x in (self.a.pieces, self.b.bytes))
        self.said = {sign: np.array([f"{k}{sign}" for k in range(max(self.a.size, self.size))], object) for sign in ",|;\n"}
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.groups: list[str] = []
        self.links, self.numbers = Pool(np.int64), np.zeros((1 << 12, 4), np.int64)

    def split(self, text: str) -> Iterator[list[str]]:
        return self.a.units(text)

    def learn(self, units: list[str]) -> None:
        runs = [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)], self.b.encode_units(units)
        sizes = [np.fromiter(map(len, r), np.int64, len(units)) for r in runs]
        ids = [np.fromiter(itertools.chain.from_iterable(r), np.int64, int(n.sum())) for r, n in zip(runs, sizes, strict=True)]
        whole = self._given_back(ids, sizes)
        if not whole.all():
            ids = [x[np.repeat(whole, n)] for x, n in zip(ids, sizes, strict=True)]
            sizes = [np.where(whole, n, 0) for n in sizes]
        owner = np.repeat(np.arange(len(units)), sizes[0])
        ends = [np.cumsum(lengths[x]) for lengths, x in zip((self.a_lengths, self.b_lengths), ids, strict=True)]
        of = components(*ends)
        m, n = (np.bincount(x) for x in of) if len(owner) else (np.zeros(0, np.int64),) * 2
        first = [np.cumsum(x) - x for x in (m, n)]
        unit = owner[first[0]]  # of each group
        group = np.repeat(np.arange(len(m)), m * n)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
        links = ids[0][first[0][group] + inside // n[group]] * self.size + ids[1][first[1][group] + inside % n[group]]
        per = np.stack([*sizes, np.bincount(unit, minlength=len(units)), ~whole], axis=1)
        while self.links.known + len(units) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[self.links.known : self.links.known + len(units)] = per
        self.links.extend(links, np.bincount(unit, m * n, len(units)).astype(np.int64))
        # a group's tokens of the one, then of the other; each brings the sign that follows it
        said = np.empty(len(ids[0]) + len(ids[1]), object)
        last = [np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in of]
        said[np.arange(len(of[0])) + first[1][of[0]]] = np.where(last[0], self.said["|"][ids[0]], self.said[","][ids[0]])
        ended = last[1] & np.append(unit[1:] != unit[:-1], True)[of[1]]
        said[np.arange(len(of[1])) + (first[0] + m)[of[1]]] = np.where(ended, self.said["\n"][ids[1]], np.where(last[1], self.said[";"][ids[1]], self.said[","][ids[1]]))
        found = iter("".join(said.tolist()).split("\n"))
        self.groups += [next(found) if ok else "" for ok in whole.tolist()]

    def _given_back(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Which units' pieces have the bytes of the unit, which the byte-level tokens have. A piece never stands for more
        bytes than it was made of, so no other unit makes up for one that is not given back."""
        total = [np.bincount(np.repeat(np.arange(len(n)), n), lengths[x], len(n)) for n, lengths, x in zip(sizes, (self.a_lengths, self.b_lengths), ids, strict=True)]
        whole = total[0] == total[1]
        keep = [np.repeat(whole, n) for n in sizes]
        a, b = (np.frombuffer(b"".join([pieces[t] for t in x[k].tolist()]), np.uint8) for pieces, x, k in zip((self.a.pieces, self.b.bytes), ids, keep, strict=True))
        wrong = np.flatnonzero(a != b)
        if len(wrong):
            at = np.flatnonzero(whole)
            whole[at[np.searchsorted(np.cumsum(total[0][at]), wrong, "right")]] = False
        return whole

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of the texts by number, and where each text's begin; a text that the tokenizers do not both give back has none."""
        codes, first = self.codes([" " + t if t else "" for t in texts])
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        bad = np.bincount(owner, self.numbers[codes, 3], len(texts)) > 0
        keep = ~bad[owner]
        return codes[keep], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(first)))]).astype(np.int64)


def _distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each owner, each once, in order. Pairs are sorted as one number: a part has fewer than 2**20 owners, and
    pairs of ids of two vocabularies take fewer than 43 bits."""
    bits = int(values.max()).bit_length() if len(values) else 0
    both = np.sort((owner << bits) | values)
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    return both & ((1 << bits) - 1), both >> bits


class _Block:
    """What has been aligned of a block so far."""

    def __init__(self):
        self.docs: list[int | None] = []
        self.sizes, self.codes, self.pairs = [], [], []
        self.number: dict[str, int] = {}  # of the block's units, by their groups
        self.numbers, self.links, self.n_links = [], [], []
        self.bytes = 0

    def add(self, aligner: Aligner, docs: list[int | None], texts: list[str]) -> None:
        codes, first = aligner.align(texts)
        present, at = np.unique(codes, return_inverse=True)
        known, number = len(self.number), self.number
        local = np.fromiter((number.setdefault(aligner.groups[k], len(number)) for k in present.tolist()), np.int64, len(present))
        fresh, met = np.unique(local, return_index=True)
        new = present[met[fresh >= known]]
        links, at_link = aligner.links.joined(new)
        self.links.append(links)
        self.n_links.append(np.diff(at_link))
        self.numbers.append(aligner.numbers[new, :3])
        own, doc = _distinct(codes, np.repeat(np.arange(len(texts)), np.diff(first)))
        pairs, at_pair = aligner.links.joined(own)
        self.pairs.append(_distinct(pairs, np.repeat(doc, np.diff(at_pair)))[0])
        self.docs += docs
        self.sizes.append(np.diff(first))
        self.codes.append(local[at].astype(np.uint32))
        self.bytes += sum(map(len, texts))

    def row(self, block: int, size: int) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(self.pairs), return_counts=True)
        raw = {
            "docs": np.array([0 if d is None else d for d in self.docs], np.int64), "nulls": np.array([d is None for d in self.docs], np.uint8),
            "sizes": np.concatenate(self.sizes), "codes": np.concatenate(self.codes), "numbers": np.concatenate(self.numbers).astype(np.uint32),
            "links": np.searchsorted(pair, np.concatenate(self.links)).astype(np.uint32), "n_links": np.concatenate(self.n_links).astype(np.uint32),
            "groups": np.frombuffer("\n".join(self.number).encode(), np.uint8),
        }
        pairs = pa.StructArray.from_arrays([pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])
        columns = {"block": pa.array([block], pa.int64())} | {k: pa.array([_packed(v)], pa.binary()) for k, v in raw.items()} | {"pairs": pa.ListArray.from_arrays([0, len(pairs)], pairs)}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: How the numbers of a block are written.
_KINDS = {"docs": np.int64, "nulls": np.uint8, "sizes": np.int64, "codes": np.uint32, "numbers": np.uint32, "links": np.uint32, "n_links": np.uint32, "groups": np.uint8}


def _packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True) if size else b"", kind)


def _aligning(path_a: str, path_b: str, block_bytes: int):
    name = f"aligner {path_a} {path_b}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for part in (p for b in batches for p in tk.parts(b, 1 << 20)):
            aligner = kept(name, lambda: Aligner(path_a, path_b))
            block.add(aligner, part.column("doc_id").to_pylist(), strings(part.column("text")))
            if block.bytes >= block_bytes:
                yield block.row(first + made, aligner.size)
                made, block = made + 1, _Block()
        if block.docs:
            yield block.row(first + made, aligner.size)

    return tk.task(run, name)


def blocks(docs: DataFrame, stage: Stage, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Aligned documents (doc_id, text) in written blocks, each with its distinct linked pairs and their documents."""
    plain = clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage.put(plain.mapInArrow(_aligning(path_a or byte_path(), path_b or piece_path(), block_bytes), _ENCODED), "blocks")


def link_counts(aligned: DataFrame) -> DataFrame:
    """In how many documents of written blocks each pair of ids is linked: a, b, n_docs."""
    return aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def _counted(aligned: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block, given its pairs' counts."""
    tk.settle()  # the units that this worker remembers of the blocks' making are not needed for their counting
    out = []
    for r in aligned.to_dict("records"):
        raw = {c: _unpacked(r[c], kind) for c, kind in _KINDS.items()}
        n_docs, is_best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        n_docs[counts["k"]], is_best[counts["k"]] = counts["n_docs"], counts["best"]
        unit = np.repeat(np.arange(len(raw["n_links"])), raw["n_links"])
        per = np.zeros((len(raw["n_links"]), 6), np.int64)
        per[:, :3], per[:, 3] = raw["numbers"].reshape(-1, 3), raw["n_links"]
        np.add.at(per[:, 4], unit, is_best[raw["links"]])
        np.add.at(per[:, 5], unit, n_docs[raw["links"]])
        ends = np.cumsum(raw["sizes"])
        sums = np.zeros((len(ends), 6), np.int64)
        for j in range(6):  # a column at a time, as a block has many units
            total = np.append(0, np.cumsum(per[raw["codes"], j]))
            sums[:, j] = total[ends] - total[ends - raw["sizes"]]
        names = raw["groups"].tobytes().decode().split("\n")
        said = [";".join([names[k] for k in raw["codes"][a:b].tolist()]) for a, b in zip((ends - raw["sizes"]).tolist(), ends.tolist(), strict=True)]
        frame = pd.DataFrame(sums, columns=["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])
        frame.insert(0, "doc_id", pd.array(raw["docs"], dtype="Int64"))
        frame.loc[raw["nulls"] > 0, "doc_id"] = pd.NA
        out.append(frame.assign(groups=said))
    return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text; others ignored) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    path_a: a byte-level BPE file, which reads a space and the text; path_b: a sentencepiece file, which adds the space.
    Strings of special tokens are plain text. groups lists the smallest groups that both tokenizers end together as
    `a1,a2|b1;a3|b2,b3`. Links are all pairs of a group; count_sum adds up over them in how many documents of the table a
    pair is linked, and n_best are the links whose pair has its first id's highest such number, ties included. A row in,
    a row out, each row a document of its own, also if it repeats a doc_id or has none. A text that is null or empty, or
    that one of the tokenizers does not give back byte for byte, has zeros and no groups.
    """
    stage = Stage(docs.sparkSession, "alignment")
    aligned = blocks(docs, stage, path_a, path_b, block_bytes)
    totals = stage.put(link_counts(aligned), "links")
    top = totals.groupBy("a").agg(F.max("n_docs").alias("top"))  # a row for each id of the first vocabulary at most
    ranked = totals.join(F.broadcast(top), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))
    own = aligned.select("block", F.posexplode("pairs").alias("k", "p")).select(F.col("block").alias("of"), "k", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    n = max(1, min(aligned.count(), 20_000))
    counts = own.join(ranked, ["a", "b"]).select("of", "k", "n_docs", "best").repartition(n, "of")
    return aligned.drop("pairs").repartition(n, "block").groupBy("block").cogroup(counts.groupBy("of")).applyInPandas(_counted, _RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's numbers of tokens, groups and links, and a digest of its groups; a row per document."""
    rows = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
