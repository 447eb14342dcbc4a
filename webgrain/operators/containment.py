"""Which texts contain which passages: all passages at once, in one walk over each text.

The heads of the passages, their first characters, make an Aho-Corasick automaton; where a head ends in a text, the passages
that begin with it are compared with the text at that place. Automaton and passages go to all tasks while they are small;
beyond that, parts of the passages meet shares of the texts, so that no task and no driver holds all of either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a passage that the automaton knows.
HEAD = 24
#: Characters of passages that go to every task: about 100 MB with the automaton, which has HEAD nodes a passage at most.
MOST = 4 << 20
#: Characters of texts that a share has, about.
SHARE = 64 << 20
_MADE: dict[str, Finder] = {}


class Finder:
    """An automaton over passages (number, text). An empty passage is in no text."""

    def __init__(self, passages: list[tuple[int, str]]):
        import ahocorasick

        heads: dict[str, list[tuple[int, str]]] = {}
        for number, text in passages:
            if text:
                heads.setdefault(text[:HEAD], []).append((number, text))
        self.automaton = ahocorasick.Automaton()
        for head, found in heads.items():
            self.automaton.add_word(head, (len(head), found))
        if heads:
            self.automaton.make_automaton()
        self.some = bool(heads)

    def find(self, text: str | None) -> list[int]:
        """The passages in a text, each once."""
        out: dict[int, None] = {}
        for end, (size, found) in self.automaton.iter(text) if text and self.some else ():
            for number, passage in found:
                if number not in out and text.startswith(passage, end + 1 - size):
                    out[number] = None
        return list(out)


def contained(texts: DataFrame, key: str, text: str, passages: DataFrame, id_: str, passage: str, most: int = MOST, share: int = SHARE) -> DataFrame:
    """texts (key, text), passages (id, passage) -> id, key: each passage in each text that contains it, character by character.

    Null and empty passages and texts match nothing. Passages of equal texts all match; each (row of texts, row of
    passages) once.
    """
    spark = texts.sparkSession
    kinds = f"n long, k {texts.schema[key].dataType.simpleString()}"
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t != ''")
    given = passages.select(F.col(id_).alias("id"), F.col(passage).alias("p")).where("p != ''")
    # equal passages are looked for once; a passage's number is its hash of 64 bits
    looked = given.select("p", F.xxhash64("p").alias("n")).distinct()
    size = looked.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    found = _broadcast(rows, [(r.n, r.p) for r in looked.collect()], kinds) if size <= most else _dealt(rows, looked, kinds, -(-size // most), share)
    named = given.select("id", F.xxhash64("p").alias("n"))
    return found.join(named if size > most else F.broadcast(named), "n").select(F.col("id").alias(id_), F.col("k").alias(key))


def _broadcast(rows: DataFrame, passages: list[tuple[int, str]], kinds: str) -> DataFrame:
    held, name = rows.sparkSession.sparkContext.broadcast(passages), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Finder(held.value)
        finder = _MADE[name]
        for batch in batches:
            hits = [finder.find(t) for t in batch.column("t").to_pylist()]
            at = pa.array([i for i, found in enumerate(hits) for _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([n for found in hits for n in found], pa.int64()), batch.column("k").take(at)], ["n", "k"])

    return rows.mapInArrow(run, kinds)


def _dealt(rows: DataFrame, passages: DataFrame, kinds: str, parts: int, share: int) -> DataFrame:
    """Parts of the passages by their heads, each for every share of the texts."""
    shares = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // share))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = passages.select("n", "p", F.pmod(F.xxhash64(F.left("p", F.lit(HEAD)), "n"), F.lit(parts)).cast("int").alias("part"), each(shares).alias("share"))
    asked = rows.select("k", "t", F.pmod(F.xxhash64("t", "k"), F.lit(shares)).cast("int").alias("of"), each(parts).alias("for"))

    def run(passages: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        finder = Finder(list(zip(passages["n"].tolist(), passages["p"], strict=True)))
        hits = [finder.find(t) for t in texts["t"]]
        at = [i for i, found in enumerate(hits) for _ in found]
        return pd.DataFrame({"n": [n for found in hits for n in found], "k": texts["k"].iloc[at].to_numpy()}).astype({"n": "int64"})

    return held.groupBy("part", "share").cogroup(asked.groupBy("for", "of")).applyInPandas(run, kinds)
