"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text's set of k-word shingles becomes a 128-bit fingerprint (equal sets are one class, so exact copies
   are never compared) and a signature: one hash per bin from a single permutation, empty bins filled from the
   first filled bin in that bin's own random probe order.
2. Bands of the signature give buckets. In each bucket the smallest class is the hub, and candidates are the
   edges from the hub to the others, so a bucket of n classes gives n - 1 of them.
3. Candidates are confirmed on the full sets, by pairs of blocks of about BLOCK shingles, so that a hot hub's
   members are dealt over many tasks and a set is read once for all its pairs with a block.
4. A member that its hub refuses may still be linked to another member. Buckets whose members are in more than one
   component go on, cut by size, as linked sets are of similar size: a task reads two of their blocks and counts what their sets have in common by kinds of shingles,
   those that the same sets hold, so that documents made of shared passages cost what the passages do. In a hot group,
   of more than one block, each set's shingles that no other class of its buckets holds are counted first: a link can
   have none of them, so that most members need no comparison. No pair of documents ever becomes a row, and no member
   is left out.

Two sets at the threshold 0.8 share none of the 32 bands of 4 with a probability of (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected_components
from .staging import Stage, clean, unused

U = np.uint64
BINS = 128
ROWS = 4  # bins of a band
CELLS = 1 << 21  # of a matrix of sets and kinds of shingles, or of sets and sets
BLOCK = 1 << 18  # shingles of a block, about; the verification reads two blocks' sets at a time
MEMBER = 64  # what a set counts for besides its shingles where blocks are filled with many small ones

_PROBES = np.stack([np.random.default_rng(7919 + i).permutation(BINS) for i in range(BINS)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set of hashes, densified."""
    rehashed = np.sort(tk.mix(shingles, 5))
    bins, first = np.unique(rehashed >> U(64 - 7), return_index=True)
    out = np.zeros(BINS, U)
    filled = np.zeros(BINS, bool)
    bins = bins.astype(np.int64)
    out[bins], filled[bins] = rehashed[first], True
    if len(bins) < BINS:
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(1)]]
    return out


_MULT = tk.mix(np.arange(1, ROWS + 1, dtype=U), 77) | U(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    sig = signature(shingles).reshape(-1, ROWS)
    return tk.mix((sig * _MULT).sum(1, dtype=U) + np.arange(len(sig), dtype=U) * U(0xD6E8FEB86659FD93), 9)


def _sketch(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in tk.parts(b)):
            hashes, first = tk.word_hashes(*tk.buffers(batch.column("text")), lower)
            n, f1, f2, bs = [], [], [], []
            for i in range(batch.num_rows):
                s = tk.shingle_set(hashes[first[i] : first[i + 1]], k)
                n.append(len(s))
                f1.append(tk.mix(s, 21).sum(dtype=U))
                f2.append(tk.mix(s, 22).sum(dtype=U))
                bs.append(bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(b) for b in bs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(f1, U).view(np.int64)),
                    pa.array(np.array(f2, U).view(np.int64)),
                    pa.ListArray.from_arrays(at, np.concatenate(bs)),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _sets(k: int, lower: bool):
    """Each text's set itself, and one of its fingerprints to tell apart the texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in tk.parts(b)):
            hashes, first = tk.word_hashes(*tk.buffers(batch.column("text")), lower)
            sets = [tk.shingle_set(hashes[first[i] : first[i + 1]], k) for i in range(batch.num_rows)]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            marks = pa.array(np.array([tk.mix(s, 21).sum(dtype=U) for s in sets], U).view(np.int64))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), marks, pa.ListArray.from_arrays(at, flat)], ["id", "f1", "set"])

    return run


def _confirm(threshold: int):
    """The pairs between two blocks, with the sets of both -> whether each pair is linked."""

    def run(pairs, docs):
        sets: dict[int, list[np.ndarray]] = {}
        for x, s in zip(docs["id"].tolist(), docs["set"], strict=True):
            sets.setdefault(x, []).append(s.view(U))
        pairs["linked"] = [any(_linked(x, y, threshold) for x in sets.get(a, ()) for y in sets.get(b, ())) for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)]
        return pairs[["a", "b", "linked"]]

    return run


def _common(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some sets' numbers, and how many shingles each of them has in common with each set.

    Shingles that the same sets hold, as those of one passage do, are one kind with a weight, and those of a single set are
    none. Dense products of sets and kinds, or sums over the kinds' lists of sets, whichever takes less.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    exact = np.float32 if sizes.max() < 1 << 24 else float
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    held = np.bincount(at)
    pattern = np.zeros(len(held), U)
    np.add.at(pattern, at, tk.mix(np.arange(1, n + 1, dtype=U), 31)[owner])
    several = np.flatnonzero(held > 1)
    _, first, weight = np.unique(pattern[several], return_index=True, return_counts=True)
    number = np.full(len(held), -1)
    number[several[first]] = np.arange(len(first))  # one shingle stands for its kind
    kind = number[at]
    owner, kind = owner[kind >= 0], kind[kind >= 0]
    lists = np.bincount(kind, minlength=len(weight))
    if n * n * len(weight) < 64 * int((lists.astype(np.int64) ** 2).sum()):
        step = max(1, CELLS // n)
        for a in range(0, n, step):
            rows = np.arange(a, min(n, a + step))
            out = np.zeros((len(rows), n), exact)
            for k in range(0, len(weight), step):
                some = (kind >= k) & (kind < k + step)
                dense = np.zeros((n, min(step, len(weight) - k)), exact)
                dense[owner[some], kind[some] - k] = 1
                out += (dense[rows] * weight[k : k + step].astype(exact)) @ dense.T
            yield rows, out
        return
    order = np.argsort(kind, kind="stable")
    docs, begin = owner[order], np.cumsum(lists) - lists
    ends = np.cumsum(np.bincount(owner, minlength=n))
    for i in range(n):
        own = kind[ends[i - 1] if i else 0 : ends[i]]
        size = lists[own]
        found = docs[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        yield np.array([i]), np.bincount(found, np.repeat(weight[own], size), n)[None, :]


def _across(threshold: int):
    """The open sets of two blocks -> links between those that are not yet in one component."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        sizes, block, ids, out = pdf["n"].to_numpy(), pdf["k"].to_numpy(), pdf["id"].to_numpy(), []
        comp, same = pdf["comp"].to_numpy().copy(), pdf["ka"].iat[0] == pdf["kb"].iat[0]
        for rows, common in _common([s.view(U) for s in pdf["set"]]):
            linked = (100 + threshold) * common.astype(float) >= threshold * (sizes[rows][:, None] + sizes[None, :])
            linked &= comp[rows][:, None] != comp[None, :]
            if not same:
                linked &= block[rows][:, None] != block[None, :]
            for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                i = int(rows[i])
                if comp[i] != comp[j]:
                    out.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < threshold * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame, stage: Stage, threshold: int) -> DataFrame:
    """pairs (a, ka, b, kb), distinct, k the blocks -> staged (a, b, linked). Each pair of blocks reads its sets once."""
    ends = stage.put(pairs.select("ka", "kb", F.col("a").alias("end")).union(pairs.select("ka", "kb", F.col("b").alias("end"))).distinct(), "ends")
    docs = sets.join(stage.small(ends), F.col("id") == F.col("end")).select(F.col("ka").alias("da"), F.col("kb").alias("db"), "id", "set")
    found = pairs.groupBy("ka", "kb").cogroup(docs.groupBy("da", "db")).applyInPandas(_confirm(threshold), "a long, b long, linked boolean")
    return stage.put(found, "links")


def _blocked(members: DataFrame, stage: Stage, by_size: bool = False) -> DataFrame:
    """members (id, hub, n), a row per bucket -> staged (id, k, hot): blocks of about BLOCK shingles, likely alike.

    A block is a share of the classes whose smallest hub is the same one; those of a hub with several blocks are hot.
    by_size: members have their size class c, and the shares of one size class are put together up to BLOCK, so that a set
    meets as many blocks as its size classes fill, however many hubs there are.
    """
    c = F.min("c") if by_size else F.lit(0)
    owned = stage.put(members.groupBy("id").agg(F.min("hub").alias("g"), F.max("n").alias("n"), c.alias("c")), "owned")
    loads = owned.groupBy("g", "c").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    loads = stage.put(loads.where("parts > 1").select(F.col("g").alias("of"), F.col("c").alias("of_c"), "parts"), "loads")
    parts = F.coalesce("parts", F.lit(1))
    found = owned.join(stage.small(loads), (F.col("g") == F.col("of")) & (F.col("c") == F.col("of_c")), "left")
    share = F.xxhash64("g", F.pmod(F.xxhash64("id"), parts))
    if by_size:
        filled = owned.groupBy("c").agg(F.ceil(F.sum(F.col("n") + MEMBER) / BLOCK).alias("filled")).withColumnRenamed("c", "size")
        found = found.join(F.broadcast(filled), F.col("c") == F.col("size"))  # a row for each size class
        share = F.xxhash64("c", F.pmod(share, F.col("filled")))
    return stage.put(found.select("id", share.alias("k"), (parts > 1).alias("hot")), "blocks")


def _open(known: DataFrame) -> DataFrame:
    """The buckets (h, rep, comp, ...) whose members are in more than one component."""
    apart = known.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("h").alias("bucket"))
    return known.join(apart, F.col("h") == F.col("bucket"), "left_semi")


def _by_size(known: DataFrame, threshold: int) -> DataFrame:
    """Each bucket cut into its pairs of neighbouring size classes c: sets that are linked are at most one class apart."""
    width = math.log(100 / max(threshold, 1)) + 1e-6
    c = F.floor(F.log("n") / width)
    return known.withColumn("c", c).withColumn("low", F.explode(F.array(c - 1, c))).withColumn("h", F.xxhash64("h", "low")).drop("low")


def _bounded(still: DataFrame, blocks: DataFrame, sets: DataFrame, stage: Stage, threshold: int) -> DataFrame:
    """Of the sets in hot blocks: staged (id, f1, dead).

    A set's shingles that another class of its buckets holds too are counted: no link can have more in common, and dead
    says that this is too few for any.
    """
    hot = stage.small(stage.put(blocks.where("hot").select(F.col("id").alias("hot_id")), "hot"))
    met = still.join(hot, F.col("rep") == F.col("hot_id"), "left_semi").select(F.col("h").alias("bucket")).distinct()
    near = still.join(met, F.col("h") == F.col("bucket"), "left_semi").select("rep").distinct()
    mine = sets.join(near, F.col("id") == F.col("rep"), "left_semi")
    shingles = stage.put(mine.select("id", "f1", F.explode("set").alias("t")), "shingles")
    held = shingles.groupBy("t").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("t").alias("both"))
    asked = shingles.join(hot, F.col("id") == F.col("hot_id"), "left_semi")
    common = asked.join(held, F.col("t") == F.col("both"), "left").groupBy("id", "f1").agg(F.count("*").alias("n"), F.count("both").alias("c"))
    bounds = stage.put(common.select("id", "f1", (100 * F.col("c") < threshold * F.col("n")).alias("dead")), "bounds")
    stage.drop(shingles)
    return bounds


def _left_apart(known: DataFrame, sets: DataFrame, stage: Stage, threshold: int) -> DataFrame | None:
    """Links (a, b) that the stars of known (h, hub, rep, n, comp) have missed, or None if no bucket is open."""
    still = stage.put(_open(_by_size(_open(known), threshold)), "open")
    if still.isEmpty():
        return None
    blocks = _blocked(still.select(F.col("rep").alias("id"), "hub", "n", "c"), stage, by_size=True)
    mine = sets
    if not blocks.where("hot").isEmpty():
        bounds = _bounded(still, blocks, sets, stage, threshold)
        mine = sets.join(stage.small(bounds), ["id", "f1"], "left").where("NOT coalesce(dead, false)").select("id", "f1", "set")
        alive = stage.put(bounds.groupBy("id").agg(F.bool_and("dead").alias("gone")).where("gone").select(F.col("id").alias("gone_id")), "gone")
        still = stage.put(_open(still.join(stage.small(alive), F.col("rep") == F.col("gone_id"), "left_anti")), "open")
        blocks = _blocked(still.select(F.col("rep").alias("id"), "hub", "n", "c"), stage, by_size=True)
    homes = stage.small(blocks).select("id", "k")
    sides = still.join(homes, F.col("rep") == F.col("id")).select("h", "k").distinct()
    met = sides.join(sides.select("h", F.col("k").alias("kb")), "h").where("k <= kb").select(F.col("k").alias("ka"), "kb").distinct()
    met = stage.put(met, "block-pairs")
    # which pairs of blocks read a member: a set goes to each of them, and nowhere before
    reads = met.select("ka", "kb", F.explode(F.array_distinct(F.array("ka", "kb"))).alias("k"))
    asked = still.select(F.col("rep").alias("id"), "comp").distinct().join(homes, "id").join(reads, "k")
    asked = stage.put(asked.select(F.col("id").alias("member"), "comp", "k", "ka", "kb"), "asked")
    rows = mine.join(stage.small(asked), F.col("id") == F.col("member")).select("ka", "kb", "k", "id", "comp", F.size("set").alias("n"), "set")
    return stage.put(rows.groupBy("ka", "kb").applyInPandas(_across(threshold), "a long, b long"), "more")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, lower: bool = True) -> DataFrame:
    """Links documents whose sets of k-word shingles have a Jaccard similarity of threshold percent or more.

    docs needs doc_id and text; other columns are ignored. Returns one row per row of docs: doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, itself included) and kept (doc_id = component_id).
    Null, empty and blank texts have an empty set, link with nothing and are kept. A text of fewer than k words
    is one shingle. A null doc_id links with nothing, has a null component_id and is kept. Rows that repeat a
    doc_id are one document: it is linked with whatever one of its texts is linked with, and all its rows have one
    component; n_shingles is that of the row's text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    docs = clean(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = stage.put(docs.mapInArrow(tk.task(_sketch(k, lower)), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketches")
    of = ["n_shingles", "f1", "f2"]
    member = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage.put(member.groupBy(*of).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    repeats = sketched.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.struct(*of)).alias("low"), F.max(F.struct(*of)).alias("high"))
    repeats = stage.put(repeats.where("rows > 1").select(F.col("doc_id").alias("again"), (F.col("low") != F.col("high")).alias("unlike")), "repeats")
    spread = classes.select(F.explode("bands").alias("h"), "rep", F.col("n_shingles").alias("n"))
    hubs = spread.groupBy("h").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    hubs = stage.put(hubs.select(F.col("h").alias("bucket"), "hub"), "hubs")
    bucketed = stage.put(spread.join(stage.small(hubs), F.col("h") == F.col("bucket")).select("h", "hub", "rep", "n"), "buckets")
    blocks = _blocked(bucketed.select(F.col("rep").alias("id"), "hub", "n"), stage)
    sets = docs.select(F.col("doc_id").alias("id"), "text").join(stage.small(blocks), "id", "left_semi").mapInArrow(tk.task(_sets(k, lower)), "id long, f1 long, set array<long>")
    if not repeats.isEmpty():
        sets = sets.groupBy("id", "f1").agg(F.first("set").alias("set"))
    sets = stage.put(sets.where(F.size("set") > 0), "sets")

    homes = stage.small(blocks).select("id", "k")
    first = bucketed.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    first = first.join(homes.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(homes.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    links = _verify(stage.put(first.select("a", "ka", "b", "kb"), "pairs"), sets, stage, threshold).where("linked").select("a", "b")
    unlike = stage.put(repeats.where("unlike"), "unlike")
    if not unlike.isEmpty():  # a document of unlike texts ties their classes together
        tied = sketched.join(stage.small(unlike), F.col("doc_id") == F.col("again"), "left_semi").join(classes.select("rep", *of), of)
        links = links.union(tied.select("doc_id", "rep"))
    comps = connected_components(spark, links, stage)
    known = bucketed.join(stage.small(comps), F.col("rep") == F.col("node"), "left").select("h", "hub", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    more = _left_apart(known, sets, stage, threshold)
    if more is not None:
        comps = connected_components(spark, more.union(comps.select("node", "component")), stage)
    stage.drop(sets)
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*of, F.coalesce("component", "rep").alias("class_component"))
    named = stage.put(named, "named")
    read = [sketched, named]
    joined = sketched.select("doc_id", *of).join(stage.small(named), of, "left")
    if not unlike.isEmpty():  # also its blank texts
        whole = stage.put(comps.join(unlike, F.col("node") == F.col("again"), "left_semi").select(F.col("node").alias("whole"), F.col("component").alias("whole_component")), "whole")
        read.append(whole)
        joined = joined.join(stage.small(whole), F.col("doc_id") == F.col("whole"), "left").withColumn("class_component", F.coalesce("class_component", "whole_component"))
    stage.keep(*read)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_per_group(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """docs without the documents that are not their group's smallest doc_id; its columns are unchanged.

    Rows that repeat a kept doc_id all stay: they are one document.
    """
    stage = Stage(docs.sparkSession, "groups")
    (name,) = unused(docs, "gone")
    gone = stage.put(near_duplicates(docs, k, threshold).where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(stage.small(gone), docs["doc_id"] == F.col(name), "left_anti")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT n.doc_id, n.n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.d = n.doc_id
"""
