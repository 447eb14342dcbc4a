"""Embedding near-dedup on a robust-pruned flat graph.

Vectors that are equal, with equal labels, are one class. Each label's classes are dealt to overlapping cluster shards
(the nearest centroids of a bounded sample). A flat graph is built on each shard: nodes enter in batches
of doubling size, a greedy search from the medoids finds each one's neighbourhood, and robust pruning keeps its edges.
The adjacency lists of all shards are united, and a range-expanding greedy search from each shard's medoids finds what
is within the range of every class that has its home there: when the search settles, nodes within the range (and a
little beyond) go on to be expanded until no more turn up. Every link is confirmed by its cosine in double precision.

The range expands across shards too. Where an edge of the united lists leads from an expanded node to a class of
another home, and the angles allow that class to be within the range, the searched class visits that shard and is compared
with all classes at home there; the nodes found are expanded in turn, and each class that was linked visits the
home of the other. Rounds of visits go on until none is new. A visit counts for its visitor only, so that each link counts
once at either end, and no row is made of a pair: counts, visits and a star of edges for each component leave a task.

Recall is audited against brute force on a bounded sample of classes; below AUDIT_LEAST, the whole runs again with
more overlap and a wider search, and at last with every class compared with all of its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .components import connected_components
from .staging import Stage, clean

SHARD = 1500  # classes of a shard, about
MAX_CENTROIDS = 1024  # that a label's classes, or those of a hot shard, are dealt to at a time
HOT, LEVELS = 4, 3  # a shard of that many times SHARD is dealt again, so many times at most
SAMPLE_EACH = 32  # classes that a centroid is fitted on
DEGREE, BEAM, ALPHA = 24, 40, 1.2
SLACK = 0.08  # nodes that much below the range still expand
MEDOIDS = 16
AUDIT, AUDIT_LEAST = 256, 0.97
AUDIT_BYTES = 64 << 20  # of the vectors that an audit takes to every task
QUERIES = 256  # searched at a time; a multiple of 8
DENSE = 16  # a search whose range has reached that part of a shard goes on with all of it
PASSES = ((2, BEAM, False), (4, 2 * BEAM, False), (1, BEAM, True))  # overlap, beam, whether all is compared


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each node p, at most degree of its candidates (-1: none): the nearest, then those that no chosen one is much nearer to."""
    out = np.full((len(p), degree), -1, np.int64)
    for a in range(0, len(p), QUERIES):
        c, q = cand[a : a + QUERIES], p[a : a + QUERIES]
        v = x[np.maximum(c, 0)]
        near = 2 - 2 * np.matmul(v, x[q][:, :, None])[:, :, 0]
        apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = (c >= 0) & (c != q[:, None])
        rows = np.arange(len(q))
        for k in range(degree):
            at = np.where(alive, near, np.inf).argmin(1)
            some = alive[rows, at]
            if not some.any():
                break
            out[a + rows[some], k] = c[rows[some], at[some]]
            alive &= alpha * alpha * apart[rows, at] > near
            alive[rows, at] = False
            alive &= c != c[rows, at][:, None]
    return out


def greedy(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int = BEAM, reach: float | None = None, both: tuple[np.ndarray, np.ndarray] | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Beams (ids, best first, -1: none) of the queries; with reach, also the cosines of the nodes met (-inf: not met).

    The range expands along edges of either direction: both has where each node's begin, and their ends.
    """
    n, rows = len(graph), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    beam = max(beam, len(entries))
    seen[:, entries] = True
    ids = np.full((len(q), beam), -1, np.int64)
    sims = np.full((len(q), beam), -np.inf)
    done = np.zeros((len(q), beam), bool)
    near = q @ x[entries].T
    by = np.argsort(-near, 1, kind="stable")
    ids[:, : len(entries)], sims[:, : len(entries)] = entries[by], np.take_along_axis(near, by, 1)
    found = np.full((len(q), n), -np.inf) if reach is not None else None
    spread = np.zeros((len(q), n), bool) if reach is not None else None
    if found is not None:
        found[:, entries] = near
        spread[:, entries] = near >= reach - SLACK
        if own is not None:  # a query that is a node also starts from itself
            spread[rows, own] = True
    live = rows
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        first = open_.argmax(1)
        has = open_[np.arange(len(live)), first]
        live, first = live[has], first[has]
        if not len(live):
            break
        node = ids[live, first]
        done[live, first] = True
        near = graph[node]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        who, what = live[r], near[r, c]
        seen[who, what] = True
        s = np.full(near.shape, -np.inf)
        got = np.einsum("ij,ij->i", q[who], x[what])
        s[r, c] = got
        if found is not None:
            found[who, what] = got
            spread[who, what] = got >= reach - SLACK
        all_s, all_i = np.concatenate([sims[live], s], 1), np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_d = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        top = np.argsort(-all_s, 1, kind="stable")[:, :beam]
        sims[live], ids[live], done[live] = (np.take_along_axis(y, top, 1) for y in (all_s, all_i, all_d))
    reached, most = np.zeros(len(q), np.int64), max(64, n // DENSE)
    while spread is not None and spread.any():  # the range expands
        reached += spread.sum(1)
        if len(wide := np.flatnonzero((reached > most) & spread.any(1))):  # most of what is left is near, or soon met
            found[wide], seen[wide], spread[wide] = q[wide] @ x.T, True, False
        who, node = np.nonzero(spread)
        spread[:] = False
        for a in range(0, len(who), 1 << 15):
            begin = both[0][node[a : a + (1 << 15)]]
            size = both[0][node[a : a + (1 << 15)] + 1] - begin
            w = np.repeat(who[a : a + (1 << 15)], size)
            what = both[1][np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            keep = ~seen[w, what]
            key = np.unique(w[keep] * n + what[keep])
            w, what = key // n, key % n
            seen[w, what] = True
            got = np.einsum("ij,ij->i", q[w], x[what])
            found[w, what] = got
            spread[w, what] |= got >= reach - SLACK
    return ids, found


def medoids(x: np.ndarray) -> np.ndarray:
    """Nodes nearest to the centroids of up to MEDOIDS clusters."""
    k = min(MEDOIDS, len(x))
    return np.unique((kmeans(x, k, 4) @ x.T).argmax(1)) if k else np.zeros(0, np.int64)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """The pruned graph (n x degree, -1: none) on unit vectors."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(5).permutation(n)
    entry = medoids(x)
    order = np.concatenate([entry, order[~np.isin(order, entry)]])
    first = order[: min(n, max(degree, len(entry)))]
    if n > 1:
        graph[first] = robust_prune(x, first, np.tile(first, (len(first), 1)), degree)
    at = len(first)
    while at < n:
        new = order[at : min(n, 2 * at)]
        at += len(new)
        for a in range(0, len(new), QUERIES):
            some = new[a : a + QUERIES]
            graph[some] = robust_prune(x, some, greedy(x, graph, entry, x[some], beam)[0], degree)
        to, of = graph[new].ravel(), np.repeat(new, degree)
        of, to = of[to >= 0], to[to >= 0]
        sim = np.einsum("ij,ij->i", x[of], x[to])
        by = np.lexsort((-sim, to))
        of, to = of[by], to[by]
        nodes, begin, size = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(begin, size)
        keep = rank < 2 * degree
        extra = np.full((len(nodes), 2 * degree), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), size)[keep], rank[keep]] = of[keep]
        graph[nodes] = robust_prune(x, nodes, np.concatenate([graph[nodes], extra], 1), degree)
    return graph


def _built(threshold: float):
    # an edge below that cosine cannot lead from an expanded node to one within the range
    least = np.cos(min(np.pi, np.arccos(max(-1.0, threshold - SLACK)) + np.arccos(threshold))) - 1e-9

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rep")
        reps, at, x = pdf["rep"].to_numpy(), pdf["at"].to_numpy(), vectors.stacked(pdf["v"])
        graph = build(x)
        i, j = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
        i, j = i[j >= 0], j[j >= 0]
        sim = np.einsum("ij,ij->i", x[i], x[j])
        out = (at[i] != at[j]) & (sim >= least)
        far = [{} for _ in reps]  # of each node, its nearest neighbour in each other home
        for a, b, s in zip(i[out].tolist(), j[out].tolist(), sim[out].tolist(), strict=True):
            for a, b in ((a, b), (b, a)):
                far[a][at[b]] = max(s, far[a].get(at[b], -1.0))
        return pd.DataFrame({"rep": reps, "near": [reps[g[g >= 0]] for g in graph], "far_at": [list(f) for f in far], "far_sim": [list(f.values()) for f in far]})

    return run


def _borders(pdf) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Home -> nodes with an edge to it, and the edge's angle."""
    size = [len(f) for f in pdf["far_at"]]
    node = np.repeat(np.arange(len(size)), size)
    to = np.concatenate([np.zeros(0, np.int64), *map(np.asarray, pdf["far_at"])]).astype(np.int64)
    turn = np.arccos(np.clip(np.concatenate([np.zeros(0), *map(np.asarray, pdf["far_sim"])]), -1, 1))
    return {u: (node[to == u], turn[to == u]) for u in np.unique(to).tolist()}


def _crossings(sims: np.ndarray, borders: dict, threshold: float):
    """(home, which of the rows of sims have something within their range there, for all that the edges tell)."""
    wide = sims >= threshold - SLACK
    angle = np.arccos(np.clip(sims, -1, 1)) + np.arccos(threshold) + 1e-9
    for u, (node, turn) in borders.items():
        yield u, (wide[:, node] & (angle[:, node] >= turn)).any(1)


def _rows(kind: int, **columns):
    import pandas as pd

    return pd.DataFrame({"kind": kind} | {c: columns.get(c, 0) for c in "abxy"})


class Links:
    """A symmetric relation on n nodes, a bit for each pair."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n, -(-n // 8)), np.uint8)

    def add(self, a: int, found: np.ndarray) -> None:
        """found: which of all nodes the nodes from a on are linked with; a is a multiple of 8."""
        self.bits[a : a + len(found)] |= np.packbits(found, 1, "little")
        turned = np.packbits(found.T, 1, "little")
        self.bits[:, a // 8 : a // 8 + turned.shape[1]] |= turned

    def weights(self, m: int, n: np.ndarray) -> np.ndarray:
        """For each of the first m nodes, the sum of n over those of them that it is linked with."""
        out = [np.unpackbits(self.bits[a : min(a + QUERIES, m)], axis=1, count=self.n, bitorder="little")[:, :m] @ n[:m] for a in range(0, m, QUERIES)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def groups(self, names: np.ndarray) -> np.ndarray:
        """For each node, the smallest name among those reachable."""
        out, left = names.copy(), np.ones(self.n, bool)
        for first in np.flatnonzero(self.bits.any(1)).tolist():
            if not left[first]:
                continue
            left[first], group, edge = False, [np.array([first])], np.array([first])
            while len(edge):
                met = np.zeros(self.bits.shape[1], np.uint8)
                for a in range(0, len(edge), 4096):
                    met |= np.bitwise_or.reduce(self.bits[edge[a : a + 4096]], 0)
                edge = np.flatnonzero(np.unpackbits(met, count=self.n, bitorder="little").view(bool) & left)
                left[edge] = False
                group.append(edge)
            at = np.concatenate(group)
            out[at] = names[at].min()
        return out


def _searched(threshold: float, beam: int, exact: bool):
    def run(key, pdf):
        import pandas as pd

        # those at home come first
        pdf = pdf.sort_values(["home", "rep"], ascending=[False, True]).reset_index(drop=True)
        (label, dim, here), at = (int(k) for k in key), pdf["at"].to_numpy()
        reps, n, home, x = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["home"].to_numpy(bool), vectors.stacked(pdf["v"])
        lists = [np.asarray(y, np.int64) for y in pdf["near"]]
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(reps)), [len(y) for y in lists])
        sorter = np.argsort(reps)
        to = sorter[np.minimum(np.searchsorted(reps, flat, sorter=sorter), len(reps) - 1)]
        inside = reps[to] == flat  # the other edges are in far_at
        owner, to = owner[inside], to[inside]
        size = np.bincount(owner, minlength=len(reps))
        graph = np.full((len(reps), max(1, size.max(initial=0))), -1, np.int64)
        graph[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = to
        ends = np.unique(np.concatenate([owner * len(reps) + to, to * len(reps) + owner]))
        either = np.concatenate([[0], np.cumsum(np.bincount(ends // len(reps), minlength=len(reps)))]), ends % len(reps)
        entry, m = medoids(x), int(home.sum())
        borders = _borders(pdf)
        out = []

        def visits(who: np.ndarray, where) -> None:
            out.append(_rows(1, a=who, b=where, x=label, y=dim))

        links = Links(len(reps))  # found from either end, a link counts at both
        for a in range(0, m, QUERIES):
            some = np.arange(a, min(m, a + QUERIES))
            sims = x[some] @ x.T if exact else greedy(x, graph, entry, x[some], beam, threshold, either, some)[1]
            sims[np.arange(len(some)), some] = 1.0
            for u, ok in _crossings(sims, borders, threshold):
                if u != here:
                    visits(reps[some[ok]], u)
            for u in np.unique(at[~home]).tolist():
                visits(reps[some[(sims[:, at == u] >= threshold - SLACK).any(1)]], u)
            found = sims >= threshold
            visits(reps[found.any(0) & ~home], here)
            found[np.arange(len(some)), some] = False
            links.add(a, found)
        out.append(_rows(0, a=reps[:m], x=links.weights(m, n)))
        top = links.groups(reps)
        tied = top != reps
        out.append(_rows(2, a=reps[tied], b=top[tied]))
        return pd.concat(out).drop_duplicates().astype("int64")

    return run


def _visited(threshold: float):
    def run(key, guests, pdf):
        import pandas as pd

        label, dim, here = (int(k) for k in key[:3])
        guests, pdf = guests.sort_values("guest"), pdf.sort_values("rep").reset_index(drop=True)
        who, origin, q = guests["guest"].to_numpy(), guests["origin"].to_numpy(), vectors.stacked(guests["q"])
        reps, n, x, borders = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), vectors.stacked(pdf["v"]), _borders(pdf)
        group = np.arange(len(reps))  # the smallest node that guests tie each one to
        out = []
        for a in range(0, len(who), QUERIES):
            some, from_ = who[a : a + QUERIES], origin[a : a + QUERIES]
            sims = q[a : a + QUERIES] @ x.T
            hit = sims >= threshold
            out.append(_rows(0, a=some, x=hit @ n))
            for u, ok in _crossings(sims, borders, threshold):
                ok &= from_ != u
                out.append(_rows(1, a=some[ok], b=u, x=label, y=dim))
            for u in np.unique(from_).tolist():
                out.append(_rows(1, a=reps[hit[from_ == u].any(0)], b=u, x=label, y=dim))
            first = []
            linked = np.flatnonzero(hit.any(1))
            for k in linked.tolist():
                tied = group[hit[k]]
                first.append(tied.min())
                if (tied != first[-1]).any():
                    group[np.isin(group, tied)] = first[-1]
            out.append(_rows(2, a=some[linked], b=reps[np.array(first, np.int64)]))
        tied = np.flatnonzero(group != np.arange(len(reps)))
        out.append(_rows(2, a=reps[tied], b=reps[group[tied]]))
        return pd.concat(out).drop_duplicates().astype("int64")

    return run


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids."""
    c = x[np.random.default_rng(k).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def _dealt(shared, overlap: int):
    def run(parts):
        import pandas as pd

        for pdf in parts:
            for (label, dim), g in pdf.groupby(["label", "dim"]):
                c = shared.value.get((label, dim))
                near = np.zeros((len(g), 1), np.int64) if c is None else np.argsort(-(vectors.stacked(g["v"]) @ c.T), 1, kind="stable")[:, :overlap]
                for k in range(near.shape[1]):
                    yield pd.DataFrame({"label": g["label"], "dim": g["dim"], "shard": near[:, k], "home": k == 0, "at": near[:, 0], "rep": g["rep"], "n": g["n"], "v": g["v"]})

    return run


def _exact(shared, threshold: float):
    def run(parts):
        import pandas as pd

        for pdf in parts:
            for (label, dim), g in pdf.groupby(["label", "dim"]):
                if (label, dim) in shared.value:
                    reps, q = shared.value[label, dim]
                    hit = (q @ vectors.stacked(g["v"]).T >= threshold) & (reps[:, None] != g["rep"].to_numpy()[None, :])
                    yield pd.DataFrame({"rep": reps, "n": hit @ g["n"].to_numpy()}).astype("int64")

    return run


DEALT = "label long, dim int, shard long, home boolean, at long, rep long, n long, v array<double>"


def _fitted(want: int):
    def run(key, pdf):
        import pandas as pd

        x = vectors.stacked(pdf.sort_values("rep")["v"])
        c = kmeans(x, min(want, int(pdf["want"].iat[0]), len(x)))
        return pd.DataFrame({"c_label": key[0], "c_dim": key[1], "c_shard": key[2], "c": list(c)})

    return run


def _dealt_again(overlap: int, level: int):
    """Rows of a hot shard, with its new centroids -> the rows in their nearest ones; new shards get new numbers."""

    def run(key, rows, centroids):
        import pandas as pd

        c = vectors.stacked(centroids.assign(k=centroids["c"].map(tuple)).sort_values("k")["c"])
        near = np.argsort(-(vectors.stacked(rows["v"]) @ c.T), 1, kind="stable")[:, :overlap]
        out = []
        for k in range(near.shape[1]):
            some = np.ones(len(rows), bool) if k == 0 else rows["home"].to_numpy(bool)
            # the number of a shard begins with that of the one it was cut from
            made = rows[some].assign(shard=(rows["shard"][some] + 1) * (MAX_CENTROIDS + 1) + near[some, k])
            out.append(made.assign(home=made["home"] & (k == 0)))
        return pd.concat(out)[["label", "dim", "shard", "home", "at", "rep", "n", "v"]]

    return run


def _cut_hot(dealt: DataFrame, stage: Stage, overlap: int) -> DataFrame:
    """Shards that are much too large, as centroids are few or a ball is dense, are dealt again to centroids of their own,
    which are fitted by a task each on a bounded sample."""
    of = ["label", "dim", "shard"]
    for level in range(LEVELS):
        sizes = dealt.where("home").groupBy(*of).agg(F.count("*").alias("c")).where(F.col("c") > HOT * SHARD)
        hot = stage.put(sizes.select(*[F.col(c).alias(f"h_{c}") for c in of], "c", F.least(F.ceil(F.col("c") / SHARD), F.lit(MAX_CENTROIDS)).alias("want")), "hot")
        if hot.isEmpty():
            return dealt
        same = (F.col("label") == F.col("h_label")) & (F.col("dim") == F.col("h_dim")) & (F.col("shard") == F.col("h_shard"))
        inside = dealt.join(stage.small(hot), same)
        drawn = F.xxhash64("rep", F.lit(31 + level)) / F.lit(2.0**64) + 0.5 <= 1.2 * SAMPLE_EACH * F.col("want") / F.col("c")
        fitted = inside.where(F.col("home") & drawn).select(*of, "rep", "v", "want").groupBy(*of).applyInPandas(_fitted(MAX_CENTROIDS), "c_label long, c_dim int, c_shard long, c array<double>")
        # a hot shard's rows come in slices, each with all of its centroids
        slices = F.ceil(F.col("c") / (8 * SHARD))
        rows = inside.select(*of, "home", "at", "rep", "n", "v", F.pmod(F.xxhash64("rep", F.lit(17)), slices).alias("slice"))
        every = hot.select("h_label", "h_dim", "h_shard", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("c_slice"))
        centroids = stage.put(fitted, "centroids").join(stage.small(stage.put(every, "slices")), (F.col("c_label") == F.col("h_label")) & (F.col("c_dim") == F.col("h_dim")) & (F.col("c_shard") == F.col("h_shard")))
        centroids = centroids.select("c_label", "c_dim", "c_shard", "c_slice", "c")
        again = rows.groupBy(*of, "slice").cogroup(centroids.groupBy("c_label", "c_dim", "c_shard", "c_slice")).applyInPandas(_dealt_again(overlap, level), DEALT)
        rest = dealt.join(stage.small(hot), same, "left_anti")
        moved = stage.put(rest.unionByName(again), "moved")
        homes = stage.put(moved.where("home").select(F.col("rep").alias("h_rep"), F.col("shard").alias("now")), "homes")
        dealt = stage.put(moved.join(stage.small(homes), F.col("rep") == F.col("h_rep")).select("label", "dim", "shard", "home", F.col("now").alias("at"), "rep", "n", "v"), "dealt")
        stage.drop(moved)
    return dealt


def _run(classes: DataFrame, stage: Stage, threshold: float, overlap: int, beam: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rep, links) of other classes' vectors, and component edges (a, b)."""
    spark = classes.sparkSession
    total = classes.count()
    target = max(SHARD, -(-total // MAX_CENTROIDS))
    large = classes.groupBy("label", "dim").count().where(F.col("count") > 1.5 * target).collect()  # MAX_CENTROIDS at most
    centroids = {}
    if large:
        want = {(r["label"], r["dim"]): -(-r["count"] // target) for r in large}
        share = spark.createDataFrame([(a, b, min(1.0, 1.2 * SAMPLE_EACH * want[a, b] / c)) for a, b, c in large], "s_label long, s_dim int, share double")
        picked = classes.join(F.broadcast(share), (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")))
        picked = picked.where(F.xxhash64("rep", F.lit(7)) / F.lit(2.0**64) + 0.5 <= F.col("share")).select("label", "dim", "rep", "v").toPandas()
        for key, g in picked.groupby(["label", "dim"]):
            x = vectors.stacked(g.sort_values("rep")["v"])
            centroids[key] = kmeans(x, min(want[key], len(x)))
    shared = spark.sparkContext.broadcast(centroids)
    dealt = stage.put(classes.mapInPandas(_dealt(shared, overlap), DEALT), "dealt")
    dealt = _cut_hot(dealt, stage, overlap)
    graphs = dealt.groupBy("label", "dim", "shard").applyInPandas(_built(threshold), "rep long, near array<long>, far_at array<long>, far_sim array<double>")
    united = graphs.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("far_at", "far_sim")))).alias("far"))
    united = stage.put(united.select(F.col("rep").alias("node"), "near", F.col("far.far_at").alias("far_at"), F.col("far.far_sim").alias("far_sim")), "graph")
    rows = dealt.join(united, F.col("rep") == F.col("node"))
    schema = "kind long, a long, b long, x long, y long"
    found = stage.put(rows.groupBy("label", "dim", "shard").applyInPandas(_searched(threshold, beam, exact), schema), "found")
    nodes = stage.put(rows.where("home").select("label", "dim", "at", "rep", "n", "v", "far_at", "far_sim"), "nodes")
    counted, edges = (found.where(f"kind = {k}") for k in (0, 2))

    def asked(df: DataFrame) -> DataFrame:
        return df.where("kind = 1").select(F.col("a").alias("guest"), F.col("b").alias("shard"), F.col("x").alias("g_label"), F.col("y").cast("int").alias("g_dim")).distinct()

    new = asked(found)
    if exact:
        all_ = stage.put(nodes.select(F.col("label").alias("g_label"), F.col("dim").alias("g_dim"), F.col("at").alias("shard")).distinct(), "shards")
        new = nodes.select("label", "dim", "at", "rep").join(stage.small(all_), (F.col("label") == F.col("g_label")) & (F.col("dim") == F.col("g_dim")) & (F.col("at") != F.col("shard")))
        new = new.select(F.col("rep").alias("guest"), "shard", "g_label", "g_dim")
    seen = new = stage.put(new, "visits")
    while not new.isEmpty():
        # a shard's guests come in parts of some shards' size
        parts = new.groupBy("g_label", "g_dim", "shard").agg(F.ceil(F.count("*") / (4 * SHARD)).alias("parts"))
        parts = stage.put(parts.select(F.col("g_label").alias("p_label"), F.col("g_dim").alias("p_dim"), F.col("shard").alias("p_shard"), "parts"), "parts")
        at = (F.col("label") == F.col("p_label")) & (F.col("dim") == F.col("p_dim"))
        guests = nodes.select("label", "dim", "at", "rep", "v").join(stage.small(new), F.col("rep") == F.col("guest"))
        guests = guests.join(stage.small(parts), at & (F.col("shard") == F.col("p_shard"))).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(13)), F.col("parts")))
        hosts = nodes.join(stage.small(parts), at & (F.col("at") == F.col("p_shard"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        # other names than the hosts' keep the two sides of one table apart
        guests = guests.select("g_label", "g_dim", "shard", "part", "guest", F.col("at").alias("origin"), F.col("v").alias("q")).groupBy("g_label", "g_dim", "shard", "part")
        hosts = hosts.select("label", "dim", "p_shard", "part", "rep", "n", "v", "far_at", "far_sim").groupBy("label", "dim", "p_shard", "part")
        more = stage.put(guests.cogroup(hosts).applyInPandas(_visited(threshold), schema), "found")
        counted, edges = counted.union(more.where("kind = 0")), edges.union(more.where("kind = 2"))
        new = stage.put(asked(more).join(seen.select("guest", "shard"), ["guest", "shard"], "left_anti").select(*new.columns), "visits")
        seen = seen.union(new)
    counted = stage.put(counted.groupBy(F.col("a").alias("rep")).agg(F.sum("x").alias("links")), "links")
    stage.drop(dealt, united)
    return counted, edges.select("a", "b")


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of vectors that can be linked, at unit length; the others are left out."""
    for batch in batches:
        rows = batch.column("v")
        begin = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        x = rows.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become nan
        if not len(x):
            continue
        # scaled by the largest component first, so that no square overflows or vanishes
        good = np.logical_and.reduceat(np.isfinite(x), begin[:-1])
        peak = np.maximum.reduceat(np.abs(x), begin[:-1])
        good &= peak > 0
        keep = np.flatnonzero(good)
        size = np.diff(begin)
        x, peak, size = x[np.repeat(good, size)], peak[keep], size[keep]
        x /= np.repeat(peak, size)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        norm = np.sqrt(np.add.reduceat(x * x, at[:-1])) if len(x) else x
        x = x / np.repeat(norm, size) + 0.0
        taken = batch.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("label"), pa.ListArray.from_arrays(at, x)], ["vec_id", "label", "v"])


def near_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """embeddings (vec_id, embedding, label; others ignored) -> a row for each of its rows: vec_id, n_links,
    component_id, kept, audit_recall.

    Vectors with equal labels are linked at a cosine of threshold or more. A null label, null vec_id, or vector that is
    null, empty, zero or holds null or non-finite components links with nothing: n_links 0, component_id its vec_id.
    Vectors of different lengths are never linked. Rows that repeat a vec_id are one vector, the least by label and
    components. An empty table gives an empty result. audit_recall: the share of the links of some classes that were found,
    against all rows; null if neither these nor 16 times as many have any link.
    """
    spark = embeddings.sparkSession
    stage = Stage(spark, "vectors")
    plain = clean(embeddings, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = plain.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").mapInArrow(_unit, "vec_id long, label long, v array<double>")
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    one = stage.put(one, "rows")
    classes = one.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("v"))
    classes = stage.put(classes, "classes")
    for overlap, beam, exact in PASSES:
        counted, edges = _run(classes, stage, threshold, overlap, beam, exact)
        drawn = classes.select("rep", "label", "dim", "v", F.xxhash64("rep", F.lit(9)).alias("draw"))
        linked = drawn.join(counted.where("links > 0").select(F.col("rep").alias("l_rep")), F.col("rep") == F.col("l_rep"), "left_semi")
        # any classes, and some of those that have links; more of them while none of the sample has a link
        widest = classes.agg(F.max("dim")).first()[0] or 1
        for size in (AUDIT, 4 * AUDIT, 16 * AUDIT):
            size = min(size, max(AUDIT, AUDIT_BYTES // (8 * widest)))
            sample = drawn.orderBy("draw").limit(size).union(linked.orderBy("draw").limit(AUDIT)).toPandas().drop_duplicates("rep")
            probes = {key: (g["rep"].to_numpy(), vectors.stacked(g["v"])) for key, g in sample.groupby(["label", "dim"])}
            truth = classes.mapInPandas(_exact(spark.sparkContext.broadcast(probes), threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("exact"))
            sums = truth.join(counted, "rep", "left").agg(F.sum("exact"), F.sum(F.coalesce("links", F.lit(0)))).first()
            if sums[0]:
                break
        recall = float(sums[1] / sums[0]) if sums[0] else None
        if recall is None or recall >= AUDIT_LEAST:
            break
    comps = connected_components(spark, edges, stage)
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").join(counted.withColumnRenamed("rep", "c_rep"), F.col("rep") == F.col("c_rep"), "left")
    named = named.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    per = stage.put(one.join(named, ["label", "v"]).select(F.col("vec_id").alias("id"), "links", "component"), "result")
    out = plain.select("vec_id").join(stage.small(per), F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
