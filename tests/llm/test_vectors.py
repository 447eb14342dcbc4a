"""Vector operators against brute force."""

import math
import random

import pytest

pytest.importorskip("webgrain.llm")
np = pytest.importorskip("numpy")

from webgrain.llm import topk, vector_dedup  # noqa: E402
from webgrain.llm.components import connected_components  # noqa: E402
from webgrain.llm.staging import Stage  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, n int, score string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    out = []
    for k in range(600):
        v = centres[k % 30] + rng.normal(size=16) * (0.05 if k % 3 else 1.0)
        out.append((k, [float(np.float32(x)) for x in v], int(k % 4), 1, "clash"))
    out += [(1000 + k, out[5][1], out[5][2], 1, "copy") for k in range(40)]
    out += [(2000, None, 1, 1, ""), (2100, [0.0] * 16, 1, 1, ""), (2200, [None] + [1.0] * 15, 1, 1, ""), (2300, [math.nan] * 16, 1, 1, ""), (2400, [math.inf] * 16, 1, 1, ""), (2500, out[5][1], None, 1, ""), (2600, [1.0, 2.0], 1, 1, ""), (2700, [], 1, 1, "")]
    out.append((None, out[5][1], 1, 1, ""))
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, rows, small, monkeypatch):
    if small:
        monkeypatch.setattr(topk, "SHARD_ROWS", 100)
        monkeypatch.setattr(topk, "QUERY_ROWS", 3)
        monkeypatch.setattr(topk, "PILOT_ROWS", 50)
        monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    vs = {i: [math.floor(1024 * x) for x in v] for i, v, *_ in rows if i is not None and usable(v)}
    want = []
    for q, x in vs.items():
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vs.items() if i != q and len(y) == len(x))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_topk_meets_every_shard_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (200, 6))
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.enabled": "false"}
    held = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), factor=1).collect()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    best = {q: sorted((-int(x[q] @ x[i]), i) for i in range(200) if i != q)[:10] for q in range(0, 200, 20)}
    assert got == [(q, r + 1, i, -s) for q in best for r, (s, i) in enumerate(best[q])]


def test_essential_terms_follow_the_threshold():
    rest = np.array([20, 12, 7, 3, 0])
    assert [topk.essential(rest, x) for x in (21, 13, 8, 7, 1, 0, -5, None)] == [0, 1, 2, 3, 4, 4, 4, 4]


def brute(rows, least):
    unit = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and usable(v) and any(v):
            unit[i] = (label, np.array(v) / np.linalg.norm(v))
    parent, links = {r[0]: r[0] for r in rows if r[0] is not None}, {r[0]: 0 for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (la, x) in unit.items():
        for b, (lb, y) in unit.items():
            if a < b and la == lb and len(x) == len(y) and x @ y >= least:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in parent}


@pytest.mark.parametrize("shard", [1500, 40])
def test_vector_dedup(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_dedup.near_vectors(df).collect()
    links, comps = brute(rows, 0.93)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert found >= 0.97 * sum(links.values()) > 0
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert r.n_links <= links[r.vec_id] and comps[r.vec_id] <= r.component_id <= r.vec_id
    if shard == 1500:
        assert all(r.n_links == links[r.vec_id] and r.component_id == comps[r.vec_id] for r in got if r.vec_id is not None)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def dense(kind):
    """A ball, or an arc, that is much larger than a shard."""
    rng = np.random.default_rng(12)
    if kind == "ball":
        x = rng.normal(size=24) + rng.normal(size=(700, 24)) * 0.05
    else:
        turn = np.linspace(0, 2 * np.pi, 700)
        x = np.stack([np.cos(turn), np.sin(turn)], 1) @ np.linalg.qr(rng.normal(size=(8, 2)))[0].T
    return [(k, [float(np.float32(y)) for y in v], 1, 1, "") for k, v in enumerate(x)]


@pytest.mark.parametrize(("kind", "passes"), [("ball", slice(0, 1)), ("arc", slice(0, 1)), ("ball", slice(2, 3))])
def test_vector_dedup_across_shards(spark, kind, passes, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 25)
    monkeypatch.setattr(vector_dedup, "PASSES", vector_dedup.PASSES[passes])
    rows = dense(kind)
    links, comps = brute(rows, 0.93)
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (links[k], comps[k]) for k in links}
    assert got[0].audit_recall == 1.0


def test_hot_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 25)
    monkeypatch.setattr(vector_dedup, "MAX_CENTROIDS", 2)
    monkeypatch.setattr(vector_dedup, "PASSES", vector_dedup.PASSES[:1])
    cut, sizes = vector_dedup._cut_hot, []

    def seen(dealt, stage, overlap):
        out = cut(dealt, stage, overlap)
        sizes.append((dealt.select("shard").distinct().count(), out.select("shard").distinct().count(), out.where("home").count()))
        return out

    monkeypatch.setattr(vector_dedup, "_cut_hot", seen)
    rows = dense("ball")
    links, comps = brute(rows, 0.93)
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (links[k], comps[k]) for k in links}
    assert sizes[0][0] < sizes[0][1] and sizes[0][2] == len(rows)


def test_links_are_symmetric_and_counted():
    rng = np.random.default_rng(5)
    for n in (1, 9, 300):
        found = rng.random((n, n)) < 2 / n
        np.fill_diagonal(found, False)
        links = vector_dedup.Links(n)
        for a in range(0, n, 256):
            links.add(a, found[a : a + 256])
        both, weight = found | found.T, rng.integers(1, 5, n)
        assert links.weights(n, weight).tolist() == (both @ weight).tolist()
        names = rng.permutation(n) + 100
        group = names.copy()
        for _ in range(n):
            group = np.array([min([group[i], *group[both[i]]]) for i in range(n)])
        assert links.groups(names).tolist() == group.tolist()


def test_graph_finds_the_range():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 32)), rng.normal(size=32) + rng.normal(size=(200, 32)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vector_dedup.build(x)
    assert (graph != np.arange(len(x))[:, None]).all()
    ids, _ = vector_dedup.greedy(x, graph, vector_dedup.medoids(x), x)
    assert (ids[:, 0] == np.arange(len(x))).mean() > 0.95


@pytest.mark.parametrize("one_task", [1 << 20, -1])
def test_components(spark, one_task):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(300)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges + [(None, 3), (3, None)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(spark, df, Stage(spark, "test"), one_task).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark, df.limit(0), Stage(spark, "test"), one_task).count() == 0


def test_an_audit_that_meets_no_link_measures_nothing(spark):
    rows = [(k, [float(k == j) for j in range(40)], 1, 1, "") for k in range(40)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.n_links for r in got} == {0} and {r.audit_recall for r in got} == {None}
