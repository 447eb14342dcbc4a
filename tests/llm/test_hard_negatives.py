"""Hard negatives against brute force, with every awkward row."""

import random

import numpy as np
import pytest

pytest.importorskip("webgrain.llm")

from pyspark.sql import functions as F  # noqa: E402

from webgrain.llm import hard_negatives as hn  # noqa: E402
from webgrain.llm.staging import Stage  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, x int, block int, score string"


def rows(n=400, width=12, seed=1):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for k in range(n):
        v = [x + rng.gauss(0, 0.4) for x in rng.choice(base)]
        out.append((k, v if k % 37 else None, k % 4 if k % 23 else None, 1, 2, "x"))
    out += [(1000 + k, out[1][1], k % 2, 0, 0, "") for k in range(8)]  # ties
    out += [(2000, [float("nan")] * width, 1, 0, 0, ""), (2010, [0.0] * width, 1, 0, 0, ""), (2020, [1.0], 1, 0, 0, ""), (2030, [], 1, 0, 0, ""), (2040, [1e300] * width, 1, 0, 0, ""), (None, out[1][1], 1, 0, 0, "")]
    return out + [out[20], out[20], (30, [0.5] * width, 3, 0, 0, "")]


def clamped(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def brute(table, positives, negatives, factor, low, high):
    found = {}
    for d, v, label, *_ in table:
        if d is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (label, [clamped(int(np.floor(x * factor))) for x in v])
        found[d] = min(row, found.get(d, row))
    out = set()
    for a, (label, q) in found.items():
        if a % 10:
            continue
        scores = {d: sum(x * y for x, y in zip(q, v, strict=True)) for d, (_, v) in found.items() if d != a and len(v) == len(q)}
        same = sorted((-s, d) for d, s in scores.items() if found[d][0] == label)[:positives]
        for s, p in same:
            s = clamped(-s)
            fits = sorted((-n, d) for d, n in scores.items() if found[d][0] != label and low * s <= 100 * n <= high * s)[:negatives]
            out |= {(a, p, k + 1, d, s, clamped(-n)) for k, (n, d) in enumerate(fits)}
    return out


@pytest.mark.parametrize(("block", "scores"), [(1 << 13, 1 << 20), (16, 40)])
def test_equals_brute_force(spark, monkeypatch, block, scores):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64 if block < 100 else block)
    monkeypatch.setattr(hn, "SCORES", scores)
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, 4, 3, 256, 50, 95).collect()
    want = brute(table, 4, 3, 256, 50, 95)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300


def test_copies_of_anchors_are_not_broadcast(spark):
    stage = Stage(spark, "hard-negatives")
    blocks = stage.put(hn._blocks(hn.usable(spark.createDataFrame(rows(), SCHEMA), 256), 7), "blocks")
    met = hn._meet(stage, blocks, blocks, (7, 7), hn._positives(3))
    assert met.count() > 300
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_rows(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("most", [1, 300, 1 << 40, (1 << 63) - 1])
def test_nothing_that_qualifies_is_dropped(most):
    rng = np.random.default_rng(most % 97)
    x = rng.integers(-most, most, (200, 9), dtype=np.int64, endpoint=True)
    q = rng.integers(-most, most, (5, 9), dtype=np.int64, endpoint=True)
    exact = x.astype(object) @ q.astype(object).T
    took = 0
    for i, own, score in hn.survivors(hn.Sliced(x), q, np.arange(200), [hn.among_best(7)] * 5):
        best = sorted(exact[:, i])[-7]
        assert set(np.flatnonzero(exact[:, i] >= best)) <= set(own) and [int(s) for s in score] == [int(s) for s in exact[own, i]]
        took += len(own)
    assert took < 1000
    windows = [(int(sorted(exact[:, 0])[90]), int(sorted(exact[:, 0])[120])), (5, 4)]
    for i, own, _ in hn.survivors(hn.Sliced(x), q, np.arange(200), [hn.among_best_within(windows, 2)] * 5):
        inside = sorted(s for s in exact[:, i] if windows[0][0] <= s <= windows[0][1])
        assert {k for k in range(200) if inside and inside[-2:][0] <= exact[k, i] <= windows[0][1]} <= set(own)
