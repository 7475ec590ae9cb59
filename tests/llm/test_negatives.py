import math
import random

import numpy as np
import pytest

from nightjar.llm import negatives as N


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    pts = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, label, q in pts:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, other) for i, other, p in pts if i != a and len(p) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(t, i) for t, i, other in scored if other != label and low * -s <= 100 * -t <= high * -s]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits[:negatives], 1)}
    return out


def vectors(n=600, width=6, seed=1):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = r.choice(centers)
        rows.append((i, [x + r.gauss(0, 0.4) for x in c], 3 if i % 3 == 0 else r.randrange(5)))
    hot = [0.5] * width
    rows = [(i, hot if i % 5 == 0 and i % 3 == 0 else v, label) for i, v, label in rows]
    return rows + [(1000, None, 1), (1010, [], 1), (1020, [1.0] * (width - 1) + [None], 2), (1030, [float("nan")] * width, 1), (1040, [float("inf")] * width, 1),
                   (None, hot, 1), (1060, hot, None), (1070, [0.0] * width, 3), (2000, [1.0, 2.0], 1), (2001, [1.0, 1.0], 1), (2002, [0.5, 0.6], 2)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("rows_per_shard,leaf,block,page", [(4096, 64, 256, 512), (40, 4, 7, 3)])
def test_matches_a_full_scan(spark, monkeypatch, rows_per_shard, leaf, block, page):
    for name, value in (("ROWS_PER_SHARD", rows_per_shard), ("LEAF", leaf), ("ANCHORS_PER_BLOCK", block), ("SHARDS_PER_PAGE", page), ("FAN", 3)):
        monkeypatch.setattr(N, name, value)
    df = spark.createDataFrame(vectors(), SCHEMA).selectExpr("*", "'x' as shard", "1 as rank", "2 as width")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = [tuple(x) for x in N.hard_negatives(df, 10).collect()]
    want = brute(rows, 10)
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want


def test_large_numbers_stay_exact_and_larger_ones_raise(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-(2**18), 2**18)) * 4 for _ in range(3)], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(x) for x in N.hard_negatives(df, 10).collect()} == brute(rows, 10)
    with pytest.raises(ValueError):
        N.hard_negatives(df.union(spark.createDataFrame([(500, [1e18] * 3, 1)], SCHEMA)))


def test_few_rows_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2)], SCHEMA)
    assert sorted(tuple(x) for x in N.hard_negatives(df).collect()) == [(0, 1, 1, 2, 256 * 256 + 256 * 230, 256 * 256), (0, 1, 2, 2, 256 * 256 + 256 * 230, 256 * 256)]
    assert N.hard_negatives(df.where("vec_id < 0")).collect() == []
    assert N.hard_negatives(df.where("label = 2")).collect() == []


def test_boxes_shut_out_most_leaves_of_clustered_rows(monkeypatch):
    monkeypatch.setattr(N, "LEAF", 64)
    r = np.random.default_rng(3)
    points = np.concatenate([r.integers(-20, 20, (800, 4)) + c for c in ([300, 0, 0, 0], [-300, 0, 0, 0], [0, 300, 0, 0], [0, -300, 0, 0])]).astype(float)
    labels = np.repeat(np.arange(4), 800)
    order = N.str_order(points, labels, N.LEAF)
    assert sorted(order) == list(range(3200))
    tree = N.RTree(np.arange(3200), labels[order], points[order])
    query = np.array([300.0, 20, 0, 0])
    lower, upper = tree.intervals(query[None, :])
    exact = points[order] @ query
    for leaf in range(3200 // N.LEAF):
        own = exact[leaf * N.LEAF:(leaf + 1) * N.LEAF]
        assert lower[0, leaf] <= own.min() and own.max() <= upper[0, leaf]
    opened = []
    tree.points = type("Counted", (), {"__getitem__": lambda self, at: opened.append(at.stop - at.start) or points[order][at]})()
    found = list(tree.search(query, -1, 0, False, [(2000, 10000)], 10, lower[0], upper[0]))
    fits = np.flatnonzero((labels[order] != 0) & (exact >= 2000) & (exact <= 10000))
    assert sorted(found[0][1].tolist(), reverse=True) == sorted(exact[fits].astype(int).tolist(), reverse=True)[:10]
    assert sum(opened) < 1600
