import math
import random

import pytest

from nightjar.llm import topk as K


def brute(rows, k, every):
    pts = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in pts:
        if q % every == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in pts if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def vectors(n=400, width=6, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(width)]) for i in range(n)]
    hot = [0.5] * width
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    return rows + [(1000, None), (1010, []), (1020, [1.0] * (width - 1) + [None]), (1030, [float("nan")] * width), (1040, [float("inf")] * width), (None, hot), (1050, [0.0] * width)]


@pytest.mark.parametrize("rows_per_shard,leaf", [(4096, 64), (37, 3)])
def test_matches_a_full_scan(spark, monkeypatch, rows_per_shard, leaf):
    monkeypatch.setattr(K, "ROWS_PER_SHARD", rows_per_shard)
    monkeypatch.setattr(K, "LEAF", leaf)
    monkeypatch.setattr(K, "QUERIES_PER_BLOCK", 7)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "'x' as rank")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = [tuple(x) for x in K.top_k(df, 5, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert {tuple(x) for x in K.top_k(df).collect()} == brute([(r.vec_id, r.embedding) for r in df.collect()], 5, 50)
    assert K.top_k(df.where("vec_id < 0")).collect() == []
    with pytest.raises(ValueError):
        K.top_k(df.union(spark.createDataFrame([(2, [1.0])], df.schema)))


def test_bounds_cut_most_of_a_clustered_shard():
    import numpy as np
    r = np.random.default_rng(3)
    pts = np.concatenate([r.integers(-20, 20, (500, 4)) + c for c in ([300, 0, 0, 0], [-300, 0, 0, 0], [0, 300, 0, 0], [0, -300, 0, 0])]).astype(np.int64)
    tree = K.KdTree(pts)
    seen = []
    order = tree.order

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return super().__getitem__(at)

    tree.order = order.view(Counted)
    tree.search(np.array([256, 1, 0, 0]), 5, np.arange(2000), -1, np.iinfo(np.int64).min)
    assert len(seen) * K.LEAF < 1000
