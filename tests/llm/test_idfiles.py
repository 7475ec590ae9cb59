import heapq
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nightjar.llm import idfiles as I

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def test_lengths_are_optimal_within_the_limit():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 200):
        counts = (r.pareto(0.7, n) * 5).astype(int) + 1
        free = I.code_lengths(counts, 40)
        assert n == 1 or (free * counts).sum() == plain_huffman_cost(counts.tolist())
        tight = I.code_lengths(counts, 9)
        assert tight.max() <= 9 and (2.0 ** -tight.astype(float)).sum() <= 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    best = I.code_lengths(fib, 5)
    assert best.max() == 5 and (best * fib).sum() == min_limited(fib.tolist(), 5)
    with pytest.raises(ValueError):
        I.code_lengths(np.ones(9, int), 3)


def min_limited(counts, limit):
    """Least cost over all non-increasing length vectors that satisfy the Kraft inequality."""
    from functools import cache
    counts = sorted(counts, reverse=True)

    @cache
    def go(i, least, room):
        if i == len(counts):
            return 0
        best = float("inf")
        for length in range(least, limit + 1):
            need = 1 << (limit - length)
            if need <= room:
                best = min(best, counts[i] * length + go(i + 1, length, room - need))
        return best

    return go(0, 1, 1 << limit)


def test_code_round_trip():
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.3, 5000), 3000)
    code = I.Code(I.code_lengths(np.bincount(ids), 14))
    payload, width, marks = code.encode(np.concatenate([ids, ids[:7]]), np.array([len(ids), 7]))
    assert (code.decode(payload[width[0]:].tobytes(), marks[1], np.array([7])) == ids[:7]).all()
    payload, marks = payload[:width[0]].tobytes(), marks[0]
    each = np.full(len(marks), I.STEP)
    each[-1] = len(ids) - (len(marks) - 1) * I.STEP
    assert (code.decode(payload, marks, each) == ids).all()
    assert (code.decode(payload, marks[3:4], each[3:4]) == ids[3 * I.STEP:4 * I.STEP]).all()


def test_files_give_the_ids_back_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "IDS_PER_BUCKET", 3000)
    monkeypatch.setattr(I, "BLOCK_IDS", 400)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "beta,", "É", "x1"]) for _ in range(r.randrange(0, 90)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "long text " * 20_000), (303, "same"), (None, "no id")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as bucket").repartition(4)
    path = f"file://{tmp_path}/ids"
    I.write_ids(df, path, PATH, 0)
    got = {x.doc_id: x for x in I.read_ids(spark, path).collect()}
    tok, start = Tokenizer.from_file(PATH), 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].value) == (start, len(want), want)
        start += len(want)
    assert spark.read.parquet(f"{path}/blocks").select("bucket").distinct().count() > 3


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d")], "doc_id bigint, text string")
    got = sorted((x.start, x.n_tokens) for x in I.round_trip(df, PATH, 0).collect())
    assert [s for s, _ in got] == np.cumsum([0] + [n for _, n in got])[:-1].tolist() and len(got) == 4
    assert I.round_trip(df.where("doc_id < 0"), PATH, 0).collect() == []
