import random
import re

import numpy as np
import pytest

from nightjar.llm import minhash as M
from nightjar.llm.components import connected_components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=260):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randrange(1, 150))] for _ in range(12)]
    texts = []
    for _ in range(n):
        own = list(r.choice(base))
        for _ in range(r.randrange(0, 1 + len(own) // 18)):
            own[r.randrange(len(own))] = r.choice(words)
        texts.append(" ".join(own).replace("w1 ", "W1\t"))
    texts += [None, "", " \n", "one", "ONE", "one two", "w5 " * 60_000]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80)])
def test_groups_match_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as node", "1 as n_shingles").repartition(4)
    got = sorted(tuple(x) for x in M.near_duplicates(df, k, percent, rows=4 if percent == 80 else 5, bands=30 if percent == 80 else 25).collect())
    assert got == brute(rows, k, percent)


def test_many_blocks_give_the_same_groups(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = M._left_over_links
    monkeypatch.setattr(M, "_left_over_links", lambda m, s, p, least: plain(m, s, p, least, block=3000))
    assert sorted(tuple(x) for x in M.near_duplicates(df).collect()) == brute(rows, 3, 85)


def test_equal_ids_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (4, "other words of text"), (None, "a b c d"), (9, "a b c d")], "doc_id bigint, text string")
    got = [(x.doc_id, x.component_id, x.kept) for x in M.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(4, 4, True)] * 3 + [(None, 4, False), (9, 4, False)], key=str)
    assert M.near_duplicates(df.where("doc_id < 0")).collect() == []


def test_signatures_estimate_similarity_with_less_variance_than_independent_slots():
    r = np.random.default_rng(5)
    error = []
    for _ in range(300):
        both, one, two = (r.integers(1, 1 << 63, n).astype(np.uint64) for n in (16, 8, 8))
        sig = M.superminhash([np.concatenate([both, one]), np.concatenate([both, two])], 64)
        error.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(error)) < 0.02 and np.var(error) < 0.8 * 0.25 / 64


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(6)).collect()}
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
