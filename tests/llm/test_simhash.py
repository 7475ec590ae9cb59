import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from nightjar.llm import simhash as S


def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(prints, radius=4):
    """Least member reachable, by index, every pair looked at."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    x = np.array(prints, np.uint64)
    for i in range(len(x)):
        for j in (np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1:]) <= radius) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def brute(rows, k=4, radius=4):
    """{doc_id: (fingerprint, component)} of (doc_id, text) with distinct ids."""
    rows = sorted(rows)
    prints = [plain_print(t, k) for _, t in rows]
    return {d: (f"{p:016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, groups_of(prints, radius))}


def test_some_mask_leaves_out_any_four_bits():
    for free in (S.ALL, 0x0F0F0F0F0F0F0F0F, 0xFFFF, 0x8000000000000001):
        masks = S.covering_masks(free, 4)
        assert len(masks) == 31 and all(m & ~free == 0 for m in masks)
        bits = [1 << b for b in range(64) if free >> b & 1]
        pick = random.Random(1)
        sets = list(combinations(bits, 4)) if len(bits) < 20 else [pick.sample(bits, 4) for _ in range(4000)]
        assert all(any(m & sum(s) == 0 for m in masks) for s in sets)
    sizes = [m.bit_count() for m in S.covering_masks(S.ALL, 4)]
    assert min(sizes) >= 32 and max(sizes) <= 34


def test_fingerprint_of_long_texts_goes_by_pieces(monkeypatch):
    r = random.Random(2)
    text = " ".join(r.choice("ab cd EF gh ij KL mn".split()) for _ in range(500))
    whole = plain_print(text)
    monkeypatch.setattr(S, "PIECE", 7)
    assert S.fingerprint(text.encode()) == whole
    for t in ("", " \t\n", "one", "one two three", "a b c d", "É É é x Y z"):
        assert S.fingerprint(t.encode()) == plain_print(t)


def chained(seed, n, center, flips):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = center
        for b in r.sample(range(64), r.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("small", [512, 256])
def test_groups_match_all_pairs(spark, small):
    r = random.Random(5)
    shared = r.getrandbits(64)
    prints = chained(1, 300, r.getrandbits(64), 6) | chained(2, 700, r.getrandbits(64), 9) | {r.getrandbits(64) for _ in range(200)}
    prints |= {(shared & ~0xFFFFFFFF) | r.getrandbits(32) for _ in range(900)}  # one hot bucket of texts that differ in half their bits
    prints |= {0, S.ALL, 1, S.ALL - 1}
    prints = sorted(prints, key=S.signed)
    want = {S.signed(p): S.signed(prints[g]) for p, g in zip(prints, groups_of(prints))}
    df = spark.createDataFrame([(S.signed(p),) for p in prints], "fp bigint")
    got = {x.fp: x.root for x in S.fingerprint_groups(df, 4, small).collect()}
    assert len(set(want.values())) > 50 and {p: got.get(p, p) for p in want} == want


def test_tables_of_buckets_are_never_broadcast(spark, monkeypatch):
    r = random.Random(6)
    prints = sorted(chained(4, 60, r.getrandbits(64), 6) | {r.getrandbits(64) for _ in range(60)})
    plans, written = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    S.fingerprint_groups(spark.createDataFrame([(S.signed(p),) for p in prints], "fp bigint"), 4)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "free#" in line]
    assert len(joins) >= 2 and not any("Broadcast" in line for line in joins)


def test_rows_of_every_kind(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, "One  two\n"), (8, " ".join(base[:150] + ["new"] + base[151:]))]
    rows += [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as fp", "1 as component_id", "2 as root")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in S.near_duplicates(df).collect()}
    assert got == brute(rows) and got[2][1] == 1 and got[5] == ("0" * 16, 3) and got[7][1] == 6


def test_repeated_ids_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "a b"), (None, "x")], "doc_id bigint, text string")
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in S.near_duplicates(df).collect()), key=str)
    key = lambda t: f"{plain_print(t):016x}"
    assert got == sorted([(1, key("a b"), 1), (1, key("c d"), 1), (None, key("a b"), 1), (None, key("x"), None)], key=str)
    assert S.near_duplicates(df.where("false")).collect() == []
