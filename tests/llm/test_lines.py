import random

import pytest

from nightjar.llm import lines as L


def brute(rows, min_docs):
    def key(x):
        return x.encode().strip(L.WHITE_BYTES).lower()
    count = {}
    for t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {b""}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if count.get(key(x), 0) < min_docs]
        out.append(("\n".join(left), len(own), len(own) - len(left)))
    return out


def texts(n=300, seed=1):
    r = random.Random(seed)
    pool = ["Common line", " common LINE\t", "ÉTÉ", "x", "", "   ", "a b"] + [f"line {i}" for i in range(60)]
    rows = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(n)]
    return rows + [None, "", "\n", "long " * 50_000, "Common line", "Common line"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i % 3, "y") for i, t in enumerate(rows)], "doc_id bigint, text string, n_lines int, key string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_matches_brute_force_in_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "KEYS_PER_SHARD", 7)
    rows = texts()
    got = L.dedup_lines(frame(spark, rows), 10, broadcast_limit=limit)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert got == dict(enumerate(brute(rows, 10)))


def test_deleting_documents_undoes_their_insertion(spark):
    a, b = texts(150, 2), texts(200, 3)
    fa, fb = frame(spark, a), frame(spark, b)
    store = L.LineStore.empty(spark, 10).insert(fa)
    both = store.insert(fb)
    back = both.delete(fb)
    rows = lambda s: sorted((bytes(r.key), r.n_docs) for r in s.counts.collect())
    assert rows(back) == rows(store) and rows(both) != rows(store)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in L.drop_frequent_lines(fa, back).collect()}
    assert got == dict(enumerate(brute(a, 10)))
    got = {r.doc_id: r.text for r in L.drop_frequent_lines(fa, both).collect()}
    assert got == {i: x[0] for i, x in enumerate(brute(a + b, 10)[:len(a)])}


def test_empty_table(spark):
    assert L.dedup_lines(frame(spark, ["x"]).where("doc_id < 0"), 10).collect() == []


def test_filter_keeps_what_was_inserted_and_forgets_what_was_removed():
    keys = [L.line_key(f"k{i}".encode()) for i in range(5000)]
    words = L._as_words(keys)
    f = L.CuckooFilter.sized(5000)
    assert f.insert(words) and f.contains(words).all()
    f.remove(words[:2500])
    assert f.contains(words[2500:]).all() and f.contains(words[:2500]).mean() < 0.01
