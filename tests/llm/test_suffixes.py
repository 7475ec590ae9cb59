import random

import pytest

from nightjar.llm import suffixes as S


def brute(rows, length):
    """rows: texts in the order of their ids."""
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, kept))
    return out


def texts(seed, n=120):
    r = random.Random(seed)
    letters = "abé "
    base = ["".join(r.choice(letters) for _ in range(r.randrange(0, 90))) for _ in range(20)]
    rows = []
    for _ in range(n):
        parts = [r.choice(base)[r.randrange(5):] for _ in range(r.randrange(0, 5))]
        own = list("".join(parts))
        for _ in range(r.randrange(3)):
            if own:
                own[r.randrange(len(own))] = r.choice("xyz")
        rows.append("".join(own))
    return rows + [None, "", "ha" * 300, "a" * 500, "a" * 500, rows[0]]


@pytest.mark.parametrize("length,q,seed", [(12, 5, 1), (13, 4, 2), (20, 8, 3), (100, 24, 4)])
def test_matches_brute_force(spark, monkeypatch, length, q, seed):
    rows = texts(seed) if length < 100 else [(t or "") * 6 for t in texts(seed)]
    want = dict(enumerate(brute(rows, length)))
    for flush, chunk in ((1_000_000, 1 << 23), (300, 256)):
        monkeypatch.setattr(S, "FLUSH", flush)
        monkeypatch.setattr(S, "CHUNK", chunk)
        df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(rows)], "doc_id bigint, text string, key binary").repartition(5)
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in S.remove_repeats(df, length, q).collect()}
        assert got == want


def test_equal_and_null_ids_and_empty_table(spark):
    t = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (9, "short"), (9, None)], "doc_id bigint, text string")
    got = S.remove_repeats(df, 20, 6).collect()
    assert sorted(x.n_removed for x in got) == [0, 0, 0, len(t), len(t)]
    assert next(x.n_removed for x in got if x.doc_id is None) == 0
    assert S.remove_repeats(df.where("doc_id < 0"), 20, 6).collect() == []
