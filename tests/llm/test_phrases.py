import random
import re
from collections import Counter

import numpy as np
import pytest

from nightjar.llm import phrases as P


def brute(rows, longest=5, least=100, percent=100, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) of (lang, text), every containment looked at."""
    out = []
    counts: dict = {}
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            own.update(tuple(words[i:i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = [g for g, c in f.items() if len(g) > 1 and c >= least]
        scored = []
        for g in candidates:
            a = f[g]
            if any(len(h) > len(g) and 100 * f[h] >= percent * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h in candidates):
                continue
            score, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("ids", [50, 2000])
def test_tiles_count_as_a_dictionary_does(monkeypatch, ids):
    monkeypatch.setattr(P, "TILE", 16)
    r = np.random.default_rng(4)
    left, right = (np.minimum(r.zipf(1.4, 5000), ids).astype(np.int64) for _ in range(2))
    a, b, n, number = P.count_pairs(left, right)
    want = Counter(zip(left.tolist(), right.tolist()))
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and len(a) == len(want)
    assert (a[number] == left).all() and (b[number] == right).all()


def test_widths():
    for top in (0, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**40):
        x = np.array([0, top, top // 2], np.int64)
        assert (P.unpack(P.pack(x)) == x).all()
    assert len(P.unpack(P.pack(np.zeros(0, np.int64)))) == 0


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "\U0001f600", "a\x00b"]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(["The quick Brown fox jumps over", "once upon a time", "in \t spite  of", r.choice(words), r.choice(words[:6])]) + r.choice([" ", " ", " ", ". ", "\n", "!", "\x0b", ", "])
        rows.append((r.choice(["en", "en", "de", None, ""]), text))
    return rows + [("en", None), ("en", ""), ("de", " .,\n"), (None, "x"), ("en", "hot cold " * 3000), ("en", "hot cold " * 3000)]


@pytest.mark.parametrize("block,least,percent", [(2 << 20, 20, 100), (500, 5, 80)])
def test_matches_a_plain_count(spark, monkeypatch, block, least, percent):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "LOT", 1000)
    monkeypatch.setattr(P, "TILE", 8)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).selectExpr("*", "1 as n", "'x' as phrase", "2 as lot")
    got = P.collocations(df, 5, least, percent, 50)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}
    want = brute(rows, 5, least, percent, 50)
    assert len(want) > 30 and sorted(tuple(x) for x in got.collect()) == want


def test_no_rows_and_no_candidates(spark):
    df = spark.createDataFrame([("en", "a b a b a b")], "lang string, text string")
    assert P.collocations(df.where("false")).collect() == []
    assert P.collocations(df, least=100).collect() == []
    assert [tuple(x) for x in P.collocations(df, least=3).collect()] == brute([("en", "a b a b a b")], least=3)


def test_products_beyond_64_bits(spark):
    """The score's own expression on counts of a very large corpus."""
    levels = [spark.createDataFrame([("en", 0, None, None, "x", "x", 4 * 10**12, [4 * 10**12], [4 * 10**12]), ("en", 1, None, None, "y", "y", 5 * 10**12 + 1, [5 * 10**12 + 1], [5 * 10**12 + 1])],
                                    "lang string, id bigint, left bigint, right bigint, phrase string, tail string, a bigint, pre array<bigint>, suf array<bigint>"),
              spark.createDataFrame([("en", 0, 0, 1, "x y", "y", 3 * 10**12 + 7, [4 * 10**12, 3 * 10**12 + 7], [3 * 10**12 + 7, 5 * 10**12 + 1])],
                                    "lang string, id bigint, left bigint, right bigint, phrase string, tail string, a bigint, pre array<bigint>, suf array<bigint>")]
    n = 25 * 10**12 + 3
    words = spark.createDataFrame([("en", n)], "lang string, n bigint")
    was = P.frequent_phrases
    P.frequent_phrases = lambda *a: (levels, words)
    try:
        row = P.collocations(words).first()
    finally:
        P.frequent_phrases = was
    assert row.score == 1000 * (3 * 10**12 + 7) * n // (4 * 10**12 * (5 * 10**12 + 1))
