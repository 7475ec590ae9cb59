import random

import numpy as np
import pytest

from nightjar.llm import decontaminate as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = r.randrange(3), r.randrange(len(words))
        if kind == 0:
            words[at] = f"new{r.randrange(10 ** 6)}"
        elif kind == 1:
            words.insert(at, f"ins{r.randrange(10 ** 6)}")
        else:
            del words[at]
    return words


def test_closest_run_by_bit_vectors_equals_the_table():
    r = random.Random(3)
    for _ in range(300):
        a = np.array([r.randrange(4) for _ in range(r.randrange(1, 9))], np.uint64)
        b = np.array([r.randrange(4) for _ in range(r.randrange(0, 14))], np.uint64)
        want = min(distance(a.tolist(), b[i:j].tolist()) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        d, end, start = D.closest(a, b)
        assert d == want
        if d < len(a):
            assert distance(a.tolist(), b[start:end].tolist()) == d


@pytest.fixture(scope="module")
def planted():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, [r.choice(vocabulary) for _ in range(r.randrange(10, 60))]) for i in range(60)]
    rows, truth = [], {}
    for d in range(800):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 200))]
        if d % 2 == 0:
            i, own = items[d % 60]
            budget = D.edit_budget(len(own), 0.8)
            edits = r.randrange(0, 2 * budget)
            at = r.randrange(len(words) + 1)
            words[at:at] = edited(r, own, edits)
            truth[d] = (i, edits, budget)
        rows.append((d, " ".join(words).replace("w1 ", "W1,\n")))
    return items, rows, truth


def test_all_true_pairs_are_found_and_nothing_else(spark, planted):
    items, rows, truth = planted
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "x " * 200_000)], "doc_id bigint, text string").selectExpr("*", "'a' as item_id", "0 as distance")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(100, None), (101, ""), (102, "too short")], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in D.contamination(docs, bench).collect()}
    own = dict(items)
    import re
    words = {d: re.findall(r"[a-z0-9]+", t.lower()) for d, t in rows}
    for (d, i), x in got.items():
        assert x.distance <= D.edit_budget(len(own[i]), 0.8)
        assert distance(own[i], words[d][x.first_word:x.last_word + 1]) == x.distance
    near = {(d, i) for d, (i, e, b) in truth.items() if e <= b}
    assert len(near - set(got)) <= 0.03 * len(near)
    assert all(i == truth[d][0] for d, i in got)
    split = D.contamination(docs, bench, words_per_block=200)
    assert {(x.doc_id, x.item_id) for x in split.collect()} == set(got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert D.contamination(docs, bench.where("item_id < 0")).count() == 0
    assert D.contamination(docs.where("doc_id < 0"), bench).count() == 0
    assert D.contamination(docs.union(docs), bench).count() == 2


def test_case_is_folded_beyond_ascii(spark):
    item = "ación número señal über straße größe élan forêt où años σοφός λόγος"
    docs = spark.createDataFrame([(1, f"before {item.upper()} after"), (2, item), (3, item.title())], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, item.upper())], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.distance, x.first_word, x.last_word) for x in D.contamination(docs, bench).collect()}
    assert got == {(d, i): (0, int(d == 1), 11 + int(d == 1)) for d in (1, 2, 3) for i in (1, 2)}
