import random
import re

import numpy as np
import pytest

from nightjar.llm import licenses as L


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words_of(text)
    places, labels = [], set()
    for label, phrase in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def texts():
    r = random.Random(5)
    parts = [p for _, p in L.PHRASES] + ["Released Under the MIT-License.", "CC BY-NC 4.0", "cc\nby", "nc", "Apache License, Version 2.0", "under the", "É mit", "mit license", "x1 y2"]
    rows = [" ".join(r.choice(parts) for _ in range(r.randrange(0, 9))) for _ in range(200)]
    return rows + [None, "", "...", "cc by nc " * 20_000, "under the mit"]


def test_base_places_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id bigint, text string, template string").repartition(3)
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(rows[x.doc_id])
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1
        assert x.score == 1 or not x.base_labels


@pytest.mark.parametrize("limit", [200_000, 0])
def test_edited_notices_are_found_on_merged_diagonals(spark, limit):
    label, notice = L.NOTICES[5]
    w = notice.split()
    edited = " ".join(["intro", *w[:8], "really", *w[8:15], *w[16:], "end"])
    half = " ".join(w[:len(w) // 2])
    far = " ".join([*w[:11], *["gap"] * 40, *w[11:]])
    df = spark.createDataFrame([(1, notice), (2, edited), (3, half), (4, far), (5, "nothing here at all"), (5, notice)], "doc_id bigint, text string")
    got = L.scan(df, least=0.7, broadcast_limit=limit).collect()
    by = {(x.doc_id, x.labels) for x in got}
    assert by == {(1, "gpl"), (2, "gpl"), (3, ""), (4, ""), (5, ""), (5, "gpl")}
    span = next(x for x in got if x.doc_id == 2).spans[0]
    assert (span.label, span.first_word, span.last_word) == ("gpl", 1, len(w))
    assert next(x.score for x in got if x.doc_id == 1) == 1.0


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_each_notice_alone_gives_its_own_label(spark):
    shapes = {
        "plain": lambda w: w, "upper": lambda w: [x.upper() for x in w],
        "one more word": lambda w: [*w[:6], "hereby", *w[6:]], "first word lost": lambda w: w[1:]}
    rows, want = [], {}
    for label, notice in L.NOTICES:
        for name, shape in shapes.items():
            rows.append((len(rows), "some words before, " + " ".join(shape(notice.split())) + ". and some words after"))
            want[len(rows) - 1] = (label, name)
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (label, name) in want.items():
        others = set(got[i].labels.split(",")) - {label, "", "apache-2" if label == "apache-2" else ""}
        assert not others, (label, name, got[i].labels)
        if name in ("plain", "upper"):
            assert got[i].labels == label and got[i].score == 1.0


def test_notices_side_by_side_keep_their_own_labels(spark):
    cc = [n for label, n in L.NOTICES if label.startswith("cc-by")]
    text = " filler words between ".join(cc * 3)
    got = L.scan(spark.createDataFrame([(1, text), (1, text), (2, cc[0])], "doc_id bigint, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.labels for r in by[1]] == ["cc-by,cc-by-nc,cc-by-sa"] * 2 and by[2][0].labels == "cc-by"
    assert len(by[1][0].spans) == 9 and all(s.share == 1.0 for s in by[1][0].spans)


def test_closest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), f"l{rng.integers(4)}", a := int(rng.integers(200)), a + int(rng.integers(5, 20)), float(rng.choice([0.75, 0.8, 0.9, 1.0]))) for _ in range(150)]
    rows = sorted({x[:4]: x for x in rows}.values())
    got = {tuple(r) for r in L.closest(spark.createDataFrame(rows, "row bigint, label string, first_word bigint, last_word bigint, closeness double"), 21).select("row", "label", "first_word", "last_word", "closeness").collect()}
    want = {x for x in rows if not any(y[0] == x[0] and y[2] <= x[3] and y[3] >= x[2] and y[4] > x[4] for y in rows)}
    assert got == want
