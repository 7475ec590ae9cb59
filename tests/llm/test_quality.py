import math
import random
from collections import Counter

import numpy as np

from nightjar.llm import quality as Q


def corpus(seed=1, n=600):
    r = random.Random(seed)
    good, bad = [f"word{i}" for i in range(80)], [f"JUNK{i}!!" for i in range(40)]
    rows, labels = [], []
    for d in range(n):
        junk = d % 5 == 0
        rows.append((d, " ".join(r.choice(bad if junk and r.random() < 0.7 else good) for _ in range(r.randrange(5, 80))), d % 2, "x"))
        if d % 3:
            labels.append((d, 0 if junk else 1, 0, 7))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id bigint, text string, kept int, key string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text int"))


def test_junk_goes_and_the_rest_stays(spark):
    rows, labels = corpus()
    docs, labs = frames(spark, rows + [(1000, None, 0, ""), (1001, "", 0, ""), (None, "word1 word2", 0, ""), (1002, "word3 " * 100_000, 0, ""), (1003, rows[1][1], 0, ""), (1003, rows[1][1], 0, "")], labels)
    got = Q.resample(docs, labs).collect()
    assert len(got) == 606
    held = [x for x in got if x.doc_id is not None and x.doc_id < 600 and x.doc_id % 3 == 0]
    assert np.mean([x.kept == (x.doc_id % 5 != 0) for x in held]) >= 0.99
    assert {x.log_ratio for x in got if x.doc_id in (1000, 1001)} == {0.0}
    kept = Q.fit(docs, labs).keep(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted(x.doc_id for x in got if x.kept and x.doc_id is not None)


def test_scores_equal_a_plain_model(spark):
    rows, labels = corpus(2, 200)
    docs, labs = frames(spark, rows, labels)
    bits, prior, damping = 10, 3.0, 8.0
    grams = {}
    for d, t, *_ in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        grams[d] = Q.ngram_buckets(data, np.array([0, len(data)]), bits)[1].tolist()
    from pyspark.sql import functions as F
    use = Q._labelled(labs, 60_000, F.expr("quality = 1 and toxic = 0"), F.expr("quality = 0"))
    raw = Counter(g for own in grams.values() for g in own)
    target = Counter(g for d, own in grams.items() if use.get(d) == "fit" for g in own)
    share = sum(target.values()) / sum(raw.values())
    want = {d: sum(math.log((target[g] + prior) / (raw[g] * share + prior)) for g in own) / (len(own) + damping) for d, own in grams.items()}
    got = {x.doc_id: x.log_ratio for x in Q.resample(docs, labs, bits=bits).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_kth_largest_is_exact_with_ties(spark):
    r = random.Random(4)
    xs = [round(r.gauss(0, 1), 1) for _ in range(3000)] + [7.25] * 500
    df = spark.createDataFrame([(x,) for x in xs], "key double")
    for k in (1, 400, 501, 1700, 3500):
        assert Q._kth_largest(df, k, bins=8, few=50) == sorted(xs, reverse=True)[k - 1]


def test_without_labels_or_rows(spark):
    rows, labels = corpus(3, 30)
    docs, labs = frames(spark, rows, labels)
    assert all(x.kept for x in Q.resample(docs, labs.where("quality = 1")).collect())
    assert Q.resample(docs.where("doc_id < 0"), labs).collect() == []
    assert Q.fit(docs, labs.where("quality = 9")).keep(docs).count() == 30
