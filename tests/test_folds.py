import numpy as np
import pandas as pd
import pytest

from nightjar.operators import splits as S


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for subject, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        i = loads.index(min(loads))
        loads[i] += n
        out[subject] = i
    return out


def test_turns_follow_the_serial_deal():
    rng = np.random.default_rng(5)
    for _ in range(300):
        k, n = int(rng.integers(1, 9)), int(rng.integers(1, 120))
        sizes = dict(enumerate(int(x) for x in rng.choice([1, 2, 3, 7, 50, 1000], n) * rng.integers(1, 4, n)))
        counts = pd.Series(sizes).value_counts()
        got = {}
        for size, spans in S._turns(sorted(counts.items(), reverse=True), k):
            own = sorted(s for s, x in sizes.items() if x == size)
            for place, subject in enumerate(own):
                first, turn = [x for x in spans if x[0] <= place][-1]
                got[subject] = turn[(place - first) % len(turn)]
        assert got == greedy(sizes, k)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_folds_equal_the_serial_deal(spark, k):
    rng = np.random.default_rng(k)
    sizes = {i: int(rng.integers(1, 4) if i % 3 else rng.integers(1, 60)) for i in range(80)}
    rows = spark.createDataFrame([(s,) for s, n in sizes.items() for _ in range(n)], "subject_id int")
    got = {r.subject_id: r.fold for r in S.group_kfold(rows, k).collect()}
    assert got == greedy(sizes, k)


def test_more_folds_than_subjects_and_no_rows(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "subject_id int")
    assert {r.subject_id: r.fold for r in S.group_kfold(rows, 5).collect()} == {1: 0, 2: 1}
    assert S.group_kfold(rows.where("false"), 5).count() == 0
