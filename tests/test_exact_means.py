"""Means that decide a tie depend on the values, not on the order of the rows."""

from datetime import datetime, timedelta

import numpy as np
from nightjar.catalog.metrics import _indices_with_references
from nightjar.operators.oxygen import search_windows


def test_equal_values_give_equal_references(spark, tmp_path):
    values = {1: (0.1, 0.2, 0.3), 2: (0.3, 0.2, 0.1), 3: (0.2, 0.3, 0.1)}
    start = datetime(2024, 1, 1)
    rows = [(100 * u + i, start + timedelta(minutes=i), u, "view", x) for u, xs in values.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = _indices_with_references(spark, str(tmp_path)).select("rdi0p").collect()
    assert len(got) == 3 and len({r.rdi0p for r in got}) == 1


def test_equal_peaks_of_a_search_window_stay_equal(spark):
    """Every offset before the end holds the same values in another order of the events; the earliest of equal peaks counts."""
    r = np.random.default_rng(5)
    events, signal = [], []
    for subject in range(12):
        values = np.round(r.uniform(85, 95, 30), 1)
        for o in range(-20, 30):
            for i, x in enumerate(r.permutation(values) if o < 0 else np.full(30, 99.0 if o == 9 else 80.0)):
                signal.append((subject, 100 + 60 * i + o, float(x)))
        events += [(subject, float(90 + 60 * i), 10.0, "Hypopnea", i) for i in range(30)]
    ev = spark.createDataFrame(events, "subject_id bigint, start_sec double, duration_sec double, kind string, event_seq bigint")
    sig = spark.createDataFrame(signal, "subject_id bigint, sec int, value double")
    assert {(x.lo_sec, x.hi_sec) for x in search_windows(ev, sig, pre=20, post=30, default=(3, 10)).collect()} == {(20, 9)}


def test_a_beat_on_the_border_belongs_to_the_next_epoch(spark):
    """Hundredths of a millisecond that add up to 28,500 ms, which their float sum misses."""
    from nightjar.operators import heart as H

    rr = [742.6, 973.73, 902.02, 712.4, 1061.38, 1008.26, 933.49, 624.52, 847.7, 731.33, 827.36, 664.89, 734.84, 975.77, 1041.81, 883.73, 987.58, 727.21, 922.66, 668.43, 1036.44, 855.63, 794.03, 930.37, 927.54, 611.27, 813.21, 1001.16, 863.66, 784.38, 611.85, 702.86, 731.63, 864.26]
    d = spark.createDataFrame([(1, k, 0, x) for k, x in enumerate(rr + [800.0] * 5)], "subject_id int, beat int, part int, rr double")
    valid = H.rr_validity(d, spark.createDataFrame([(1, 1.5)], "subject_id int, t0 double"))
    assert valid.where(f"pos = {len(rr) - 1}").first().t == 30.0
    assert valid.where("floor(t / 30) = 1").agg({"pos": "min"}).first()[0] == len(rr) - 1
