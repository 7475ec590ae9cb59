"""Closed-form cases of stages, labels, summaries and positional windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.functions import expressions as X
from nightjar.operators import epochs as E
from nightjar.operators.chunks import islands


def night(spark, stages, labels, subject=1):
    rows = [(subject, i, s, l) for i, (s, l) in enumerate(zip(stages, labels))]
    return spark.createDataFrame(rows, "subject_id int, epoch_idx int, sleep_stage string, apnoea_label int")


def test_sleep_mask_truth_table(spark):
    d = night(spark, ["W", "N1", "N2", "N3", "REM", "?"], [0] * 6)
    got = [r[0] for r in d.orderBy("epoch_idx").select(X.is_sleep("sleep_stage")).collect()]
    assert got == [False, True, True, True, True, False]


def test_night_summary_counts_only_sleep_events(spark):
    r = E.night_summary(night(spark, ["W", "N1", "N2", "REM", "W"], [0, 1, 0, 1, 0])).first()
    assert (r.tst_min, r.tib_min, r.sleep_efficiency, r.n_apnoea_epochs, r.ahi_proxy_per_hr, r.waso_min) == (1.5, 2.5, 0.6, 2, 80.0, 0.5)


def test_night_summary_without_sleep(spark):
    r = E.night_summary(night(spark, ["W"] * 4, [1] * 4)).first()
    assert r.sleep_efficiency == 0.0 and r.ahi_proxy_per_hr is None and r.n_apnoea_epochs == 0


def test_unknown_stage_is_an_error(spark):
    with pytest.raises(Exception, match="unknown stage"):
        night(spark, ["S9"], [0]).select(X.encode_stage("sleep_stage")).collect()


def events(spark, rows):
    return spark.createDataFrame([(1, float(s), float(d), k, i) for i, (s, d, k) in enumerate(rows)],
                                 "subject_id int, start_sec double, duration_sec double, kind string, event_seq int")


def test_two_short_events_do_not_add_up(spark):
    ep = night(spark, ["N2", "N2"], [0, 0]).drop("apnoea_label")
    d = E.label_epochs(ep, events(spark, [(0, 6, "Hypopnea"), (15, 6, "Hypopnea")]))
    assert [r.apnoea_label for r in d.orderBy("epoch_idx").collect()] == [0, 0]
    d = E.label_epochs(ep, events(spark, [(25, 15, "Hypopnea")]))
    assert [r.apnoea_label for r in d.orderBy("epoch_idx").collect()] == [0, 1]


@pytest.mark.parametrize("start,dur,want", [(35, 16, range(35, 51)), (35.5, 10, range(35, 45)), (35.6, 10, range(36, 46)),
                                            (10.2, 0.2, []), (10.4, 0.2, [10]), (-5, 7, [0, 1]), (58, 9, [58, 59])])
def test_second_mask_uses_midpoints(spark, start, dur, want):
    nights = spark.createDataFrame([(1, 2)], "subject_id int, n_epochs int")
    got = sorted(r.sec for r in E.event_seconds(events(spark, [(start, dur, "Mixed apnea")]), nights).collect())
    assert got == list(want)


def test_second_mask_ors_kinds(spark):
    nights = spark.createDataFrame([(1, 2)], "subject_id int, n_epochs int")
    ev = events(spark, [(5, 10, "Obstructive apnea"), (8, 4, "Hypopnea"), (500, 5, "Hypopnea")])
    got = {r.sec: r.mask for r in E.event_seconds(ev, nights).collect()}
    assert got[5] == 1 and got[9] == 9 and max(got) == 14


def test_second_mask_groups_minutes_not_seconds(spark):
    """Long and overlapping events over many minutes, against a plain mask; what is grouped is a row a minute."""
    rng = np.random.default_rng(9)
    kinds = list(X.EVENT_BITS)
    rows = [(float(np.round(rng.uniform(-20, 900), 1)), float(np.round(rng.choice([0.3, 12, 70, 400]), 1)), kinds[k % 4]) for k in range(25)] + [(0.0, 60.0, kinds[0]), (59.5, 0.5, kinds[1])]
    want = {}
    for start, dur, kind in rows:
        for sec in range(900):
            if start <= sec + 0.5 < start + dur:
                want[sec] = want.get(sec, 0) | X.EVENT_BITS[kind]
    d = E.event_seconds(events(spark, rows), spark.createDataFrame([(1, 30)], "subject_id int, n_epochs int"))
    assert {r.sec: r.mask for r in d.collect()} == want and d.dtypes == [("subject_id", "int"), ("sec", "bigint"), ("mask", "int")]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [subject_id" in plan and "minute" in plan[plan.index("Aggregate [subject_id"):].split("\n")[0]


def test_stage_runs_overwrite_and_round_half_even(spark):
    runs = spark.createDataFrame([(1, 0.0, 75.0, "N1", 0), (1, 30.0, 30.0, "W", 1), (1, 120.0, 5.0, "REM", 2)],
                                 "subject_id int, start_sec double, duration_sec double, stage string, run_seq int")
    nights = spark.createDataFrame([(1, 6)], "subject_id int, n_epochs int")
    got = [r.sleep_stage for r in E.align_to_spine(nights, E.expand_stage_runs(runs), {"sleep_stage": "?"}).orderBy("epoch_idx").collect()]
    assert got == ["N1", "W", "?", "?", "REM", "?"]


def series(spark, n=60, subjects=(1, 2), seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"subject_id": s, "epoch_idx": np.arange(n), "x": rng.normal(size=n)}) for s in subjects])
    pdf.loc[rng.random(len(pdf)) < 0.1, "x"] = np.nan
    d = spark.createDataFrame(pdf)
    return pdf, d.withColumn("x", X.missing_to_null("x"))


@pytest.mark.parametrize("size", [7, 13, 4096])
def test_context_equals_pandas_whatever_the_chunk(spark, size):
    pdf, d = series(spark)
    got = E.contextual(d, ["x"], size).toPandas().sort_values(["subject_id", "epoch_idx"]).reset_index(drop=True)
    g = pdf.groupby("subject_id")["x"]
    want = {"x_lag1": g.shift(1), "x_lead1": g.shift(-1)}
    for w in (5, 11):
        roll = g.rolling(w, center=True, min_periods=1)
        want[f"x_roll{w}_mean"], want[f"x_roll{w}_std"] = roll.mean(), roll.std()
    assert len(got) == len(pdf)
    for c, v in want.items():
        np.testing.assert_allclose(got[c].to_numpy(float), v.to_numpy(float), atol=1e-12, err_msg=c)


@pytest.mark.parametrize("size", [11, 4096])
def test_past_context_never_looks_ahead(spark, size):
    pdf, d = series(spark, seed=1)
    got = E.past_context(d, ["x"], size=size).toPandas().sort_values(["subject_id", "epoch_idx"])
    want = pdf.groupby("subject_id")["x"].rolling(11, min_periods=1).mean().to_numpy()
    np.testing.assert_allclose(got["x_past_roll11_mean"].to_numpy(float), want, atol=1e-12)


def test_stage_filter_stays_above_the_window(spark, sf):
    from nightjar.plans import views as V

    d = E.past_context(V.epochs(spark, sf), ["x"]).where(X.is_sleep("sleep_stage"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sleep_stage") < plan.index("Window")


@pytest.mark.parametrize("size", [5, 8, 1000])
def test_islands_and_run_counts_cross_chunks(spark, size):
    rng = np.random.default_rng(3)
    flag = rng.random(200) < 0.6
    d = spark.createDataFrame([(1, i, bool(f), float(i)) for i, f in enumerate(flag)], "subject_id int, pos int, f boolean, v double")
    got = sorted((r.start, r.length, r.lo, r.first) for r in islands(d, ["subject_id"], "pos", F.col("f"), {"lo": ("v", "min"), "first": ("v", "first")}, size).collect())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(int), [0]])))
    want = [(int(a), int(b - a), float(a), float(a)) for a, b in zip(edges[::2], edges[1::2])]
    assert got == want
    n = E.count_runs(d, F.col("f"), ["subject_id"], pos="pos", size=size).first()[1]
    assert n == len(want)


def test_trim_window_keeps_margin(spark):
    d = night(spark, ["W"] * 5 + ["N2", "?", "N2"] + ["W"] * 5, [0] * 13)
    assert [r.epoch_idx for r in E.trim_window(d, 2).orderBy("epoch_idx").collect()] == [3, 4, 5, 7, 8, 9]


def test_second_to_epoch_rules(spark):
    p = [0.1] * 10 + [0.8] * 9 + [0.2] + [0.9] * 10
    d = spark.createDataFrame([(p,)], "p array<double>")
    r = d.select(*[X.seconds_to_epoch("p", a).alias(a) for a in X.AGGREGATORS]).first()
    assert r["max"] == 0.9 and r.k10 == 0.9 and r.c10 == 0.9 and abs(r["mean"] - np.mean(p)) < 1e-12


def test_normal_cdf_against_erf(spark):
    import math

    zs = [-4.0, -1.96, -0.3, 0.0, 0.7, 2.5, 5.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(X.normal_cdf(F.col("z"))).collect()]
    np.testing.assert_allclose(got, [0.5 * (1 + math.erf(z / 2 ** 0.5)) for z in zs], atol=1e-7)
