"""Physical plans, skewed input and whole survival analyses."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar import catalog
from nightjar.operators import epochs as E
from nightjar.operators import metrics as M

catalog.load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["night_summary", "interval_labels", "event_context", "contextual_features", "auc_heavy_ties", "harrell_concordance",
                                  "aligned_runs", "calibration_equal_width", "censored_brier", "hypoxic_burden", "gathered_windows"])
def test_no_cross_product(spark, sf, name):
    p = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_every_query_has_a_registered_name_and_columns(spark, sf):
    assert len(catalog.QUERIES) > 150 and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_scan_reads_only_needed_columns(spark, sf):
    from nightjar.plans import views as V

    p = plan(M.discrimination(V.score_big(spark, sf), []))
    # the pre-aggregate is written once; its scan of the input is pruned to two columns
    src = plan(M.score_counts(V.score_big(spark, sf), [], "apnoea_label", "pred_prob"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in src and "lineitem" not in p


def test_filters_reach_the_scan(spark, sf):
    from nightjar.plans import views as V

    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)" in plan(V.table(spark, sf, "events").where("value > 100"))


def test_epoch_context_is_one_window_and_one_shuffle(spark):
    d = spark.createDataFrame([(1, 0, 1.0, 2.0)], "subject_id int, epoch_idx int, a double, b double")
    p = plan(E.contextual(d, ["a", "b"])).split("== Initial Plan ==")[-1]
    assert p.count("Exchange ") == 1 and p.count("Window ") == 1


def test_one_subject_with_a_third_of_all_rows_spreads_over_chunks(spark):
    rows = pd.DataFrame({"subject_id": np.repeat([1, 2, 3], [30000, 30000, 30000]), "epoch_idx": np.tile(np.arange(30000), 3)})
    rows.loc[rows.subject_id == 1, "subject_id"] = 9
    rng = np.random.default_rng(0)
    rows["sleep_stage"] = rng.choice(["W", "N2"], len(rows))
    rows["apnoea_label"] = rng.integers(0, 2, len(rows))
    got = E.night_summary(spark.createDataFrame(rows)).toPandas().set_index("subject_id")
    for s, x in rows.groupby("subject_id"):
        first = x.loc[x.sleep_stage == "N2", "epoch_idx"].min()
        assert got.loc[s, "waso_min"] == ((x.sleep_stage == "W") & (x.epoch_idx > first)).sum() / 2
        assert got.loc[s, "n_apnoea_epochs"] == ((x.sleep_stage == "N2") & (x.apnoea_label == 1)).sum()


# ---- survival analyses ------------------------------------------------------------------------

GRID = [0.4, 0.8, 1.2]


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    n = 240
    x, z = rng.normal(size=n), rng.normal(size=n)
    t = rng.exponential(np.exp(-0.8 * x))
    c = rng.exponential(1.5, n)
    p = pd.DataFrame({"subject_id": np.arange(n), "stratum": rng.choice(["a", "b"], n), "time": np.minimum(t, c) + 1e-3, "event": (t <= c).astype(int), "x": x, "z": z})
    return spark.createDataFrame(p)


def test_ladder_bootstrap_and_pairs(spark, cohort):
    from nightjar.operators import survival as S
    from nightjar.plans import survival as P
    from nightjar.session import cut_lineage

    test = F.col("subject_id") % 3 == 0
    ladder = {"M0": ["z"], "M1": ["x", "z"]}
    row = {r.model: r for r in P.evaluate_ladder(cohort, test, ladder, ["stratum"], 0.5, 1.0, GRID).collect()}
    assert row["M1"].harrell_c > 0.65 > row["M0"].harrell_c and row["M1"].scaled_brier_10y > row["M0"].scaled_brier_10y
    null = P.null_survival(cohort.where(~test), ["stratum"], 1.0)
    pred = cut_lineage(P.predict_ladder(cohort.where(~test), cohort.where(test), ladder, ["stratum"], [0.5, 1.0, *GRID]).join(null, "stratum"))
    boots = P.bootstrap_metrics(pred, ["stratum"], 0.5, 1.0, GRID, 4).cache()
    assert boots.count() == 8
    one = boots.where("replicate = 2 AND model = 'M1'").first()
    from nightjar.operators.resample import boot_weights

    w = boot_weights(pred.select("subject_id"), 4).where("replicate = 2")
    rep = pred.where("model = 'M1'").join(w, "subject_id").withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    assert abs(S.harrell_c(rep, []).first().c_index - one.harrell_c) < 1e-12
    assert abs(S.brier(rep, [], ["stratum"], 1.0, "s_1").first().brier - one.brier_10y) < 1e-12
    assert abs(S.uno_c(rep, [], ["stratum"], 1.0).first().uno_c - one.uno_c_10y) < 1e-9
    d = P.paired_metrics(boots, [("M1", "M0")], "harrell_c").first()
    assert d.delta_boot_mean > 0 and 0 < d.p_two_sided <= 1
    sub = P.subgroup_concordance(pred, {"low": F.col("z") < 0, "high": F.col("z") >= 0}).collect()
    assert len(sub) == 4


def test_analyses_equal_their_single_runs(spark, cohort):
    from nightjar.operators import survival as S
    from nightjar.plans import survival as P

    d = cohort.withColumn("hard", F.when(F.col("subject_id") % 4 == 0, 0).otherwise(F.col("event"))).withColumnsRenamed({"time": "t", "event": "e"})
    d = d.withColumn("x", F.when(F.col("subject_id") == 7, None).otherwise(F.col("x")))
    test = F.col("subject_id") % 3 == 0
    ladder = {"M0": ["z"], "M1": ["x", "z"]}
    got = P.analyse(d, {"any": (F.col("t"), F.col("e")), "hard": (F.col("t"), F.col("hard"))}, {"all": F.lit(True), "some": F.col("z") > -1},
                    ladder, test, ["stratum"], 0.5, 1.0, GRID)
    rows = {(r.outcome, r.definition, r.model): r for r in got.metrics().collect()}
    assert len(rows) == 8
    whole = d.dropna(subset=["x"])
    for outcome, definition, event, inside in (("hard", "some", "hard", F.col("z") > -1),):
        one = whole.where(inside).select("subject_id", "stratum", "x", "z", F.col("t").alias("time"), F.col(event).alias("event"))
        for r in P.evaluate_ladder(one, test, ladder, ["stratum"], 0.5, 1.0, GRID).collect():
            mine = rows[outcome, definition, r.model].asDict()
            assert all(abs(mine[c] - v) < 1e-6 for c, v in r.asDict().items() if c != "model")
        n = got.sizes().where(f"outcome = '{outcome}' AND definition = '{definition}'").agg(F.sum("n"), F.sum("events")).first()
        assert tuple(n) == (one.count(), one.agg(F.sum("event")).first()[0])
    sub = got.subgroup_concordance({"low": F.col("z") < 0, "wide": F.col("z") < 9}).collect()
    assert len(sub) == 16
    wide = {(r.outcome, r.definition, r.model): r.c_index for r in sub if r.subgroup == "wide"}
    assert all(abs(wide[k] - r.harrell_c) < 1e-12 for k, r in rows.items())
    assert got.hazard_ratios().count() == 12


def test_repeated_folds(cohort):
    from nightjar.plans import survival as P

    got = P.cross_validate(cohort, {"M1": ["x"]}, ["stratum"], k=2, repeats=2).first()
    assert got.n_splits == 4 and got.mean_c > 0.65


# ---- fitting ----------------------------------------------------------------------------------

def test_logistic_fit_recovers_the_signal(spark):
    from nightjar.operators import fitting as FT

    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    p = 1 / (1 + np.exp(-(2 * x - 1)))
    pdf = pd.DataFrame({"subject_id": np.arange(800) // 8, "epoch_idx": np.arange(800) % 8, "apnoea_label": y, "x": x, "pred_prob": p})
    pdf.loc[::17, "x"] = np.nan
    d = spark.createDataFrame(pdf)
    line = FT.calibration_line(d).first()
    assert abs(line.calibration_slope - 1) < 0.25 and abs(line.calibration_intercept) < 0.25
    out = FT.predict(FT.fit_binary(d, ["x"], family="logistic"), d, ["subject_id", "epoch_idx", "apnoea_label"])
    assert out.count() == 800 and M.discrimination(out, []).first().auc > 0.8


def test_chained_imputation_uses_training_rows_only(spark):
    from nightjar.operators import fitting as FT

    rng = np.random.default_rng(3)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300), "a": a, "b": 2 * a + 1 + rng.normal(0, 0.01, 300), "k": (a > 0).astype(float), "s": rng.choice(["u", "v"], 300)})
    truth = pdf["b"].copy()
    pdf.loc[::10, "b"] = np.nan
    pdf.loc[::7, "k"] = np.nan
    d = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("b", "k")})
    out = FT.chained_impute(d.where("id < 200"), d, ["a", "b", "k"], ["k"], "s").toPandas().sort_values("id")
    assert np.abs(out["b"].to_numpy() - truth.to_numpy()).max() < 0.2 and set(out["k"]) <= {0.0, 1.0}


def test_repeatability_report(spark):
    from nightjar.operators.quality import repeatability

    d = spark.createDataFrame([(s, i, float(s + i)) for s in range(6) for i in range(3)], "subject_id int, epoch_idx int, x double")
    same = repeatability(d, lambda ids: d.join(ids, "subject_id"), 4, ["x"]).first()
    assert tuple(same) == (0, 0, 0)
    off = repeatability(d, lambda ids: d.join(ids, "subject_id").withColumn("x", F.col("x") + 1), 4, ["x"]).first()
    assert off.diff_x == 12


def test_calibration_lines_of_all_groups_at_once(spark):
    """Every group's line has a zero gradient; groups without a line are listed without one."""
    from nightjar.operators import fitting as FT

    rng = np.random.default_rng(4)
    frames = []
    for g, (a, b) in {"x": (0.3, 0.7), "y": (-1.0, 1.4), "z": (0.0, 1.0)}.items():
        lp = rng.normal(size=2000)
        y = (rng.random(2000) < 1 / (1 + np.exp(-(a + b * lp)))).astype(int)
        frames.append(pd.DataFrame({"g": g, "apnoea_label": y, "pred_prob": 1 / (1 + np.exp(-lp))}))
    frames += [pd.DataFrame({"g": "one class", "apnoea_label": [1] * 20, "pred_prob": np.linspace(0.1, 0.9, 20)}),
               pd.DataFrame({"g": "one score", "apnoea_label": [0, 1] * 10, "pred_prob": [0.4] * 20}),
               pd.DataFrame({"g": "parted", "apnoea_label": [0] * 10 + [1] * 10, "pred_prob": np.linspace(0.1, 0.9, 20)})]
    pdf = pd.concat(frames)
    got = {r.g: r for r in FT.calibration_lines(spark.createDataFrame(pdf), ["g"]).collect()}
    for g, own in pdf.groupby("g"):
        r = got[g]
        assert r.n_rows == len(own)
        if g in ("x", "y", "z"):
            x = np.log(own.pred_prob / (1 - own.pred_prob))
            miss = own.apnoea_label - 1 / (1 + np.exp(-(r.calibration_intercept + r.calibration_slope * x)))
            assert abs(miss.sum()) < 1e-6 and abs((miss * x).sum()) < 1e-6
        else:
            assert r.calibration_slope is None and r.calibration_intercept is None
