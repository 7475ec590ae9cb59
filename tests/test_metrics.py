"""Metrics, resampling, verdicts and comparisons against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.operators import metrics as M
from nightjar.operators import resample as R
from nightjar.operators import splits as SP
from nightjar.operators.delong import delong
from nightjar.operators.running import dense_index, grouped_quantiles, running_totals


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) if len(pos) and len(neg) else None


def average_precision(y, p):
    out, last = 0.0, 0.0
    for t in np.unique(p)[::-1]:
        hit = p >= t
        rec = (y[hit] == 1).sum() / (y == 1).sum()
        out += (rec - last) * (y[hit] == 1).mean()
        last = rec
    return out


def predictions(n_subj=20, hot=True, seed=0):
    """Subject 0 holds a third of the rows and one score holds another third."""
    rng = np.random.default_rng(seed)
    n = n_subj * 25
    s = np.where(rng.random(n) < 0.33, 0, rng.integers(0, n_subj, n)) if hot else rng.integers(0, n_subj, n)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)
    if hot:
        p = np.where(rng.random(n) < 0.33, 0.5, p)
    return pd.DataFrame({"subject_id": s, "epoch_idx": np.arange(n), "apnoea_label": y, "pred_prob": p, "pred_label": (p > 0.5).astype("int64")})


def test_running_totals_across_buckets(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "x": rng.integers(0, 200, 500), "v": rng.integers(1, 5, 500)}).drop_duplicates(["g", "x"])
    got = running_totals(spark.createDataFrame(pdf), ["g"], "x", ["v"], buckets=13).toPandas().sort_values(["g", "x"])
    pdf = pdf.sort_values(["g", "x"])
    np.testing.assert_array_equal(got["v_before"], pdf.groupby("g")["v"].cumsum() - pdf["v"])
    np.testing.assert_array_equal(got["v_total"], pdf.groupby("g")["v"].transform("sum"))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 300), "v": np.round(rng.normal(size=300), 1)})
    got = grouped_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.025, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    for g, x in pdf.groupby("g")["v"]:
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(x, [0.025, 0.5, 0.9]), atol=1e-12)


def test_discrimination_with_a_hot_score(spark):
    p = predictions()
    r = M.discrimination(spark.createDataFrame(p), []).first()
    y, s = p["apnoea_label"].to_numpy(), p["pred_prob"].to_numpy()
    assert abs(r.auc - auc(y, s)) < 1e-12 and abs(r.average_precision - average_precision(y, s)) < 1e-12


def test_single_class_has_no_auc(spark):
    d = spark.createDataFrame([(1, 0.2), (1, 0.4)], "apnoea_label int, pred_prob double")
    r = M.discrimination(d, []).first()
    assert r.auc is None and r.average_precision is None


@pytest.mark.parametrize("buckets", [3, 8, 40])
def test_replicates_equal_explicit_resampling(spark, buckets):
    p = predictions(seed=3)
    d = spark.createDataFrame(p)
    w = R.boot_weights(d.select("subject_id"), 7)
    got = {r.replicate: r for r in R.replicate_discrimination(d, w, 7, buckets=buckets).collect()}
    wp = w.toPandas()
    n = p["subject_id"].nunique()
    assert (wp.groupby("replicate")["w"].sum() == n).all() and len(got) == 7
    for rep, x in wp.groupby("replicate"):
        rows = p.merge(x[["subject_id", "w"]], on="subject_id")
        rows = rows.loc[rows.index.repeat(rows["w"])]
        y, s = rows["apnoea_label"].to_numpy(), rows["pred_prob"].to_numpy()
        assert abs(got[rep].auc - auc(y, s)) < 1e-12
        assert abs(got[rep].average_precision - average_precision(y, s)) < 1e-12


def test_rows_in_small_slabs(spark, monkeypatch):
    monkeypatch.setattr(R, "SLAB", 3)
    p = predictions(seed=4)
    d = spark.createDataFrame(p)
    w = R.boot_weights(d.select("subject_id"), 8)
    got = R.replicate_discrimination(d, w, 8, buckets=5).toPandas().set_index("replicate")["auc"]
    x = w.toPandas().query("replicate == 7")
    rows = p.merge(x[["subject_id", "w"]], on="subject_id")
    rows = rows.loc[rows.index.repeat(rows["w"])]
    assert len(got) == 8 and abs(got[7] - auc(rows["apnoea_label"].to_numpy(), rows["pred_prob"].to_numpy())) < 1e-12


def test_epoch_bootstrap_is_centred(spark):
    p = predictions(hot=False, seed=5)
    d = spark.createDataFrame(p)
    b = R.epoch_bootstrap(d, 60).toPandas()["auc"]
    point = auc(p["apnoea_label"].to_numpy(), p["pred_prob"].to_numpy())
    assert len(b) == 60 and abs(b.mean() - point) < 0.02 and b.std() > 0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_epoch_bootstrap_equals_its_draws(spark, buckets):
    """Every replicate against a plain count of the same draws; rows without a score are one lowest score."""
    s = [None, float("nan"), -1.0, 0.0, 0.25, 0.25, 0.5, 0.5, 0.5, 0.75, 1.0, 2.0, None]
    y = [1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 0, 1, None]
    got = R.epoch_bootstrap(spark.createDataFrame(list(zip(s, y)), "pred_prob double, apnoea_label int"), 40, seed=3, buckets=buckets).toPandas().set_index("replicate")
    distinct = [float("nan"), -1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 2.0]
    same = [[v is not None and v == x or x != x and (v is None or v != v) for v in s] for x in distinct]
    n = [[sum(m and t == k for m, t in zip(row, y)) for k in (1, 0)] for row in same]
    drawn = []
    for x, (p, q) in zip(distinct, n):
        rng = np.random.default_rng([3, int(np.float64(x).view(np.uint64))])
        drawn.append((rng.poisson(p, 40), rng.poisson(q, 40)))
    for r in range(40):
        w = [k for pair in drawn for k in (pair[0][r], pair[1][r])]
        labels, ranks = np.repeat([1, 0] * 8, w), np.repeat(np.repeat(np.arange(8.0), 2), w)
        if labels.sum() in (0, len(labels)):
            assert r not in got.index or np.isnan(got.auc[r])
        else:
            assert abs(got.auc[r] - auc(labels, ranks)) < 1e-12 and abs(got.average_precision[r] - average_precision(labels, ranks)) < 1e-12


def test_threshold_first_maximum(spark):
    p = predictions(seed=6)
    y, s = p["apnoea_label"].to_numpy(), p["pred_prob"].to_numpy()
    grid = np.linspace(0.05, 0.95, 91)
    f1 = [2 * ((s > t) & (y == 1)).sum() / ((s > t).sum() + y.sum()) for t in grid]
    r = M.threshold_f1max(spark.createDataFrame(p), []).first()
    assert r.threshold == grid[int(np.argmax(f1))] and abs(r.f1 - max(f1)) < 1e-12


def test_grid_is_numpy_linspace():
    assert M.linspace(0.05, 0.95, 91) == pytest.approx(list(np.linspace(0.05, 0.95, 91)), abs=0)


def test_agreement_closed_forms(spark):
    rng = np.random.default_rng(7)
    y = rng.uniform(0, 40, 50)
    x = y + rng.normal(2, 3, 50)
    r = M.agreement(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), [], "x", "y").first()
    data = np.column_stack([x, y])
    g, n = data.mean(), 50
    msr = 2 * ((data.mean(1) - g) ** 2).sum() / 49
    msc = n * ((data.mean(0) - g) ** 2).sum()
    mse = ((data - data.mean(1, keepdims=True) - data.mean(0) + g) ** 2).sum() / 49
    assert abs(r.icc_a1 - (msr - mse) / (msr + mse + 2 / n * (msc - mse))) < 1e-9
    assert abs(r.pearson_r - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(r.bias - (x - y).mean()) < 1e-9


def test_choose_aggregator_prefers_the_mean_within_the_tie(spark):
    make = lambda v: spark.createDataFrame(list(zip(("mean", "max", "k10", "c10"), v)), "name string, auc double")
    assert M.choose_aggregator(make([0.800, 0.801, 0.79, 0.7])).first().chosen == "mean"
    assert M.choose_aggregator(make([0.800, 0.803, 0.79, 0.7])).first().chosen == "max"


CASES = {
    "A": [(0.02, 0.01, 0.03), (0.021, 0.01, 0.03), (0.022, 0.01, 0.03)],
    "B": [(0.002, 0.001, 0.003)] * 3,
    "C": [(0.02, 0.01, 0.03), (0.0, -0.01, 0.01), (0.0, -0.01, 0.01)],
    "D": [(0.0, -0.005, 0.005)] * 3,
    "E": [(0.0, -0.02, 0.02)] * 3,
    "none": [(0.02, 0.01, 0.03)] * 2,
}


def test_verdict_table(spark):
    rows = [(k, *map(float, v)) for k, vs in CASES.items() for v in vs]
    d = spark.createDataFrame(rows, "contrast string, delta_point double, delta_ci_low double, delta_ci_high double")
    sa = d.groupBy("contrast").agg(F.avg("delta_ci_low").alias("delta_ci_low"), F.avg("delta_ci_high").alias("delta_ci_high"))
    for r in R.claim_rule(d, ["contrast"], sa).collect():
        assert r.verdict == r.contrast


def test_p_value_conventions(spark):
    d = spark.createDataFrame([(float(v),) for v in (-1, 0, 1, 2)], "d double")
    get = lambda c: d.agg(R.two_sided_p(F.col("d"), c)).first()[0]
    assert get("uncapped") == 1.0 and get("capped") == 1.0 and abs(get("plus_one") - 1.0) < 1e-12


def test_delong_of_identical_runs(spark):
    p = predictions(seed=8)
    d = spark.createDataFrame(p).withColumns({"prob_a": F.col("pred_prob"), "prob_b": F.col("pred_prob")})
    r = delong(d, []).first()
    assert r.z_score == 0.0 and r.p_value == 1.0 and abs(r.auc_a - auc(p["apnoea_label"].to_numpy(), p["pred_prob"].to_numpy())) < 1e-12


@pytest.mark.parametrize("n", [97, 400])
def test_split_sizes_and_nesting(spark, n):
    ids = spark.range(200001, 200001 + n).withColumnRenamed("id", "subject_id")
    got = SP.group_split(ids).toPandas()
    sizes = got["part"].value_counts()
    n_test = int(np.ceil(n * 0.2))
    assert len(got) == n and got["subject_id"].is_unique
    assert sizes["test"] == n_test and sizes["val"] == int(np.ceil((n - n_test) * 0.05))
    again = SP.group_split(ids.orderBy(F.rand(1)).unionByName(ids)).toPandas()
    assert dict(zip(got.subject_id, got.part)) == dict(zip(again.subject_id, again.part))


def test_split_record_refuses_a_change(spark):
    ids = spark.range(1, 101).withColumnRenamed("id", "subject_id")
    a, b = SP.split_record(SP.group_split(ids)), SP.split_record(SP.group_split(ids, seed=7))
    assert SP.split_changes(a, a).count() == 0 and SP.split_changes(b, a).count() == 3


def test_dense_index(spark):
    got = dense_index(spark.createDataFrame([(v,) for v in (5, 9, 5, 1)], "k int"), "k", "i").orderBy("k").collect()
    assert [(r.k, r.i, r.n_ids) for r in got] == [(1, 0, 3), (5, 1, 3), (9, 2, 3)]


def test_weights_travel_as_bytes_once_per_bucket(spark, monkeypatch):
    """Keys share a subject's weights, replicates are scored in blocks, and a weight beyond a byte is kept."""
    monkeypatch.setattr(R, "BLOCK", 3)
    p = predictions(seed=7)
    d = spark.createDataFrame(p)
    w = R.boot_weights(d.select("subject_id"), 8)
    big = w.where("replicate = 0").limit(1).withColumn("w", F.lit(700)).unionByName(w.where("replicate > 0"))
    for weights, size in ((w, 8), (big, 32)):
        vectors, kind = R.weight_vectors(weights, 8)
        rows = weights.collect()
        got = {r.subject_id: np.frombuffer(r.w, kind) for r in vectors.collect()}
        assert {len(r.w) for r in vectors.collect()} == {size} and set(got) == {r.subject_id for r in rows}
        assert all(got[r.subject_id][r.replicate] == r.w for r in rows) and sum(x.sum() for x in got.values()) == sum(r.w for r in rows)
    two = d.withColumn("run", F.lit("a")).unionByName(d.withColumn("run", F.lit("b")).withColumn("pred_prob", 1 - F.col("pred_prob")))
    each = R.replicate_discrimination(two, w, 8, ["run"], buckets=4).toPandas().pivot(index="replicate", columns="run", values="auc")
    one = R.replicate_discrimination(d, w, 8, buckets=1).toPandas().set_index("replicate")["auc"]
    assert len(each) == 8 and (each["a"] - one).abs().max() < 1e-12 and (each["a"] + each["b"] - 1).abs().max() < 1e-12
