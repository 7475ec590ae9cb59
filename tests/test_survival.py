"""Brute-force and identity checks of the survival operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.operators import survival as S
from nightjar.operators.asof import step_lookup
from nightjar.operators.cox import cox_fit


def sample(n=120, seed=0, censor=True):
    rng = np.random.default_rng(seed)
    score = np.round(rng.normal(size=n), 1)
    t = np.ceil(10 * rng.exponential(np.exp(-0.7 * score))) / 10
    c = np.ceil(10 * rng.exponential(1.2, n)) / 10 if censor else np.full(n, 1e6)
    return pd.DataFrame({"time": np.minimum(t, c), "event": (t <= c).astype(int), "score": score,
                         "stratum": rng.choice(["a", "b", "c"], n), "subject_id": np.arange(n)})


def g_steps(t, e):
    times = np.unique(t[e == 0])
    s, out = 1.0, []
    for u in times:
        n = (t >= u).sum() - ((t == u) & (e == 1)).sum()
        s *= 1 - ((t == u) & (e == 0)).sum() / n
        out.append((u, s))
    return out


def g_at(steps, t, left):
    v = 1.0
    for u, s in steps:
        if u < t or (u == t and not left):
            v = s
    return v


def pairs(p, weight=None, same=False, tau=np.inf):
    num = den = 0.0
    for i in p.itertuples():
        if not i.event or i.time >= tau:
            continue
        for j in p.itertuples():
            if same and i.stratum != j.stratum:
                continue
            if j.time > i.time or (j.time == i.time and not j.event):
                w = weight(i, j) if weight else 1.0
                num += w * ((i.score > j.score) + 0.5 * (i.score == j.score))
                den += w
    return num / den


def test_hand_case(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1)], "time double, event int")
    km = {r.time: r for r in S.censoring_km(d, []).collect()}
    assert km[2.0].g_left == 1.0 and km[2.0].g == 0.5 and km[3.0].g_left == 0.5


def test_harrell_pooled_and_within(spark):
    p = sample()
    d = spark.createDataFrame(p)
    assert abs(S.harrell_c(d, []).first().c_index - pairs(p)) < 1e-12
    assert abs(S.harrell_c(d, [], ["stratum"]).first().c_index - pairs(p, same=True)) < 1e-12


@pytest.mark.parametrize("strata", [[], ["stratum"]])
def test_uno_by_pairs(spark, strata):
    p = sample(90, 1)
    key = (lambda r: r.stratum) if strata else (lambda r: "all")
    groups = {k: g_steps(x["time"].to_numpy(), x["event"].to_numpy()) for k, x in (p.groupby("stratum") if strata else [("all", p)])}

    def w(i, j):
        g = g_at(groups[key(i)], i.time, True) * g_at(groups[key(j)], i.time, True)
        return 1 / g if g > 0 else 0.0

    got = S.uno_c(spark.createDataFrame(p), [], strata, 1.5).first().uno_c
    assert abs(got - pairs(p, w, tau=1.5)) < 1e-9


def test_no_censoring_identities(spark):
    p = sample(100, 2, censor=False)
    d = spark.createDataFrame(p)
    assert abs(S.uno_c(d, [], ["stratum"], 1e9).first().uno_c - S.harrell_c(d, []).first().c_index) < 1e-12
    y = (p["time"] <= 1.0).to_numpy()
    s = p["score"].to_numpy()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]])
    assert abs(S.cumulative_dynamic_auc(d, [], [], 1.0).first().auc - auc) < 1e-12


def test_ipcw_risk_equals_km(spark):
    d = spark.createDataFrame(sample(150, 3))
    assert abs(S.ipcw_risk(d, [], [], 0.8).first().risk - S.km_risk(d, [], 0.8).first().risk) < 1e-12


@pytest.mark.parametrize("strata", [[], ["stratum"]])
def test_auc_and_brier_by_brute_force(spark, strata):
    p = sample(110, 4)
    p["p"] = 1 / (1 + np.exp(p["score"]))
    h = 0.9
    groups = {k: g_steps(x["time"].to_numpy(), x["event"].to_numpy()) for k, x in (p.groupby("stratum") if strata else [("all", p)])}
    gk = lambda r: groups[r.stratum if strata else "all"]
    inv = lambda g: 1 / g if g > 0 else 0.0
    cases = [(r.score, inv(g_at(gk(r), r.time, True))) for r in p.itertuples() if r.event and r.time <= h]
    ctrls = [(r.score, inv(g_at(gk(r), h, False))) for r in p.itertuples() if r.time > h]
    num = sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in cases for y, b in ctrls)
    want = num / (sum(a for _, a in cases) * sum(b for _, b in ctrls))
    d = spark.createDataFrame(p)
    assert abs(S.cumulative_dynamic_auc(d, [], strata, h).first().auc - want) < 1e-9
    bs = sum((r.p ** 2) * inv(g_at(gk(r), r.time, True)) if r.event and r.time <= h else (1 - r.p) ** 2 * inv(g_at(gk(r), h, False)) if r.time > h else 0.0
             for r in p.itertuples()) / len(p)
    assert abs(S.brier(d, [], strata, h, "p").first().brier - bs) < 1e-9


def test_weights_equal_repeated_rows(spark):
    p = sample(60, 5)
    p["w"] = np.random.default_rng(0).integers(0, 4, len(p))
    a = S.harrell_c(spark.createDataFrame(p[p.w > 0]), [], weight="w").first().c_index
    b = S.harrell_c(spark.createDataFrame(p.loc[p.index.repeat(p.w)]), []).first().c_index
    assert abs(a - b) < 1e-12


def test_dominated_pairs_by_group():
    from nightjar.functions.kernels import dominated

    rng = np.random.default_rng(4)
    n = 300
    group, order, score = np.sort(rng.integers(0, 4, n)), rng.integers(0, 21, n), rng.integers(0, 9, n)
    at = np.lexsort((score, group))
    group, order, score, case, ctrl = group[at], order[at], score[at], rng.integers(0, 3, n).astype(float), rng.integers(0, 3, n).astype(float)
    want = np.zeros((4, 3))
    for i in range(n):
        later = (group == group[i]) & (order > order[i])
        want[group[i]] += [case[i] * ctrl[later & m].sum() for m in (score < score[i], score == score[i], score == score)]
    assert np.array_equal(dominated(group, order, score, case, ctrl), want)


def test_hot_times_and_scores_meet_no_task_whole(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 700
    t, score = rng.integers(1, 60, n).astype(float), rng.integers(0, 400, n) / 4.0
    t[rng.random(n) < 0.35], score[rng.random(n) < 0.35] = 17.0, 50.0
    p = pd.DataFrame({"time": t, "event": rng.integers(0, 2, n), "score": score, "g": rng.choice(["a", "b"], n)})
    d = spark.createDataFrame(p)
    sent, counted = [], S._counted
    monkeypatch.setattr(S, "_counted", lambda rows, by, tasks: sent.append(rows) or counted(rows, by, tasks))
    monkeypatch.setattr(S, "bucket_count", lambda df: 12)
    got = {r.g: r for r in S.harrell_c(d, ["g"]).collect()}
    for g, own in p.groupby("g"):
        assert abs(got[g].c_index - pairs(own)) < 1e-12
    cells = len(p.drop_duplicates())
    rows = sent[0].toPandas()
    assert len(rows[rows._part < 2]) <= 2 * cells
    inside = rows[rows._part < 2].groupby(["g", "_part", "_block"]).size()
    assert inside.max() < cells / 8  # a third of the rows have one time, a third one score


def test_null_and_nan_scores_are_the_least_and_the_largest(spark):
    rows = [(1.0, 1, None), (2.0, 1, float("nan")), (3.0, 1, 0.5), (3.0, 0, 0.0), (4.0, 0, None), (5.0, 0, float("nan")), (6.0, 0, -0.0), (None, 1, 0.5), (2.0, None, 0.5)]
    d = spark.createDataFrame(rows, "time double, event int, score double")
    key = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    num = den = 0.0
    for i in known:
        for j in known:
            if i[1] and (j[0] > i[0] or j[0] == i[0] and not j[1]):
                num += (key(j[2]) < key(i[2])) + (key(j[2]) == key(i[2])) / 2
                den += 1
    got = S.harrell_c(d, []).first()
    assert got.n_pairs == den and abs(got.c_index - num / den) < 1e-12


def test_rounding_of_a_large_likelihood_halves_no_step(spark, monkeypatch):
    from nightjar.operators import cox as X

    _, d = many(spark)
    d = d.withColumn("g", F.lit(0)).withColumn("copies", F.lit(3_000_000))
    exact, calls = X._derivatives, []

    def rounded(*args):  # every pass rounds a little lower
        calls.append(1)
        return {f: (ll - 1e-14 * abs(ll) * len(calls), grad, info) for f, (ll, grad, info) in exact(*args).items()}

    specs = [(0, ["score", "z"]), (0, ["z"])]
    want = X.cox_fits(d, "g", specs, ["stratum"], 0.01, tol=1e-10, weight="copies")
    monkeypatch.setattr(X, "_derivatives", rounded)
    got = X.cox_fits(d, "g", specs, ["stratum"], 0.01, tol=1e-10, weight="copies")
    assert got.passes <= 8 and np.allclose(got.beta, want.beta, atol=1e-7)


def test_a_pass_reads_its_rows_once(spark, monkeypatch):
    from nightjar.operators import cox as X

    _, d = many(spark)
    plans, mapped = [], type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, *a: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or mapped(self, *a))
    X.cox_fits(d.withColumn("g", F.lit(0)), "g", [(0, ["score"])], ["stratum"], 0.01)
    assert plans and not any("MapInArrow" in p for p in plans[1::2])  # the second of a pass folds the sums that the first has left


def test_metrics_join_the_censoring_model_once(spark, monkeypatch):
    p = sample(90, 13)
    p["s5"], p["s10"], p["null"] = 0.9 - p.subject_id / 200, 0.8 - p.subject_id / 200, 0.6
    d = spark.createDataFrame(p)
    joined, attach = [], S.with_censoring
    monkeypatch.setattr(S, "with_censoring", lambda df, *a: joined.append("g_left" not in df.columns) or attach(df, *a))
    got = S.metric_row(d, [], ["stratum"], 0.5, 1.0, "s5", "s10", "null", [0.5, 1.0], [F.col("s5"), F.col("s10")]).first()
    assert sum(joined) == 1
    assert abs(got.auc_10y - S.cumulative_dynamic_auc(d, [], ["stratum"], 1.0).first().auc) < 1e-12
    assert abs(got.brier_10y - S.brier(d, [], ["stratum"], 1.0, "s10").first().brier) < 1e-12
    curve = S.brier_curve(d, [], ["stratum"], [0.5, 1.0], [F.col("s5"), F.col("s10")])
    assert abs(got.ibs_1_10y - S.integrated_brier(curve, []).first().ibs) < 1e-12
    assert abs(got.uno_c_10y - S.uno_c(d, [], ["stratum"], 1.0).first().uno_c) < 1e-12


def test_step_lookup_limits(spark):
    steps = spark.createDataFrame([("a", 1.0, 0.9), ("a", 2.0, 0.5), ("b", 1.5, 0.2)], "s string, t double, g double")
    probes = spark.createDataFrame([("a", t) for t in (0.5, 1.0, 1.5, 2.0, 9.0)] + [("b", 1.0), ("c", 1.0)], "s string, t double")
    right = {(r.s, r.t): r.g for r in step_lookup(probes, steps, ["s"], "t", "g").collect()}
    left = {(r.s, r.t): r.g for r in step_lookup(probes, steps, ["s"], "t", "g", left_limit=True).collect()}
    assert right == {("a", .5): 1, ("a", 1): .9, ("a", 1.5): .9, ("a", 2): .5, ("a", 9): .5, ("b", 1): 1, ("c", 1): 1}
    assert left[("a", 1.0)] == 1 and left[("a", 2.0)] == 0.9


def efron(p, beta, terms):
    """Plain Efron partial log likelihood, looping over tied deaths."""
    ll = 0.0
    for _, g in p.groupby("stratum"):
        x = g[terms].to_numpy()
        eta, t, e = x @ beta, g["time"].to_numpy(), g["event"].to_numpy()
        for u in np.unique(t[e == 1]):
            dead = (t == u) & (e == 1)
            s, d = np.exp(eta[t >= u]).sum(), np.exp(eta[dead]).sum()
            m = dead.sum()
            ll += eta[dead].sum() - sum(np.log(s - k / m * d) for k in range(m))
    return ll


def test_cox_reaches_the_maximum(spark):
    p = sample(150, 6)
    p["z"] = np.random.default_rng(8).normal(size=len(p))
    fit = cox_fit(spark.createDataFrame(p), ["score", "z"], ["stratum"])
    best = efron(p, fit.beta, ["score", "z"])
    assert fit.gradient_norm < 1e-3 and fit.beta[0] > 0.3
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert efron(p, fit.beta + step, ["score", "z"]) < best


def test_aalen_johansen_without_competitors_is_one_minus_km(spark):
    p = sample(80, 9)
    p["cause"] = p["event"]
    d = spark.createDataFrame(p)
    assert abs(S.aalen_johansen(d, [], 0.8).first().cif - S.km_risk(d, [], 0.8).first().risk) < 1e-9


def test_uno_with_hundreds_of_strata(spark):
    r = np.random.default_rng(8)
    p = pd.DataFrame({"time": np.ceil(r.exponential(1, 900) * 10) / 10 + 0.1, "event": r.integers(0, 2, 900), "score": r.normal(size=900).round(2), "stratum": [f"s{i % 300}" for i in range(900)]})
    got = S.uno_c(spark.createDataFrame(p), [], ["stratum"], 1.5).first().uno_c
    g = {}
    for z, own in p.groupby("stratum"):
        t = np.sort(own.time.unique())
        left, out = 1.0, []
        for x in t:
            at_risk, d, c = (own.time >= x).sum(), ((own.time == x) & (own.event == 1)).sum(), ((own.time == x) & (own.event == 0)).sum()
            out.append((x, left))
            left *= 1 - c / (at_risk - d) if c else 1.0
        g[z] = (out, left)

    def g_left(z, x):
        steps, last = g[z]
        return next((v for t, v in steps if t >= x), last)

    num = den = 0.0
    for i in p[(p.event == 1) & (p.time < 1.5)].itertuples():
        for j in p[(p.time > i.time) | ((p.time == i.time) & (p.event == 0))].itertuples():
            if j.Index != i.Index:
                a, b = g_left(i.stratum, i.time), g_left(j.stratum, i.time)
                w = 1 / (a * b) if a > 0 and b > 0 else 0.0
                num, den = num + w * ((i.score > j.score) + 0.5 * (i.score == j.score)), den + w
    assert abs(got - num / den) < 1e-9


def test_cox_with_a_million_deaths_at_one_time(spark):
    from nightjar.operators import cox

    d = spark.range(1_200_000).select(F.when(F.col("id") < 1_000_000, 1.0).otherwise(2.0).alias("time"), (F.col("id") % 1_100_000 < 1_000_000).cast("int").alias("event"),
                                      (F.pmod(F.xxhash64("id"), F.lit(2))).cast("double").alias("x"))
    fit = cox.cox_fit(d, ["x"])
    assert abs(fit.beta[0]) < 0.02 and 0 < fit.se[0] < 0.01


def test_efron_sums_in_closed_form(spark):
    from nightjar.operators import cox

    rows = [(5.0, 2.0, 3), (100.0, 7.5, 1), (40.0, 40.0, 9), (1e6, 30.0, 12), (9.0, 8.0, 500)]
    r, e, d = (np.array(c, float) for c in zip(*rows))
    table = pd.DataFrame(dict(zip(["_log", "_p", "_fp", "_pp", "_fpp", "_ffpp"], cox._efron_sums(d, r, e)))).assign(r_s0=r, d_s0=e, deaths=d.astype(int))
    for _, x in table.iterrows():
        f = np.arange(x.deaths) / x.deaths
        phi = x.r_s0 - f * x.d_s0
        want = {"_log": np.log(phi).sum(), "_p": (1 / phi).sum(), "_fp": (f / phi).sum(), "_pp": (1 / phi**2).sum(), "_fpp": (f / phi**2).sum(), "_ffpp": (f * f / phi**2).sum()}
        ratio = x.r_s0 / x.d_s0  # f multiplies death sums, which are so much smaller than risk sums
        scale = {"_log": want["_log"], "_p": want["_p"], "_fp": want["_p"] * ratio, "_pp": want["_pp"], "_fpp": want["_pp"] * ratio, "_ffpp": want["_pp"] * ratio**2}
        for k, v in want.items():
            assert abs(x[k] - v) <= 1e-9 * abs(scale[k]), (k, x)


def test_slope_of_a_fit_on_its_own_rows_is_one(spark):
    from nightjar.plans.survival import within_stratum_slope

    rng = np.random.default_rng(9)
    n = 400
    p = pd.DataFrame({"x": rng.normal(size=n), "z": rng.normal(size=n), "stratum": rng.integers(0, 3, n).astype(str)})
    p["time"] = np.ceil(rng.exponential(30 * np.exp(-0.8 * p.x), n)) + 1.0
    p["event"] = (rng.random(n) < 0.7).astype(int)
    d = spark.createDataFrame(p)
    fit = cox_fit(d, ["x", "z"], ["stratum"])
    scored = d.withColumn("lp", fit.linear_predictor())
    assert abs(within_stratum_slope(scored, ["stratum"]) - 1) < 1e-6
    assert abs(within_stratum_slope(scored.withColumn("half", scored.lp / 2), ["stratum"], "half") - 2) < 1e-6


def many(spark, seed=5, n=400):
    p = sample(n, seed)
    rng = np.random.default_rng(seed)
    p["z"], p["u"] = rng.normal(size=n), rng.choice([0.0, 1.0], n)
    return p, spark.createDataFrame(p)


def test_fits_side_by_side_equal_single_fits(spark):
    from nightjar.operators import cox as X

    p, d = many(spark)
    groups = {0: F.lit(True), 1: F.col("u") == 1, 2: F.col("time") < 1.5}
    d = d.withColumn("g", F.explode(F.filter(F.array(*[F.when(c, F.lit(g)) for g, c in groups.items()]), lambda x: x.isNotNull())))
    specs = [(0, ["score"]), (2, ["z"]), (1, ["z", "score"])]
    for penalizer in (0.0, 0.01):
        got = X.cox_fits(d, "g", specs, ["stratum"], penalizer)
        for f, (g, own) in enumerate(specs):
            one = X.cox_fit(d.where(F.col("g") == g), own, ["stratum"], penalizer)
            at = [got.terms.index(t) for t in own]
            assert np.allclose(got.beta[f, at], one.beta, atol=1e-6) and np.allclose(got.se[f, at], one.se, atol=1e-6)
            assert not got.beta[f, [i for i in range(2) if i not in at]].any()
    h = X.baseline_hazard(got.expand(d), got)
    mine = X.survival_at(got.expand(d), got, h, [0.7]).where("fit = 2").groupBy().agg(F.avg("s_0")).first()[0]
    one = X.cox_fit(d.where("g = 1"), ["z", "score"], ["stratum"], 0.01)
    want = X.survival_at(d.where("g = 1"), one, X.baseline_hazard(d.where("g = 1"), one), [0.7]).agg(F.avg("s_0")).first()[0]
    assert abs(mine - want) < 1e-6


def test_data_passes_do_not_grow_with_the_number_of_fits(spark):
    from nightjar.operators import cox as X

    _, d = many(spark)
    d = d.withColumn("g", F.lit(0))
    one = X.cox_fits(d, "g", [(0, ["score", "z"])], ["stratum"], 0.01).passes
    assert X.cox_fits(d, "g", [(0, ["score", "z"])] * 6 + [(0, ["z"])] * 6, ["stratum"], 0.01).passes <= one + 1


def test_fits_without_events_constant_terms_and_empty_tables(spark):
    from nightjar.operators import cox as X

    p, d = many(spark, n=80)
    d = d.withColumn("g", F.col("u").cast("int")).withColumn("event", F.when(F.col("u") == 1, 0).otherwise(F.col("event"))).withColumn("c", F.lit(3.0))
    got = X.cox_fits(d, "g", [(0, ["score", "c"]), (1, ["score"]), (2, ["z"])], ["stratum"], 0.01)
    rows = {(r.fit, r.term): r for r in got.hazard_ratios(spark).collect()}
    assert abs(rows[0, "c"].coef) < 1e-9 and abs(rows[0, "score"].coef) > 0.1 and rows[1, "score"].coef is None and rows[2, "z"].hr is None
    none = X.cox_fits(d.limit(0), "g", [(0, ["score"])], ["stratum"])
    assert none.hazard_ratios(spark).first().coef is None


def test_equal_rows_are_held_once(spark):
    from nightjar.operators import cox as X
    from nightjar.plans import survival as P

    p, d = many(spark, n=120)
    p["copies"] = np.arange(120) % 4 + 1
    folded = spark.createDataFrame(p)
    copies = folded.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    one, every = X.cox_fit(folded, ["score", "z"], ["stratum"], 0.01, weight="copies"), X.cox_fit(copies, ["score", "z"], ["stratum"], 0.01)
    assert np.allclose(one.beta, every.beta, atol=1e-9) and np.allclose(one.se, every.se, atol=1e-9)
    got = P.analyse(copies, {"any": (F.col("time"), F.col("event"))}, {"all": F.lit(True)}, {"M0": ["score"], "M1": ["score", "z"]},
                    F.col("u") == 1, ["stratum"], 0.5, 1.0, [0.5, 1.0])
    assert got.rows.count() == 120 and got.sizes().agg(F.sum("n")).first()[0] == p.copies.sum()
    held = got.pred.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    c = {r.fit: r.c_index for r in S.harrell_c(held, ["fit"]).collect()}
    assert sorted(c.values()) == sorted(r.harrell_c for r in got.metrics().collect())


def test_calibration_reads_its_rows_once(spark):
    p = sample(200, 12)
    p["cause"] = p["event"]
    out = S.calibration_quintiles(spark.createDataFrame(p), ["stratum"], 0.8)
    assert "ExistingRDD" not in out._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.agg(F.sum("n")).first()[0] == 200


def test_equal_rows_fold_before_they_are_repeated_per_analysis(spark, monkeypatch):
    from nightjar.plans import survival as P

    p, d = many(spark, n=120)
    read, fold = [], P.equal_rows
    monkeypatch.setattr(P, "equal_rows", lambda df, *a: read.append(df.count()) or fold(df, *a))
    late = (F.col("event") == 1) & (F.col("time") > 0.5)
    got = P.analyse(d, {"any": (F.col("time"), F.col("event")), "late": (F.col("time"), late)}, {"all": F.lit(True), "some": F.col("u") == 0}, {"M0": ["score"]},
                    F.col("z") > 0.5, ["stratum"], 0.5, 1.0, [0.5, 1.0])
    assert read[0] == 120
    sizes = {(r.outcome, r.definition): (r.n, r.events) for r in got.sizes().groupBy("outcome", "definition").agg(F.sum("n").alias("n"), F.sum("events").alias("events")).collect()}
    some = p[p.u == 0]
    assert sizes == {("any", "all"): (120, p.event.sum()), ("any", "some"): (len(some), some.event.sum()),
                     ("late", "all"): (120, (p.event & (p.time > 0.5)).sum()), ("late", "some"): (len(some), (some.event & (some.time > 0.5)).sum())}
