"""Queries that fit models on the given tables (rows-only: iterative fits have no SQL form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.metrics import rounded
from nightjar.operators import fitting as FT
from nightjar.operators import imputing as I
from nightjar.operators import metrics as M
from nightjar.operators.columns import staging_features
from nightjar.operators.epochs import contextual
from nightjar.operators.splits import group_kfold
from nightjar.plans import modelling as P
from nightjar.plans import views as V
from nightjar.plans.views import with_views
from nightjar.session import cut_lineage


def feature_rows(spark, sf) -> DataFrame:
    """Epochs with two feature bases and their context; the label is the next epoch's, so it is not a feature."""
    e = V.epochs(spark, sf).select("subject_id", "epoch_idx", "sleep_stage", "apnoea_label", F.col("x").alias("hr_mean"),
                                   F.when(F.col("x") < 150, 100 - F.col("x") / 10).alias("spo2_min"))
    return contextual(e, ["hr_mean", "spo2_min"]).fillna(0, ["hr_mean_lag1"])


@query()
def feature_ablation(spark, sf) -> DataFrame:
    return rounded(P.ablation(feature_rows(spark, sf), ["full", "physio_only"], ["logistic", "forest"], trees=20))


@query()
def boosted_predictions(spark, sf) -> DataFrame:
    d = feature_rows(spark, sf).select("subject_id", "epoch_idx", "sleep_stage", "apnoea_label", "hr_mean_lag1", "hr_mean_roll5_std", "spo2_min_lead1")
    return rounded(P.fit_and_score(P.prepare(d), ["hr_mean_lag1", "hr_mean_roll5_std", "spo2_min_lead1"], "boosted", max_iter=100))


@query()
def stage_as_feature(spark, sf) -> DataFrame:
    d = feature_rows(spark, sf)
    return rounded(P.fit_and_score(P.prepare(d, sleep_only=False), ["hr_mean_lag1"], "logistic", categorical=["sleep_stage"]))


@query()
def out_of_fold_predictions(spark, sf) -> DataFrame:
    d = cut_lineage(feature_rows(spark, sf).select("subject_id", "epoch_idx", "apnoea_label", "hr_mean_lag1", "hr_mean_roll5_std"))
    return rounded(FT.out_of_fold(d, group_kfold(d, 5), 5, ["hr_mean_lag1", "hr_mean_roll5_std"]))


@query()
def option_search(spark, sf) -> DataFrame:
    d = cut_lineage(feature_rows(spark, sf).select("subject_id", "epoch_idx", "apnoea_label", "hr_mean_lag1", "hr_mean_roll5_std"))
    return rounded(FT.search(d, group_kfold(d, 5), 5, ["hr_mean_lag1", "hr_mean_roll5_std"], [{"reg": 0.0}, {"reg": 0.01}, {"reg": 0.1}]))


@query()
def pruned_option_search(spark, sf) -> DataFrame:
    """Six penalties by successive halving over five folds."""
    d = cut_lineage(feature_rows(spark, sf).select("subject_id", "epoch_idx", "apnoea_label", "hr_mean_lag1", "hr_mean_roll5_std"))
    return rounded(FT.halving_search(d, group_kfold(d, 5), 5, ["hr_mean_lag1", "hr_mean_roll5_std"], [{"reg": r} for r in (0.0, 0.001, 0.01, 0.1, 1.0, 10.0)]))


@query()
def staging_metrics(spark, sf) -> DataFrame:
    """Trained on the in-bed window, evaluated on it and on the whole night, without features made from the stage."""
    d = feature_rows(spark, sf)
    code = F.when(F.col("sleep_stage") == "W", 0).when(F.col("sleep_stage") == "N1", 1).when(F.col("sleep_stage") == "N2", 2).when(F.col("sleep_stage") == "N3", 3).otherwise(4)
    coded = d.withColumn("stage", code)
    columns = [c for c in staging_features(d.columns, "multimodal") if c.startswith("hr_mean")]
    counts = P.staging_windows(coded, columns, "stage", 5, margin=2, trees=20, max_depth=8)
    return rounded(M.multiclass_metrics(counts, ["window"], [0, 1, 2, 3, 4]))


@query()
def chained_imputation(spark, sf) -> DataFrame:
    c = V.cohort(spark, sf).select("subject_id", "segment", "acctbal", F.col("f_day").cast("double").alias("f_day"), F.col("n_orders").cast("double").alias("n_orders"),
                                   F.when(F.col("subject_id") % 5 != 0, (F.col("nation") % 2).cast("double")).alias("flag"))
    train = c.where("subject_id % 4 <> 0")
    return rounded(I.chained_impute(train, c, ["acctbal", "f_day", "n_orders", "flag"], ["flag"], "segment"), 4)


def _chained_sql(names: list[str], rounds: int, reg: float = 1e-3) -> str:
    """The chained regressions of three columns with segments, every step as the closed solution of three equations."""
    moments = ", ".join(f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(names))
    out = [f"""
    rows0 as (select subject_id, segment, subject_id % 4 <> 0 as tr, acctbal, cast(f_day as double) as f_day, cast(n_orders as double) as n_orders from v_cohort),
    moments as (select {moments} from rows0 where tr),
    base as (select segment from rows0 where tr group by segment order by count(*) desc, segment limit 1),
    x0 as materialized (select subject_id, segment, tr, {", ".join(f"coalesce(({c} - m{i}) / s{i}, 0) as x{i}, {c} is null as g{i}" for i, c in enumerate(names))} from rows0, moments)"""]
    for t in range(3 * rounds):
        c = t % 3
        p, q = [i for i in range(3) if i != c]
        out.append(f"""
    sums{t} as (select segment, count(*)::double as n, sum(x{p}) as p, sum(x{q}) as q, sum(x{c}) as y, sum(x{p} * x{p}) as pp, sum(x{p} * x{q}) as pq,
            sum(x{q} * x{q}) as qq, sum(x{p} * x{c}) as py, sum(x{q} * x{c}) as qy from x{t} where tr and not g{c} group by segment),
    held{t} as (select *, case when segment = (select segment from base) then 0 else 1 / (n + {reg} * n * (1 - n / all_n) + 1e-12 * all_n) end as k
        from sums{t}, (select sum(n) as all_n from sums{t})),
    eq{t} as (select sum(n) - sum(k * n * n) as a, sum(p) - sum(k * n * p) as b, sum(q) - sum(k * n * q) as c, sum(pq) - sum(k * p * q) as e,
            sum(pp) - sum(k * p * p) + sum(n) * ({reg} * (sum(pp) / sum(n) - pow(sum(p) / sum(n), 2)) + 1e-12) as d,
            sum(qq) - sum(k * q * q) + sum(n) * ({reg} * (sum(qq) / sum(n) - pow(sum(q) / sum(n), 2)) + 1e-12) as f,
            sum(y) - sum(k * n * y) as u, sum(py) - sum(k * p * y) as v, sum(qy) - sum(k * q * y) as w from held{t}),
    fit{t} as (select (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det as w1, (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det as wp,
            (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det as wq
        from (select *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) as det from eq{t})),
    x{t + 1} as materialized (select x{t}.* replace (case when g{c} then w1 + wp * x{p} + wq * x{q} + coalesce(effect, 0) else x{c} end as x{c})
        from x{t} cross join fit{t} left join (select segment, (y - w1 * n - wp * p - wq * q) * k as effect from held{t}, fit{t}) using (segment))""")
    filled = ", ".join(f"x{i} * s{i} + m{i} as {c}" for i, c in enumerate(names))
    scaled = ", ".join(f"round(({c} - mu_{c}) / sd_{c}, 4) as {c}" for c in names)
    out.append(f"""
    filled as (select subject_id, tr, {filled} from x{3 * rounds}, moments),
    scale as (select {", ".join(f"avg({c}) as mu_{c}, stddev_pop({c}) as sd_{c}" for c in names)} from filled where tr)
    select subject_id, {scaled}, round(ln(1 + abs(acctbal)), 4) as ln_balance from filled, scale""")
    return "select * from (with " + ",".join(out) + ")"


TERMS = ["acctbal", "f_day", "n_orders"]


@query(with_views(_chained_sql(TERMS, 2), "v_cohort"))
def imputed_design_terms(spark, sf) -> DataFrame:
    """Chained imputation, scaling and a derived term fitted on three quarters of the subjects, applied to all."""
    c = V.cohort(spark, sf).select("subject_id", "segment", "acctbal", F.col("f_day").cast("double").alias("f_day"), F.col("n_orders").cast("double").alias("n_orders"))
    fitted = I.fit_preparation(c.where("subject_id % 4 <> 0"), TERMS, [], "segment", {"ln_balance": F.log1p(F.abs("acctbal"))}, rounds=2)
    return rounded(fitted.transform(c).select("subject_id", *TERMS, "ln_balance"), 4)


@query(with_views("""
    select subject_id, round((coalesce(acctbal, m) - mu) / sd, 6) as acctbal from v_cohort, (select quantile_cont(acctbal, 0.5) as m from v_cohort),
        (select avg(coalesce(acctbal, m)) as mu, stddev_pop(coalesce(acctbal, m)) as sd from v_cohort, (select quantile_cont(acctbal, 0.5) as m from v_cohort))""", "v_cohort"))
def median_fill_and_scale(spark, sf) -> DataFrame:
    """The numeric stage of every model pipeline: exact median, centre, population SD."""
    c = V.cohort(spark, sf).select("subject_id", "acctbal")
    return rounded(FT.MedianFillScale(["acctbal"]).fit(c).transform(c).select("subject_id", F.col("acctbal_scaled").alias("acctbal")))


@query()
def important_features(spark, sf) -> DataFrame:
    d = feature_rows(spark, sf).select("subject_id", "epoch_idx", "apnoea_label", "hr_mean_lag1", "hr_mean_roll5_mean", "hr_mean_roll5_std", "hr_mean_roll11_std")
    cols = ["hr_mean_lag1", "hr_mean_roll5_mean", "hr_mean_roll5_std", "hr_mean_roll11_std"]
    return rounded(FT.top_features(FT.fit_binary(d, cols, family="forest", trees=50), cols, spark, 3))
