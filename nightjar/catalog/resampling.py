"""Queries for bootstrap weights, replicate metrics, paired tests, DeLong and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.metrics import EDGES, RUNS, auc_sql, bin_sql, both_runs, rounded
from nightjar.catalog.splits import draw
from nightjar.operators import metrics as M
from nightjar.operators import resample as R
from nightjar.operators.delong import delong as delong_test
from nightjar.plans import evaluation as P
from nightjar.plans import views as V
from nightjar.plans.views import with_views
from nightjar.session import cut_lineage

N_BOOT = 1000

IDX = "select subject_id, row_number() over (order by subject_id) - 1 as idx, count(*) over () as n from (select distinct user_id as subject_id from events)"
WEIGHTS = f"""
    select replicate, i.subject_id, w from (
        select replicate, {draw("'42'", "replicate::varchar", "idx::varchar")} % n as idx, count(*)::integer as w
        from idx, (select unnest(generate_series(0, {N_BOOT - 1}))::integer as replicate) group by 1, 2) d join idx i using (idx)"""


def weights(spark, sf) -> DataFrame:
    return R.boot_weights(V.table(spark, sf, "events").select(F.col("user_id").alias("subject_id")), N_BOOT)


@query(with_views("select replicate, subject_id, w from weights", idx=IDX, weights=WEIGHTS))
def bootstrap_weights(spark, sf) -> DataFrame:
    return weights(spark, sf)


def wauc(src: str, by: str) -> str:
    """Weighted replicate AUC and average precision of ``src`` (columns by, subject_id, pred_prob, apnoea_label)."""
    return f"""
    select {by}, replicate, sum(pos * (below + neg / 2)) / nullif(max(pt) * max(nt), 0) as auc,
           case when max(pt) > 0 and max(nt) > 0 then sum(pos * (pt - pbelow) / nullif(pt - pbelow + nt - below, 0)) / max(pt) end as average_precision
    from (select *, coalesce(sum(neg) over (w rows between unbounded preceding and 1 preceding), 0) as below,
                 coalesce(sum(pos) over (w rows between unbounded preceding and 1 preceding), 0) as pbelow,
                 sum(pos) over (partition by {by}, replicate) as pt, sum(neg) over (partition by {by}, replicate) as nt
          from (select {by}, replicate, pred_prob, sum(w * apnoea_label)::double as pos, sum(w * (1 - apnoea_label))::double as neg
                from {src} join weights using (subject_id) group by {by}, replicate, pred_prob)
          window w as (partition by {by}, replicate order by pred_prob)) group by {by}, replicate"""


@query(with_views("select run, replicate, round(auc, 6) as auc, round(average_precision, 6) as average_precision from boots",
                  "v_pred_a", "v_pred_b", runs=RUNS, idx=IDX, weights=WEIGHTS, boots=wauc("runs", "run")))
def subject_bootstrap(spark, sf) -> DataFrame:
    return rounded(R.replicate_discrimination(both_runs(spark, sf), weights(spark, sf), N_BOOT, ["run"]))


@query(with_views("""
    select run, round(avg(auc), 6) as boot_mean, round(quantile_cont(auc, 0.025), 6) as ci_low, round(quantile_cont(auc, 0.975), 6) as ci_high, count(auc) as n_valid, count(*) as n_total
    from boots group by 1""", "v_pred_a", "v_pred_b", runs=RUNS, idx=IDX, weights=WEIGHTS, boots=wauc("runs", "run")))
def bootstrap_interval(spark, sf) -> DataFrame:
    return rounded(R.percentile_ci(R.replicate_discrimination(both_runs(spark, sf), weights(spark, sf), N_BOOT, ["run"]), ["run"], "auc"))


@query(with_views("select replicate, round(auc, 6) as auc from boots", "v_epochs", "v_pred_a", idx=IDX, weights=WEIGHTS, sub="""
    select 1 as k, p.* from v_pred_a p join v_epochs e on e.subject_id = p.subject_id and e.epoch_idx = p.epoch_idx
    where p.apnoea_label = 0 or (x < 90 and x / 4 < 20)""", boots=wauc("sub", "k")))
def subset_bootstrap(spark, sf) -> DataFrame:
    from nightjar.catalog.alignment import _context
    from nightjar.operators.align import short_event_endpoint

    d = short_event_endpoint(V.predictions(spark, sf, "a"), _context(spark, sf))
    return rounded(R.replicate_discrimination(d, weights(spark, sf), N_BOOT).select("replicate", "auc"))


@query()
def epoch_bootstrap(spark, sf) -> DataFrame:
    return rounded(R.epoch_bootstrap(V.predictions(spark, sf, "a"), N_BOOT))


@query(with_views(f"""
    select replicate, round(sum(abs(sy - sp)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier from (
        select replicate, b, sum(w * n)::double as n, sum(w * sy)::double as sy, sum(w * sp) as sp, sum(w * sq) as sq from (
            select subject_id, {bin_sql('pred_prob', EDGES)} as b, count(*) as n, sum(apnoea_label) as sy, sum(pred_prob) as sp,
                   sum((pred_prob - apnoea_label) * (pred_prob - apnoea_label)) as sq from v_pred_a group by 1, 2) join weights using (subject_id) group by 1, 2) group by 1""",
                  "v_pred_a", idx=IDX, weights=WEIGHTS))
def calibration_bootstrap(spark, sf) -> DataFrame:
    bins = M.subject_bins(V.predictions(spark, sf, "a"), [], EDGES)
    sums = R.weighted_sums(bins, weights(spark, sf), ["bin"], ["n", "sum_y", "sum_p", "sum_sq"])
    return rounded(M.calibration_summary(sums, ["replicate"]).select("replicate", "ece", "brier"))


@query(with_views(f"""
    select replicate, round(po, 6) as accuracy, round((po - pe) / (1 - pe), 6) as kappa, round(macro, 6) as macro_f1 from (
        select replicate, max(po) as po, sum(r * c) / max(tot * tot) as pe, avg(2 * d / nullif(r + c, 0)) as macro from (
            select replicate, k, sum(case when "true" = k then w else 0 end)::double as r, sum(case when pred = k then w else 0 end)::double as c,
                   sum(case when "true" = k and pred = k then w else 0 end)::double as d, sum(w)::double as tot, sum(case when "true" = pred then w else 0 end)::double / sum(w) as po
            from v_class5 join cw using (subject_id), generate_series(0, 4) g(k) group by 1, 2) group by 1)""",
                  "v_class5", ci="select subject_id, row_number() over (order by subject_id) - 1 as idx, count(*) over () as n from (select distinct subject_id from v_class5)", cw=f"""
    select replicate, i.subject_id, w from (
        select replicate, {draw("'42'", "replicate::varchar", "idx::varchar")} % n as idx, count(*)::integer as w
        from ci, (select unnest(generate_series(0, {N_BOOT - 1}))::integer as replicate) group by 1, 2) d join ci i using (idx)"""))
def confusion_bootstrap(spark, sf) -> DataFrame:
    c = V.class5(spark, sf)
    w = R.boot_weights(c.select("subject_id"), N_BOOT)
    cube = c.groupBy("subject_id", "true", "pred").agg(F.count("*").alias("n"))
    d = R.weighted_sums(cube, w, ["true", "pred"], ["n"])
    return rounded(M.multiclass_metrics(d, ["replicate"], [0, 1, 2, 3, 4]).select("replicate", "accuracy", "kappa", "macro_f1"))


DELTA = """
    select 'a' as a, 'b' as b, round(avg(d), 6) as delta_boot_mean, round(quantile_cont(d, 0.025), 6) as delta_ci_low, round(quantile_cont(d, 0.975), 6) as delta_ci_high,
           {p} as p_two_sided, round(avg((d <= 0)::int), 6) as p_left, round(avg((d >= 0)::int), 6) as p_right, count(d) as n_resamples_valid, count(*) as n_resamples_total,
           round(any_value(pa), 6) as auc_a, round(any_value(pb), 6) as auc_b, round(any_value(pa) - any_value(pb), 6) as delta_point
    from (select x.auc - y.auc as d, (select auc from pt where run = 'a') as pa, (select auc from pt where run = 'b') as pb
          from boots x join boots y using (replicate) where x.run = 'a' and y.run = 'b')"""
P_SQL = {"uncapped": "round(2 * least(avg((d <= 0)::int), avg((d >= 0)::int)), 6)",
         "capped": "round(least(1, 2 * least(avg((d <= 0)::int), avg((d >= 0)::int))), 6)",
         "plus_one": "round(least(1, 2 * least((sum((d <= 0)::int) + 1) / (count(d) + 1), (sum((d >= 0)::int) + 1) / (count(d) + 1))), 6)"}


def _paired(convention: str, name: str) -> None:
    @query(with_views(DELTA.format(p=P_SQL[convention]), "v_pred_a", "v_pred_b", runs=RUNS, idx=IDX, weights=WEIGHTS, boots=wauc("runs", "run"),
                      pt=auc_sql("runs", "run")), name=name)
    def run(spark, sf) -> DataFrame:
        # the second pair names a run that does not exist and is skipped
        return rounded(P.compare_runs(both_runs(spark, sf), [("a", "b"), ("a", "absent")], N_BOOT, convention=convention))


_paired("uncapped", "paired_bootstrap")
_paired("capped", "paired_bootstrap_capped")
_paired("plus_one", "paired_bootstrap_corrected")


# ---- seeds: the label shifted scores of three model seeds -------------------------------------

SEEDS = """
    select 'seed' || s as run, s as seed, subject_id, apnoea_label, least(1.0, pred_prob + s * 0.01 * ((epoch_idx * 7 + s) % 5)) as pred_prob
    from v_pred_a, (select unnest([1, 2, 3]) as s)"""


def _seeds(spark, sf) -> DataFrame:
    s = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed")
    d = V.predictions(spark, sf, "a").select("*", s)
    p = F.least(F.lit(1.0), F.col("pred_prob") + F.col("seed") * 0.01 * ((F.col("epoch_idx") * 7 + F.col("seed")) % 5))
    return d.withColumn("pred_prob", p)


SEED_BOOT = wauc("seeds", "seed")


@query(with_views("select replicate, round(avg(auc), 6) as auc from boots group by 1", "v_pred_a", seeds=SEEDS, idx=IDX, weights=WEIGHTS, boots=SEED_BOOT))
def seed_averaged_bootstrap(spark, sf) -> DataFrame:
    b = R.replicate_discrimination(_seeds(spark, sf), weights(spark, sf), N_BOOT, ["seed"])
    return rounded(R.seed_average(b, []))


@query(with_views("""
    select kind, seed_hi, seed_lo, round(avg(gap), 6) as gap_mean, round(quantile_cont(gap, 0.025), 6) as gap_ci_low, round(quantile_cont(gap, 0.975), 6) as gap_ci_high from (
        select 'per_seed' as kind, replicate, sh as seed_hi, sl as seed_lo, gap from g where sh = sl union all
        select 'seed_averaged', replicate, null, null, avg(gap) from g where sh = sl group by replicate union all
        select 'cross_pair', replicate, sh, sl, gap from g) group by 1, 2, 3""", "v_pred_a", "v_pred_b", runs=RUNS, seeds=SEEDS, idx=IDX, weights=WEIGHTS,
                  boots=SEED_BOOT, refs=wauc("runs", "run"), g="""
    select h.replicate, h.seed as sh, l.seed as sl, h.auc - l.average_precision - (ra.auc - rb.auc) as gap
    from boots h join boots l using (replicate) join refs ra on ra.replicate = h.replicate and ra.run = 'a' join refs rb on rb.replicate = h.replicate and rb.run = 'b'"""))
def seed_gap(spark, sf) -> DataFrame:
    w = weights(spark, sf)
    b = cut_lineage(R.replicate_discrimination(_seeds(spark, sf), w, N_BOOT, ["seed"]))
    ref = cut_lineage(R.replicate_discrimination(both_runs(spark, sf), w, N_BOOT, ["run"]))
    lo = b.select("replicate", "seed", F.col("average_precision").alias("auc"))
    return rounded(R.gap_summary(b, lo, ref.where("run = 'a'"), ref.where("run = 'b'")))


CLAIM_ROWS = """
    select p_brand as contrast, p_size % 3 as seed, round(avg(p_retailprice) / 1000 - 0.95, 6) as delta_point, round(min(p_retailprice) / 1000 - 0.9, 6) as delta_ci_low,
           round(max(p_retailprice) / 1000 - 0.9, 6) as delta_ci_high from part group by 1, 2"""


@query(f"""
    select contrast, n_seeds, round(m, 6) as mean_delta, case when n_seeds < 3 then 'none' when (lo > 0 or hi < 0) and abs(m) >= 0.01 and abs(m) > sd then 'A'
           when lo > 0 or hi < 0 then 'B' when ex then 'C' when sl > -0.01 and sh < 0.01 then 'D' else 'E' end as verdict
    from (select contrast, count(*) as n_seeds, avg(delta_point) as m, stddev_samp(delta_point) as sd, min(delta_ci_low) as lo, max(delta_ci_high) as hi,
                 bool_or(delta_ci_low > 0 or delta_ci_high < 0) as ex, avg(delta_ci_low) as sl, avg(delta_ci_high) as sh from ({CLAIM_ROWS}) group by 1)""")
def claim_verdicts(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("contrast"), (F.col("p_size") % 3).alias("seed")).agg(
        F.round(F.avg("p_retailprice") / 1000 - 0.95, 6).alias("delta_point"), F.round(F.min("p_retailprice") / 1000 - 0.9, 6).alias("delta_ci_low"),
        F.round(F.max("p_retailprice") / 1000 - 0.9, 6).alias("delta_ci_high"))
    sa = p.groupBy("contrast").agg(F.avg("delta_ci_low").alias("delta_ci_low"), F.avg("delta_ci_high").alias("delta_ci_high"))
    return rounded(R.claim_rule(p, ["contrast"], sa).select("contrast", "n_seeds", "mean_delta", "verdict"))


# ---- DeLong -----------------------------------------------------------------------------------

def _side(score: str, name: str) -> str:
    return f"""
    select subject_id, epoch_idx, apnoea_label, (rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double
               - rank() over (partition by apnoea_label order by {score}) - (count(*) over (partition by apnoea_label, {score}) - 1) / 2.0::double)
               / count(*) filter (apnoea_label = 0) over () as v10,
           (rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double
               - rank() over (partition by apnoea_label order by {score}) - (count(*) over (partition by apnoea_label, {score}) - 1) / 2.0::double)
               / count(*) filter (apnoea_label = 1) over () as v01
    from v_pred_{name}"""


@query(with_views("""
    select n1 + n0 as n_pairs, round(a, 6) as auc_a, round(b, 6) as auc_b, round(b - a, 6) as auc_diff, round(v, 10) as delong_var, round((a - b) / sqrt(v), 5) as z_score,
           round(b - a - 1.96 * sqrt(v), 6) as ci_low, round(b - a + 1.96 * sqrt(v), 6) as ci_high from (
        select count(*) filter (apnoea_label = 1) as n1, count(*) filter (apnoea_label = 0) as n0, avg(x.v10) filter (apnoea_label = 1) as a, avg(y.v10) filter (apnoea_label = 1) as b,
               (var_samp(x.v10) filter (apnoea_label = 1) + var_samp(y.v10) filter (apnoea_label = 1) - 2 * covar_samp(x.v10, y.v10) filter (apnoea_label = 1)) / count(*) filter (apnoea_label = 1)
               + (var_samp(x.v01) filter (apnoea_label = 0) + var_samp(y.v01) filter (apnoea_label = 0) - 2 * covar_samp(x.v01, y.v01) filter (apnoea_label = 0)) / count(*) filter (apnoea_label = 0) as v
        from sa x join sb y using (subject_id, epoch_idx, apnoea_label))""", "v_pred_a", "v_pred_b", sa=_side("pred_prob", "a"), sb=_side("pred_prob", "b")))
def delong(spark, sf) -> DataFrame:
    from nightjar.operators.align import align_runs

    d = delong_test(align_runs(V.predictions(spark, sf, "a"), V.predictions(spark, sf, "b")), [])
    return d.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("auc_a", "auc_b", "auc_diff")], F.round("delong_var", 10).alias("delong_var"),
                    F.round("z_score", 5).alias("z_score"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


# ---- the whole record -------------------------------------------------------------------------

@query(with_views(f"""
    select round(m.auc, 6) as auc_roc, round(average_precision, 6) as auc_pr, round(b.rl, 6) as auc_roc_ci_low, round(b.rh, 6) as auc_roc_ci_high, round(b.pl, 6) as auc_pr_ci_low, round(b.ph, 6) as auc_pr_ci_high,
           round(c.sens, 6) as sensitivity, round(c.spec, 6) as specificity, round(c.prec, 6) as "precision", round(c.f1, 6) as f1, round((c.sens + c.spec) / 2, 6) as balanced_accuracy,
           round(cal.ece, 6) as ece, round(cal.brier, 6) as brier, c.n as n_test_epochs, c.s as n_test_subjects, cl.ns as n_subjects_with_nsrr_ahi, round(cl.mae, 6) as ahi_mae,
           round(cl.cor, 6) as ahi_corr, round(cl.acc, 6) as severity_accuracy, round(cl.kap, 6) as severity_weighted_kappa
    from m, (select quantile_cont(auc, 0.025) as rl, quantile_cont(auc, 0.975) as rh, quantile_cont(average_precision, 0.025) as pl, quantile_cont(average_precision, 0.975) as ph from boots) b,
         (select count(*) as n, count(distinct subject_id) as s, avg(pred_label) filter (apnoea_label = 1) as sens, 1 - avg(pred_label) filter (apnoea_label = 0) as spec,
                 avg(apnoea_label) filter (pred_label = 1) as prec, 2 * sum(apnoea_label * pred_label) / (sum(apnoea_label) + sum(pred_label))::double as f1 from v_pred_a) c,
         (select sum(abs(sy - sp)) / sum(n) as ece, sum(sq) / sum(n) as brier from (select {bin_sql('pred_prob', EDGES)} as b, count(*) as n, sum(apnoea_label)::double as sy, sum(pred_prob) as sp,
                 sum((pred_prob - apnoea_label) * (pred_prob - apnoea_label)) as sq from v_pred_a group by 1)) cal,
         (select count(*) as ns, avg(abs(pr - ref)) as mae, corr(pr, ref) as cor, avg((tp = tr)::int) as acc,
                 1 - sum((tp - tr) * (tp - tr)) / (sum(tp * tp) + sum(tr * tr) - 2 * sum(tp) * sum(tr) / count(*)::double) as kap
          from (select *, ((ref >= 5)::int + (ref >= 15)::int + (ref >= 30)::int)::double as tr, ((pr >= 5)::int + (pr >= 15)::int + (pr >= 30)::int)::double as tp
                from (select subject_id, sum(pred_label) / (count(*) * 30 / 3600.0::double) as pr from v_pred_a group by 1) join (select c_custkey as subject_id, c_acctbal / 200 as ref from customer) using (subject_id))) cl""",
                  "v_pred_a", one="select 1 as k, * from v_pred_a", idx=IDX, weights=WEIGHTS, boots=wauc("one", "k"), m=auc_sql("one", "k")))
def extended_metric_record(spark, sf) -> DataFrame:
    meta = V.table(spark, sf, "customer").select(F.concat(F.lit("shhs1-"), F.col("c_custkey")).alias("subject_id"), (F.col("c_acctbal") / 200).alias("ahi_a0h3a"))
    return rounded(P.extended_metrics(V.predictions(spark, sf, "a"), meta, N_BOOT).drop("metric_notes"))


@query(with_views("""
    select run, round(auc, 6) as auc_roc, round(lo, 6) as auc_roc_ci_low, round(hi, 6) as auc_roc_ci_high, n_test_epochs, n_test_subjects from m
    join (select run, quantile_cont(auc, 0.025) as lo, quantile_cont(auc, 0.975) as hi from boots group by 1) using (run)
    join (select run, count(*) as n_test_epochs, count(distinct subject_id) as n_test_subjects from runs group by 1) using (run)""",
                  "v_pred_a", "v_pred_b", runs=RUNS, idx=IDX, weights=WEIGHTS, boots=wauc("runs", "run"), m=auc_sql("runs", "run")))
def run_evaluation(spark, sf) -> DataFrame:
    d = P.extended_metrics(both_runs(spark, sf), None, N_BOOT, by=["run"])
    return rounded(d.select("run", "auc_roc", "auc_roc_ci_low", "auc_roc_ci_high", "n_test_epochs", "n_test_subjects"))


@query(with_views("""
    select 'stage' as cut, x.k as cell, round(avg(x.auc - y.auc), 6) as delta_boot_mean, round(quantile_cont(x.auc - y.auc, 0.025), 6) as delta_ci_low,
           round(quantile_cont(x.auc - y.auc, 0.975), 6) as delta_ci_high, round(least(1, 2 * least(avg((x.auc - y.auc <= 0)::int), avg((x.auc - y.auc >= 0)::int))), 6) as p_two_sided
    from ba x join bb y using (k, replicate) group by x.k""", "v_epochs", "v_pred_a", "v_pred_b", idx=IDX, weights=WEIGHTS, ca="""
    select p.*, sleep_stage as k from v_pred_a p join v_epochs e on e.subject_id = p.subject_id and e.epoch_idx = p.epoch_idx""", cb="""
    select p.*, sleep_stage as k from v_pred_b p join v_epochs e on e.subject_id = p.subject_id and e.epoch_idx = p.epoch_idx""", ba=wauc("ca", "k"), bb=wauc("cb", "k")))
def stage_cell_deltas(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf).select(F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", F.col("sleep_stage").alias("cell"))
    d = both_runs(spark, sf).join(e, ["subject_id", "epoch_idx"]).withColumn("cut", F.lit("stage"))
    return rounded(P.anatomy_deltas(d, "a", "b", N_BOOT).select("cut", "cell", "delta_boot_mean", "delta_ci_low", "delta_ci_high", "p_two_sided"))
