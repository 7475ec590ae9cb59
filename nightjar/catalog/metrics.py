"""Queries for discrimination, thresholds, calibration and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.epochs import r
from nightjar.functions import expressions as X
from nightjar.operators import metrics as M
from nightjar.operators.running import midranks, union_all
from nightjar.plans import views as V
from nightjar.plans.views import with_views


def rounded(d: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def both_runs(spark, sf) -> DataFrame:
    return V.predictions(spark, sf, "a").withColumn("run", F.lit("a")).unionByName(
        V.predictions(spark, sf, "b").withColumn("run", F.lit("b")))


RUNS = "select 'a' as run, * from v_pred_a union all select 'b' as run, * from v_pred_b"


def auc_sql(src: str, by: str, extra: str = "") -> str:
    return f"""
    select {by}, sum(pos * (below + neg / 2.0::double)) / nullif(max(pt) * max(nt), 0)::double as auc,
           case when max(pt) > 0 and max(nt) > 0 then sum(pos * (pt - pbelow) / (pt - pbelow + nt - below)::double) / max(pt) end as average_precision,
           max(pt) as n_pos, max(nt) as n_neg
    from (select *, coalesce(sum(neg) over (w rows between unbounded preceding and 1 preceding), 0) as below,
                 coalesce(sum(pos) over (w rows between unbounded preceding and 1 preceding), 0) as pbelow,
                 sum(pos) over (partition by {by}) as pt, sum(neg) over (partition by {by}) as nt
          from (select {by}, pred_prob, sum(apnoea_label)::double as pos, sum(1 - apnoea_label)::double as neg from {src} {extra} group by {by}, pred_prob)
          window w as (partition by {by} order by pred_prob)) group by {by}"""


@query(with_views("select run, round(auc, 6) as auc, round(average_precision, 6) as average_precision, n_pos::bigint as n_pos, n_neg::bigint as n_neg from m",
                  "v_pred_a", "v_pred_b", runs=RUNS, m=auc_sql("runs", "run")))
def auc_and_average_precision(spark, sf) -> DataFrame:
    return rounded(M.discrimination(both_runs(spark, sf), ["run"]))


@query(with_views("select round(auc, 6) as auc, round(average_precision, 6) as average_precision, n_pos::bigint as n_pos, n_neg::bigint as n_neg from m",
                  "v_score_big", src="select 1 as k, * from v_score_big", m=auc_sql("src", "k")))
def auc_heavy_ties(spark, sf) -> DataFrame:
    return rounded(M.discrimination(V.score_big(spark, sf), []))


@query(with_views("""
    select pred_prob, n, n_below + (n + 1) / 2.0::double as midrank, round((n_below + (n + 1) / 2.0::double) / total, 9) as rank_share from (
        select *, coalesce(sum(n) over (order by pred_prob rows between unbounded preceding and 1 preceding), 0) as n_below, sum(n) over () as total
        from (select pred_prob, count(*) as n from v_score_big group by 1))""", "v_score_big"))
def midrank_scores(spark, sf) -> DataFrame:
    d = midranks(V.score_big(spark, sf), [], "pred_prob")
    return d.select("pred_prob", "n", "midrank", r(F.col("midrank") / F.col("n_total"), 9).alias("rank_share"))


CONF = """
    select run, sum((y = 0 and h = 0)::int)::bigint as tn, sum((y = 0 and h = 1)::int)::bigint as fp, sum((y = 1 and h = 0)::int)::bigint as fn, sum((y = 1 and h = 1)::int)::bigint as tp
    from (select run, apnoea_label as y, pred_label as h from runs) group by 1"""
RATIOS = """
    select run, tn, fp, fn, tp, round(tp / nullif(tp + fn, 0)::double, 6) as sensitivity, round(tn / nullif(tn + fp, 0)::double, 6) as specificity,
           round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as "precision", round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) as f1,
           round((tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double) / 2, 6) as balanced_accuracy from conf"""


@query(with_views(RATIOS, "v_pred_a", "v_pred_b", runs=RUNS, conf=CONF))
def confusion_metrics(spark, sf) -> DataFrame:
    return rounded(M.confusion(both_runs(spark, sf), ["run"]))


@query(with_views(RATIOS, runs="select 'all' as run, quality as apnoea_label, toxic as pred_label from labels", conf=CONF))
def document_label_confusion(spark, sf) -> DataFrame:
    d = V.table(spark, sf, "labels").withColumn("run", F.lit("all"))
    return rounded(M.confusion(d, ["run"], "quality", "toxic"))


GRID91 = M.linspace(0.05, 0.95, 91)


@query(with_views(f"""
    select run, arg_max(t, {{'f': f1, 'i': -i}}) as threshold, round(max(f1), 6) as f1 from (
        select run, i, t, coalesce(2.0::double * tp / nullif(np + pos, 0), 0) as f1 from (
            select run, i, t, sum((apnoea_label = 1 and pred_prob > t)::int) as tp, sum((pred_prob > t)::int) as np, sum(apnoea_label) as pos
            from runs, (select unnest(generate_series(0, 90)) as i, unnest([{', '.join(repr(t) + '::double' for t in GRID91)}]) as t) group by 1, 2, 3)) group by 1""",
                  "v_pred_a", "v_pred_b", runs=RUNS))
def best_f1_threshold(spark, sf) -> DataFrame:
    d = M.threshold_f1max(both_runs(spark, sf), ["run"])
    return d.withColumn("f1", r("f1"))


EDGES = M.linspace(0.0, 1.0, 11)[1:-1]


def bin_sql(col: str, edges) -> str:
    return "(" + " + ".join(f"({col} >= {e!r}::double)::int" for e in edges) + ")"


@query(with_views(f"""
    select run, subject_id, {bin_sql('pred_prob', EDGES)} as bin, count(*) as n, sum(apnoea_label)::double as sum_y, round(sum(pred_prob), 6) as sum_p,
           round(sum((pred_prob - apnoea_label) * (pred_prob - apnoea_label)), 6) as sum_sq from runs group by 1, 2, 3""", "v_pred_a", "v_pred_b", runs=RUNS))
def calibration_bins(spark, sf) -> DataFrame:
    return rounded(M.subject_bins(both_runs(spark, sf), ["run"], EDGES))


def _cal(bin_expr: str) -> str:
    return f"""
    select run, round(sum(abs(sy - sp)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier,
           round(1 - (sum(sq) / sum(n)) / ((sum(sy) / sum(n)) * (1 - sum(sy) / sum(n))), 6) as brier_skill, round(sum(sp) / sum(n) - sum(sy) / sum(n), 6) as citl,
           round(sum(sy) / sum(n), 6) as prevalence, round(sum(sp) / sum(n), 6) as mean_predicted
    from (select run, {bin_expr} as b, count(*)::double as n, sum(apnoea_label)::double as sy, sum(pred_prob) as sp,
                 sum((pred_prob - apnoea_label) * (pred_prob - apnoea_label)) as sq from src group by 1, 2) group by 1"""


@query(with_views(_cal(bin_sql("pred_prob", EDGES)), "v_pred_a", "v_pred_b", src=RUNS))
def calibration_equal_width(spark, sf) -> DataFrame:
    return rounded(M.calibration_summary(M.subject_bins(both_runs(spark, sf), ["run"], EDGES), ["run"]))


@query(with_views(_cal("(select count(*) from unnest(edges) u(e) where e <= pred_prob)"), "v_pred_a", "v_pred_b", src=f"""
    select r.*, edges from ({RUNS}) r join (select run, list_distinct([{', '.join(f'quantile_cont(pred_prob, {i / 10!r})' for i in range(1, 10))}]) as edges
    from ({RUNS}) group by 1) using (run)"""))
def calibration_equal_mass(spark, sf) -> DataFrame:
    from nightjar.operators.running import grouped_quantiles

    d = both_runs(spark, sf)
    q = grouped_quantiles(d, ["run"], "pred_prob", {f"q{i}": i / 10 for i in range(1, 10)})
    edges = q.select("run", F.array_distinct(F.array(*[f"q{i}" for i in range(1, 10)])).alias("edges"))
    return rounded(M.calibration_summary(M.subject_bins(d.join(edges, "run"), ["run"], F.col("edges")), ["run"]))


@query(with_views(_cal(bin_sql("pred_prob", EDGES)), "v_pred_a", "v_pred_b", src=f"""
    select run, apnoea_label, odds / (1 + odds) as pred_prob from (select *, c / (1 - c) / 2.5 as odds from (
        select *, greatest(least(pred_prob, {1 - 1e-9!r}::double), 1e-9) as c from ({RUNS})))"""))
def calibration_prior_corrected(spark, sf) -> DataFrame:
    d = both_runs(spark, sf).withColumn("pred_prob", X.prior_correct("pred_prob", 2.5))
    return rounded(M.calibration_summary(M.subject_bins(d, ["run"], EDGES), ["run"]))


@query(with_views(f"""
    select run, {bin_sql('pred_prob', EDGES)} as bin, count(*) as n, round(avg(pred_prob), 6) as mean_pred, round(avg(apnoea_label), 6) as observed
    from runs group by 1, 2""", "v_pred_a", "v_pred_b", runs=RUNS))
def reliability_curve(spark, sf) -> DataFrame:
    return rounded(M.reliability_curve(both_runs(spark, sf), ["run"]))


def line_sql(keys: str, src: str, iterations: int = 15) -> dict[str, str]:
    """CTEs of the same Newton steps; the last is named ``line``."""
    out = {"cells": f"""
        select {keys}, ln(q / (1 - q)) as x, count(*)::double as n, sum(apnoea_label)::double as y from (select *, greatest(least(pred_prob, 1 - 1e-6), 1e-6) as q from {src}) group by all""",
           "fit0": f"select {keys}, 0.0::double as a, 1.0::double as b from cells group by all having sum(y) > 0 and sum(y) < sum(n)"}
    for i in range(iterations):
        name = "line" if i == iterations - 1 else f"fit{i + 1}"
        out[name] = f"""
        select {keys}, a + (wxx * g - wx * gx) / (w * wxx - wx * wx) as a, b + (w * gx - wx * g) / (w * wxx - wx * wx) as b from (
            select {keys}, a, b, sum(y - n * p) as g, sum((y - n * p) * x) as gx, sum(n * p * (1 - p)) as w, sum(n * p * (1 - p) * x) as wx, sum(n * p * (1 - p) * x * x) as wxx
            from (select *, 1 / (1 + exp(-greatest(-30, least(30, a + b * x)))) as p from cells join fit{i} using ({keys})) group by all)"""
    return out


@query(with_views("select run, round(b, 6) as calibration_slope, round(a, 6) as calibration_intercept, count(*) as n_rows from runs join line using (run) group by all",
                  "v_pred_a", "v_pred_b", runs=RUNS, **line_sql("run", "runs")))
def calibration_slope(spark, sf) -> DataFrame:
    from nightjar.operators.fitting import calibration_lines

    return rounded(calibration_lines(both_runs(spark, sf), ["run"]))


@query(with_views("select run, stratum, round(b, 6) as calibration_slope, round(a, 6) as calibration_intercept, count(*) as n_rows from grouped join line using (run, stratum) group by all",
                  "v_pred_a", "v_pred_b", runs=RUNS, grouped="select *, subject_id % 7 as stratum from runs", **line_sql("run, stratum", "grouped")))
def calibration_slope_by_stratum(spark, sf) -> DataFrame:
    from nightjar.operators.fitting import calibration_lines

    return rounded(calibration_lines(both_runs(spark, sf).withColumn("stratum", F.col("subject_id") % 7), ["run", "stratum"]))


# ---- subject-level rates ----------------------------------------------------------------------

RATES = """
    select run, subject_id, count(apnoea_label) as n_epochs, sum(apnoea_label)::bigint as n_apnoea_gt, sum(pred_label)::bigint as n_apnoea_pred,
           sum(apnoea_label) * 120.0::double / count(*) as gt, sum(pred_label) * 120.0::double / count(*) as pr from runs group by 1, 2"""


@query(with_views("select run, subject_id, n_epochs, n_apnoea_gt, n_apnoea_pred, round(gt, 6) as ahi_proxy_gt, round(pr, 6) as ahi_proxy_pred from rates",
                  "v_pred_a", "v_pred_b", runs=RUNS, rates=RATES))
def subject_event_rates(spark, sf) -> DataFrame:
    return rounded(M.event_rates(both_runs(spark, sf), ["run"]))


TIER = "(({c} >= 30)::int + ({c} >= 36)::int + ({c} >= 45)::int)"


def _scaled(spark, sf) -> DataFrame:
    """Rates scaled so that all four tiers occur."""
    d = M.event_rates(both_runs(spark, sf), ["run"])
    return d.withColumns({"gt": F.col("n_apnoea_gt") / F.col("n_epochs") * 60, "pr": F.col("n_apnoea_pred") / F.col("n_epochs") * 60})


SCALED = "select run, subject_id, n_apnoea_gt / n_epochs::double * 60 as gt, n_apnoea_pred / n_epochs::double * 60 as pr from rates"
T4 = "(({c} >= 5)::int + ({c} >= 15)::int + ({c} >= 30)::int)"


@query(with_views(f"""
    select run, t as true_tier, sum((p = 0)::int)::bigint as pred_0, sum((p = 1)::int)::bigint as pred_1, sum((p = 2)::int)::bigint as pred_2, sum((p = 3)::int)::bigint as pred_3
    from (select run, unnest([0, 1, 2, 3]) as t from (select distinct run from scaled)) s
    left join (select run, {T4.format(c='gt')} as t, {T4.format(c='pr')} as p from scaled) using (run, t) group by 1, 2""",
                  "v_pred_a", "v_pred_b", runs=RUNS, rates=RATES, scaled=SCALED).replace("sum((p", "sum((coalesce(p, -1)"))
def severity_crosstab(spark, sf) -> DataFrame:
    return M.tier_crosstab(_scaled(spark, sf), ["run"], "gt", "pr")


def _agreement_sql(src: str, by: str) -> str:
    return f"""
    select {by}, count(*) as n, round(avg(abs(x - y)), 6) as mae, round(avg(x - y), 6) as bias,
           round(avg(x - y) - 1.96 * stddev_samp(x - y), 6) as loa_low, round(avg(x - y) + 1.96 * stddev_samp(x - y), 6) as loa_high,
           round(corr(x, y), 6) as pearson_r, round(corr(rx, ry), 6) as spearman_rho, round(max(icc), 6) as icc_a1,
           round(avg((a = b)::int), 6) as severity_accuracy, round(max(kappa), 6) as severity_quadratic_kappa
    from (select *, rank() over (partition by {by} order by x) + (count(*) over (partition by {by}, x) - 1) / 2.0 as rx,
                 rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0 as ry,
                 {T4.format(c='x')} as a, {T4.format(c='y')} as b from {src})
    join (select {by}, (msr - mse) / (msr + mse + 2.0 / n * (msc - mse)) as icc from (
              select {by}, n, msr, msc, sse / (n - 1) as mse from (
                  select {by}, count(*) as n, 2 * sum(power((x + y) / 2 - g, 2)) / (count(*) - 1) as msr,
                         count(*) * (power(avg(x) - max(g), 2) + power(avg(y) - max(g), 2)) as msc,
                         sum(power(x - (x + y) / 2 - mx + g, 2) + power(y - (x + y) / 2 - my + g, 2)) as sse
                  from (select *, avg(x) over (partition by {by}) as mx, avg(y) over (partition by {by}) as my,
                               (avg(x) over (partition by {by}) + avg(y) over (partition by {by})) / 2 as g from {src}) group by {by}))) using ({by})
    join (select {by}, 1 - sum(w * o) / sum(w * e) as kappa from (
              select c.{by}, power(i - j, 2) / 9.0 as w, coalesce(o, 0) as o, ra * cb / tot::double as e
              from (select {by}, i, j from (select distinct {by} from {src}), (select unnest([0,1,2,3]) as i), (select unnest([0,1,2,3]) as j)) c
              left join (select {by}, {T4.format(c='x')} as i, {T4.format(c='y')} as j, count(*) as o from {src} group by 1, 2, 3) k using ({by}, i, j)
              join (select {by}, i, sum(({T4.format(c='x')} = i)::int) as ra from {src}, (select unnest([0,1,2,3]) as i) group by 1, 2) ra using ({by}, i)
              join (select {by}, j, sum(({T4.format(c='y')} = j)::int) as cb from {src}, (select unnest([0,1,2,3]) as j) group by 1, 2) cb using ({by}, j)
              join (select {by}, count(*) as tot from {src} group by 1) t using ({by})) group by {by}) using ({by})
    group by {by}"""


@query(with_views(_agreement_sql("xy", "run"), "v_pred_a", "v_pred_b", runs=RUNS, rates=RATES, scaled=SCALED,
                  xy="select run, pr as x, gt as y from scaled"))
def rate_agreement(spark, sf) -> DataFrame:
    return rounded(M.agreement(_scaled(spark, sf), ["run"], "pr", "gt"))


@query(with_views("select run, subject_id, round((pr + gt) / 2, 6) as pair_mean, round(pr - gt, 6) as diff from scaled",
                  "v_pred_a", "v_pred_b", runs=RUNS, rates=RATES, scaled=SCALED))
def bland_altman_pairs(spark, sf) -> DataFrame:
    return rounded(M.bland_altman(_scaled(spark, sf), "pr", "gt").select("run", "subject_id", "pair_mean", "diff"))


PER_SUBJECT = """
    select e.subject_id, e.epoch_pred, r1.n / (e.n * 30 / 3600.0::double) as run_pred, e.epoch_true, r2.n / (e.n * 30 / 3600.0::double) as run_true, ev.n / (e.n * 30 / 3600.0::double) as xml_ahi
    from (select subject_id, count(*) as n, sum(pred_label) / (count(*) * 30 / 3600.0::double) as epoch_pred, sum(apnoea_label) / (count(*) * 30 / 3600.0::double) as epoch_true from runs group by 1) e
    left join (select subject_id, count(*) as n from (select subject_id, epoch_idx - lag(epoch_idx) over (partition by subject_id order by epoch_idx) as g from runs where pred_label = 1) where g is null or g > 1 group by 1) r1 using (subject_id)
    left join (select subject_id, count(*) as n from (select subject_id, epoch_idx - lag(epoch_idx) over (partition by subject_id order by epoch_idx) as g from runs where apnoea_label = 1) where g is null or g > 1 group by 1) r2 using (subject_id)
    left join (select v.subject_id, count(s.subject_id) as n from v_scored_events v left join (select subject_id, epoch_idx from v_epochs where sleep_stage in ('N1','N2','N3','REM')) s
          on s.subject_id = v.subject_id and s.epoch_idx = floor((v.start_sec + v.duration_sec / 2) / 30) group by 1) ev using (subject_id)"""


@query(with_views(_agreement_sql("xy", "pair"), "v_epochs", "v_pred_a", "v_scored_events", runs="select 'a' as run, * from v_pred_a", per=PER_SUBJECT, xy="""
    select * from (select 'run_pred' as pair, run_pred as x, xml_ahi as y from per union all select 'epoch_pred', epoch_pred, xml_ahi from per
    union all select 'run_true', run_true, xml_ahi from per union all select 'epoch_true', epoch_true, xml_ahi from per) where x is not null and y is not null"""))
def event_index_agreement(spark, sf) -> DataFrame:
    from nightjar.plans.evaluation import event_indices

    per = event_indices(V.predictions(spark, sf, "a"), V.epochs(spark, sf), V.scored_events(spark, sf))
    long = per.unpivot(["subject_id", "xml_ahi"], ["run_pred", "epoch_pred", "run_true", "epoch_true"], "pair", "x")
    return rounded(M.agreement(long, ["pair"], "x", "xml_ahi"))


REFERENCES = """
    select user_id::integer as subject_id, case when user_id % 5 <> 0 then avg(value) / 4 end as rdi0p, case when user_id % 7 <> 1 then avg(value) / 6 end as ahi_a0h3a,
           (count(*) filter (value > 70)) * 40.0::double / count(*) as ahi_a0h4 from events group by 1, user_id"""
WITH_REFERENCES = "select p.*, r.rdi0p, r.ahi_a0h3a, r.ahi_a0h4 from per p left join refs r using (subject_id)"


def _pair_sql(pairs) -> str:
    return " union all ".join(f"select '{e} vs {f}' as pair, {e} as x, {f} as y from known where {e} is not null and {f} is not null" for e, f in pairs)


INDEX_VIEWS = {"runs": "select 'a' as run, * from v_pred_a", "per": PER_SUBJECT, "refs": REFERENCES, "known": WITH_REFERENCES}
GAPS = (("xml_ahi", "rdi0p"), ("xml_ahi", "ahi_a0h3a"), ("run_true", "xml_ahi"))


def _indices_with_references(spark, sf) -> DataFrame:
    from nightjar.plans.evaluation import event_indices

    u, v, m = F.col("subject_id"), F.col("value"), F.col("m")
    refs = V.table(spark, sf, "events").groupBy(F.col("user_id").cast("int").alias("subject_id")).agg(X.exact_mean(v).alias("m"), (F.count(F.when(v > 70, 1)) * 40.0 / F.count("*")).alias("ahi_a0h4")).select(
        "subject_id", F.when(u % 5 != 0, m / 4).alias("rdi0p"), F.when(u % 7 != 1, m / 6).alias("ahi_a0h3a"), "ahi_a0h4")
    return event_indices(V.predictions(spark, sf, "a"), V.epochs(spark, sf), V.scored_events(spark, sf)).join(refs, "subject_id", "left")


@query(with_views(f"select split_part(pair, ' vs ', 1) as estimator, split_part(pair, ' vs ', 2) as reference, * exclude (pair) from ({_agreement_sql('xy', 'pair')})",
                  "v_epochs", "v_pred_a", "v_scored_events", **INDEX_VIEWS,
                  xy=_pair_sql((e, f) for e in ("run_pred", "epoch_pred", "run_true", "epoch_true") for f in ("xml_ahi", "rdi0p", "ahi_a0h3a", "ahi_a0h4"))))
def event_index_table(spark, sf) -> DataFrame:
    from nightjar.plans.evaluation import event_index_table as table

    return rounded(table(_indices_with_references(spark, sf), []))


@query(with_views(f"""
    select 'gap' as kind, split_part(pair, ' vs ', 1) as estimator, split_part(pair, ' vs ', 2) as reference, null::double as median, * exclude (pair) from ({_agreement_sql('xy', 'pair')})
    union all by name select 'median' as kind, reference, round(median, 6) as median from (
        {" union all ".join(f"select '{f}' as reference, quantile_cont({f}, 0.5) as median from known" for f in ("xml_ahi", "rdi0p", "ahi_a0h3a", "ahi_a0h4"))})""",
                  "v_epochs", "v_pred_a", "v_scored_events", **INDEX_VIEWS, xy=_pair_sql(GAPS)))
def reference_gaps(spark, sf) -> DataFrame:
    from nightjar.plans.evaluation import reference_gaps as gaps

    return rounded(gaps(_indices_with_references(spark, sf)))


# ---- five classes -----------------------------------------------------------------------------

CM = 'select "true", pred, count(*) as n from v_class5 group by 1, 2'
MULTI = """
    select {by}round(po, 6) as accuracy, round((po - pe) / (1 - pe), 6) as kappa, round(macro, 6) as macro_f1, {f1}
    from (select {by}max(po) as po, sum(r * c) / max(tot * tot) as pe, avg(f1) as macro, {f1agg}
          from (select {by}k, r, c, d, tot, po, 2 * d / nullif(r + c, 0) as f1 from (
                select {by}k, sum(case when "true" = k then n else 0 end)::double as r, sum(case when pred = k then n else 0 end)::double as c,
                       sum(case when "true" = k and pred = k then n else 0 end)::double as d, sum(n)::double as tot,
                       sum(case when "true" = pred then n else 0 end)::double / sum(n) as po
                from cm, generate_series(0, 4) g(k) group by {by}k)) {grp})"""


def _multi(by: str) -> str:
    return MULTI.format(by=by, f1=", ".join(f"round(f{k}, 6) as f1_{k}" for k in range(5)),
                        f1agg=", ".join(f"max(f1) filter (k = {k}) as f{k}" for k in range(5)), grp=f"group by {by.rstrip(', ')}" if by else "")


@query(with_views(_multi(""), "v_class5", cm=CM))
def multiclass_metrics(spark, sf) -> DataFrame:
    counts = V.class5(spark, sf).groupBy("true", "pred").agg(F.count("*").alias("n"))
    return rounded(M.multiclass_metrics(counts, [], [0, 1, 2, 3, 4]))


@query(with_views('select subject_id, "true", pred, count(*) as n from v_class5 group by 1, 2, 3', "v_class5"))
def subject_confusion_cube(spark, sf) -> DataFrame:
    return V.class5(spark, sf).groupBy("subject_id", "true", "pred").agg(F.count("*").alias("n"))


@query(with_views("""
    select round(quantile_cont(kappa, 0.25), 5) as q25, round(quantile_cont(kappa, 0.5), 5) as median, round(quantile_cont(kappa, 0.75), 5) as q75 from (
        select subject_id, (po - pe) / (1 - pe) as kappa from (
            select subject_id, max(po) as po, sum(r * c) / max(tot * tot) as pe from (
                select subject_id, k, sum(("true" = k)::int)::double as r, sum((pred = k)::int)::double as c, count(*)::double as tot, avg(("true" = pred)::int) as po
                from v_class5, generate_series(0, 4) g(k) group by 1, 2) group by 1))""", "v_class5"))
def subject_kappa_quartiles(spark, sf) -> DataFrame:
    from nightjar.operators.running import grouped_quantiles

    counts = V.class5(spark, sf).groupBy("subject_id", "true", "pred").agg(F.count("*").alias("n"))
    k = M.multiclass_metrics(counts, ["subject_id"], [0, 1, 2, 3, 4]).withColumn("g", F.lit(1))
    q = grouped_quantiles(k, ["g"], "kappa", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return rounded(q.select("q25", "median", "q75"), 5)


@query(with_views("""
    select round(1 - sum(power(("true" - pred), 2) * n) / (select sum(power(a."true" - b.pred, 2) * a.n * b.n) / (select sum(n) from cm)
        from (select "true", sum(n) as n from cm group by 1) a, (select pred, sum(n) as n from cm group by 1) b), 6) as kappa from cm""", "v_class5", cm=CM))
def quadratic_kappa(spark, sf) -> DataFrame:
    counts = V.class5(spark, sf).groupBy("true", "pred").agg(F.count("*").alias("n"))
    return rounded(M.quadratic_kappa(counts, [], "true", "pred", "n", 5))


# ---- quality and aggregates over seeds --------------------------------------------------------

@query(with_views("""
    select count(*) as n_subjects, round(avg(f), 6) as mean, round(max(f), 6) as max, round(quantile_cont(f, 0.5), 6) as median, round(quantile_cont(f, 0.9), 6) as p90,
           sum((f > 0.2)::int)::bigint as n_gt_0_2, sum((f > 0.5)::int)::bigint as n_gt_0_5
    from (select subject_id, avg((value is null)::int) as f from v_signal group by 1)""", "v_signal"))
def missing_share_summary(spark, sf) -> DataFrame:
    return rounded(M.null_fraction_summary(V.signal(spark, sf), "subject_id", "value"))


@query("""
    select key, count(distinct seed) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from (
        select l_suppkey % 3 as seed, l_returnflag || '.' || (l_partkey % 400) as key, avg(l_discount) as value from lineitem group by 1, 2)
    group by 1 having count(distinct seed) = 3""")
def seed_mean_and_sd(spark, sf) -> DataFrame:
    long = V.table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 3).alias("seed"), F.concat(F.col("l_returnflag"), F.lit("."), F.col("l_partkey") % 400).alias("key")).agg(
        F.avg("l_discount").alias("value"))
    return rounded(M.seed_mean_sd(long, 3))


ANATOMY_SRC = """
    select r.run, r.subject_id, r.apnoea_label, r.pred_prob, r.pred_label, e.sleep_stage,
           case when e.x < 20 then 'short <20 s' when e.x < 40 then 'medium 20-40 s' else 'long >=40 s' end as event_duration,
           case when e.event_id % 5 = 0 then 'supine' when e.event_id % 5 = 1 then null else 'non-supine' end as position
    from runs r join v_epochs e on e.subject_id = r.subject_id and e.epoch_idx = r.epoch_idx"""
ANATOMY_LONG = " union all ".join(f"select run, subject_id, apnoea_label, pred_prob, pred_label, '{c}' as cut, {c} as cell from src where {c} is not null"
                                  for c in ("sleep_stage", "event_duration", "position"))


@query(with_views("""
    select cut, cell, run, n_epochs, n_pos, n_subjects, sens, spec, case when n_pos >= 20 and n_pos <= n_epochs - 20 then round(auc, 6) end as auc from (
        select cut, cell, run, count(*) as n_epochs, sum(apnoea_label)::bigint as n_pos, count(distinct subject_id) as n_subjects,
               round(avg(pred_label) filter (apnoea_label = 1), 6) as sens, round(1 - avg(pred_label) filter (apnoea_label = 0), 6) as spec from long group by 1, 2, 3)
    left join (select k, auc from m) on k = cut || '|' || cell || '|' || run""", "v_epochs", "v_pred_a", "v_pred_b", runs=RUNS, src=ANATOMY_SRC, long=ANATOMY_LONG,
                  keyed="select *, cut || '|' || cell || '|' || run as k from long", m=auc_sql("keyed", "k")))
def error_anatomy(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf).select(
        F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", "sleep_stage",
        X.cut_label("x", (20, 40), ("short <20 s", "medium 20-40 s", "long >=40 s")).alias("event_duration"),
        F.when(F.col("event_id") % 5 == 0, "supine").when(F.col("event_id") % 5 != 1, "non-supine").alias("position"))
    d = both_runs(spark, sf).join(e, ["subject_id", "epoch_idx"])
    return rounded(M.error_anatomy(d, ["sleep_stage", "event_duration", "position"], ["a", "b"]))


SIX_CUTS = ("sleep_stage", "severity_tier", "event_duration", "event_type", "desat_depth", "position")
SIX_SRC = """
    select r.run, r.subject_id, r.apnoea_label, r.pred_prob, r.pred_label, e.sleep_stage,
           case when f.ahi_a0h3a < 5 then 'none' when f.ahi_a0h3a < 15 then 'mild' when f.ahi_a0h3a < 30 then 'moderate' when f.ahi_a0h3a is not null then 'severe' end as severity_tier,
           case when event_id % 3 = 0 then null when e.x < 20 then 'short <20 s' when e.x < 40 then 'medium 20-40 s' else 'long >=40 s' end as event_duration,
           case event_id % 3 when 1 then 'Hypopnea' when 2 then 'Obstructive apnea' end as event_type,
           case when event_id % 4 = 0 then 'no desat' when e.x / 5 < 6 then '<6 %' when e.x / 5 < 9 then '6-9 %' else '>=9 %' end as desat_depth,
           case event_id % 5 when 0 then 'supine' when 1 then 'unknown' else 'non-supine' end as position
    from runs r join v_epochs e on e.subject_id = r.subject_id and e.epoch_idx = r.epoch_idx left join refs f on f.subject_id = r.subject_id"""
SIX_LONG = " union all ".join(f"select run, subject_id, apnoea_label, pred_prob, pred_label, '{c}' as cut, {c} as cell from src where {c} is not null" for c in SIX_CUTS)


@query(with_views("""
    select cut, cell, run, n_epochs, n_pos, n_subjects, sens, spec, case when n_pos >= 20 and n_pos <= n_epochs - 20 then round(auc, 6) end as auc from (
        select cut, cell, run, count(*) as n_epochs, sum(apnoea_label)::bigint as n_pos, count(distinct subject_id) as n_subjects,
               round(avg(pred_label) filter (apnoea_label = 1), 6) as sens, round(1 - avg(pred_label) filter (apnoea_label = 0), 6) as spec from long group by 1, 2, 3)
    left join (select k, auc from m) on k = cut || '|' || cell || '|' || run""", "v_epochs", "v_pred_a", "v_pred_b", runs=RUNS,
                  refs="select user_id as subject_id, case when user_id % 7 <> 1 then avg(value) / 3 end as ahi_a0h3a from events group by user_id", src=SIX_SRC, long=SIX_LONG,
                  keyed="select *, cut || '|' || cell || '|' || run as k from long", m=auc_sql("keyed", "k")))
def error_anatomy_six_cuts(spark, sf) -> DataFrame:
    x, e = F.col("x"), F.col("event_id")
    names = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (e % n + 1).cast("int"))
    context = V.epochs(spark, sf).select(
        F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", "sleep_stage", F.when(e % 3 != 0, x).alias("event_duration_s"),
        names(3, "", "Hypopnea", "Obstructive apnea").alias("event_kind"), F.when(e % 4 != 0, x / 5).alias("desat_depth"),
        names(5, "supine", "unknown", "left", "right", "prone").alias("position"))
    refs = V.table(spark, sf, "events").groupBy(F.col("user_id").cast("int").alias("subject_id")).agg(F.avg("value").alias("m")).select(
        "subject_id", F.when(F.col("subject_id") % 7 != 1, F.col("m") / 3).alias("ahi_a0h3a"))
    d = both_runs(spark, sf).join(M.anatomy_cells(context, refs), ["subject_id", "epoch_idx"])
    return rounded(M.error_anatomy(d, list(M.ANATOMY_CUTS), ["a", "b"]))
