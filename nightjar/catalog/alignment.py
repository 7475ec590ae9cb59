"""Queries that align runs, attach metadata and check contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.metrics import both_runs, rounded
from nightjar.functions import expressions as X
from nightjar.operators import align as A
from nightjar.operators import columns as C
from nightjar.operators.running import union_all
from nightjar.plans import views as V
from nightjar.plans.views import with_views


def _partial_b(spark, sf) -> DataFrame:
    """Run b without the wake epochs of even subjects, so that rows are one-sided."""
    e = V.epochs(spark, sf).select(F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", "sleep_stage")
    return V.predictions(spark, sf, "b").join(e, A.KEY).where((F.col("sleep_stage") != "W") | (F.col("subject_id") % 2 == 1)).drop("sleep_stage")


PARTIAL = """
    select b.* from v_pred_b b join v_epochs e on e.subject_id = b.subject_id and e.epoch_idx = b.epoch_idx
    where sleep_stage <> 'W' or b.subject_id % 2 = 1"""


@query(with_views("""
    select a.subject_id, a.epoch_idx, a.apnoea_label, a.pred_prob as prob_a, b.pred_prob as prob_b
    from v_pred_a a join partial b using (subject_id, epoch_idx)""", "v_epochs", "v_pred_a", "v_pred_b", partial=PARTIAL))
def aligned_runs(spark, sf) -> DataFrame:
    return A.align_runs(V.predictions(spark, sf, "a"), _partial_b(spark, sf))


@query(with_views("""
    select count(*) filter (a.subject_id is not null and b.subject_id is not null) as n_pairs, count(*) filter (b.subject_id is null) as only_a,
           count(*) filter (a.subject_id is null) as only_b, count(*) filter (a.apnoea_label <> b.apnoea_label) as label_mismatches
    from v_pred_a a full outer join partial b on a.subject_id = b.subject_id and a.epoch_idx = b.epoch_idx""",
                  "v_epochs", "v_pred_a", "v_pred_b", partial=PARTIAL))
def alignment_report(spark, sf) -> DataFrame:
    return A.alignment_report(V.predictions(spark, sf, "a"), _partial_b(spark, sf))


@query(with_views("""
    select a.subject_id, a.epoch_idx, a.apnoea_label, a.pred_prob as prob_a, b.pred_prob as prob_b
    from v_pred_a a join v_pred_b b using (subject_id, epoch_idx)""", "v_pred_a", "v_pred_b"))
def strictly_aligned_runs(spark, sf) -> DataFrame:
    return A.align_strict(V.predictions(spark, sf, "a"), V.predictions(spark, sf, "b"))


@query(with_views("""
    select k.subject_id, k.epoch_idx, k.apnoea_label::tinyint as apnoea_label, s.pred_prob, cast(s.pred_prob > 0.4 as bigint) as pred_label
    from v_pred_b k join v_pred_a s using (subject_id, epoch_idx)""", "v_pred_a", "v_pred_b"))
def assembled_predictions(spark, sf) -> DataFrame:
    return A.assemble_predictions(V.predictions(spark, sf, "a"), V.predictions(spark, sf, "b").select(*A.KEY, "apnoea_label"), 0.4)


@query(with_views("""
    select 0::bigint as duplicates, count(*) filter (s.subject_id is null) as missing, count(*) filter (k.subject_id is null) as extra, 0::bigint as label_mismatches
    from v_pred_a k full outer join partial s on k.subject_id = s.subject_id and k.epoch_idx = s.epoch_idx""", "v_epochs", "v_pred_a", "v_pred_b", partial=PARTIAL))
def assembly_report(spark, sf) -> DataFrame:
    return A.assembly_report(_partial_b(spark, sf), V.predictions(spark, sf, "a"))


@query(with_views("""
    select count(*) as n_rows, 0::bigint as n_null, 0::bigint as n_duplicate_keys,
           (select count(*) from v_pred_a) - (select count(*) from partial) as n_key_violations from v_pred_a""",
                  "v_epochs", "v_pred_a", "v_pred_b", partial=PARTIAL))
def prediction_contract(spark, sf) -> DataFrame:
    p = V.predictions(spark, sf, "a").withColumn("apnoea_label", F.col("apnoea_label").cast("tinyint"))
    return A.check_predictions(p, _partial_b(spark, sf))


@query(with_views("select subject_id, epoch_idx, pred_prob from v_pred_a order by 1, 2", "v_pred_a"))
def canonical_order(spark, sf) -> DataFrame:
    return A.canonical_order(V.predictions(spark, sf, "a").select("subject_id", "epoch_idx", "pred_prob"))


@query(with_views("""
    select p.subject_id, p.epoch_idx, c.c_acctbal as acctbal, c.c_mktsegment as segment from v_pred_a p
    left join customer c on c.c_custkey = p.subject_id and c.c_custkey % 3 <> 0""", "v_pred_a"))
def predictions_with_metadata(spark, sf) -> DataFrame:
    # customers stand for subjects; ids come as prefixed text, every third one is unparsable
    c = V.table(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("shhs1-"), F.col("c_custkey"))).otherwise("unknown")
    meta = c.select(text.alias("subject_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return A.attach_metadata(V.predictions(spark, sf, "a").select("subject_id", "epoch_idx"), meta, ["acctbal", "segment"])


@query("""
    select c_custkey as subject_id, n, round(total, 4) as total from customer
    left join (select o_custkey, count(*) as n, sum(o_totalprice) as total from orders where o_orderstatus = 'P' group by 1) o on o_custkey = c_custkey""")
def reindexed_subjects(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("subject_id")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    return A.reindex(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id")), o)


@query("""
    select 'in' as side, count(*) as n from events where user_id in (select o_custkey from orders where o_orderpriority = '1-URGENT') union all
    select 'out', count(*) from events where user_id not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def membership_filters(spark, sf) -> DataFrame:
    ids = V.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    e = V.table(spark, sf, "events").select("user_id")
    return union_all([e.join(ids, "user_id", "left_semi").agg(F.lit("in").alias("side"), F.count("*").alias("n")),
                      e.join(ids, "user_id", "left_anti").agg(F.lit("out").alias("side"), F.count("*").alias("n"))])


def _context(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf)
    kind = F.when(F.col("x") < 90, "hypopnoea").when(F.col("x") < 180, "apnoea")
    return e.select(F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", kind.alias("event_kind"),
                    F.when(F.col("x") < 180, F.col("x") / 4).alias("event_duration_s"))


@query(with_views("""
    select p.subject_id, p.epoch_idx, p.apnoea_label, p.pred_prob from v_pred_a p join v_epochs e on e.subject_id = p.subject_id and e.epoch_idx = p.epoch_idx
    where p.apnoea_label = 0 or (x < 90 and x / 4 < 20)""", "v_epochs", "v_pred_a"))
def short_event_endpoint(spark, sf) -> DataFrame:
    d = A.short_event_endpoint(V.predictions(spark, sf, "a"), _context(spark, sf))
    return d.select("subject_id", "epoch_idx", "apnoea_label", "pred_prob")


@query(with_views("""
    select 0::bigint as only_a, 0::bigint as only_b, count(*) filter (round(a.pred_prob, 8) <> round(b.pred_prob, 8)) as diff_pred_prob,
           count(*) filter (a.pred_label <> b.pred_label) as diff_pred_label, count(*) filter (a.apnoea_label <> b.apnoea_label) as diff_apnoea_label
    from v_pred_a a join v_pred_b b using (subject_id, epoch_idx)""", "v_pred_a", "v_pred_b"))
def frame_difference(spark, sf) -> DataFrame:
    return A.frame_diff(V.predictions(spark, sf, "a"), V.predictions(spark, sf, "b"), A.KEY, ["pred_prob", "pred_label", "apnoea_label"])


@query(with_views("""
    select count(*) as n, round(max(abs(a.pred_prob - b.pred_prob)), 6) as max_abs_prob_diff, 0::bigint as label_mismatches,
           count(*) filter (a.pred_label <> b.pred_label) as pred_label_mismatches, round((select auc from ma) - (select auc from mb), 6) as auc_diff
    from v_pred_a a join v_pred_b b using (subject_id, epoch_idx)""", "v_pred_a", "v_pred_b", **{
        f"m{k}": f"""select (sum(r) filter (apnoea_label = 1) - count(*) filter (apnoea_label = 1) * (count(*) filter (apnoea_label = 1) + 1) / 2.0::double)
                     / (count(*) filter (apnoea_label = 1) * count(*) filter (apnoea_label = 0)) as auc
                     from (select apnoea_label, rank() over (order by pred_prob) + (count(*) over (partition by pred_prob) - 1) / 2.0::double as r from v_pred_{k})"""
        for k in "ab"}))
def reproduction_check(spark, sf) -> DataFrame:
    return rounded(A.reproduction_check(V.predictions(spark, sf, "a"), V.predictions(spark, sf, "b")))


@query(with_views("""
    select subject_id, n_epochs, n_sleep, n_apnoea, n_epochs = n_orders as n_epochs_ok, n_sleep = n_pred as n_sleep_ok, n_apnoea = n_pos as apnoea_sum_ok
    from (select subject_id, count(*) as n_epochs, count(*) filter (sleep_stage in ('N1','N2','N3','REM')) as n_sleep,
                 coalesce(sum(apnoea_label) filter (sleep_stage in ('N1','N2','N3','REM')), 0)::bigint as n_apnoea from v_epochs group by 1)
    join (select subject_id, count(*) as n_orders, count(*) filter (pred_prob < 0.45) as n_pred, sum(pred_label)::bigint as n_pos from v_pred_b group by 1) using (subject_id)""",
                  "v_epochs", "v_pred_b"))
def label_parity(spark, sf) -> DataFrame:
    from nightjar.operators.quality import label_parity

    p = V.predictions(spark, sf, "b").groupBy(F.col("subject_id").cast("bigint").alias("subject_id")).agg(
        F.count("*").alias("n_epochs"), F.count_if(F.col("pred_prob") < 0.45).alias("n_sleep"), F.sum("pred_label").alias("n_apnoea"))
    return label_parity(V.epochs(spark, sf), p)


@query(with_views("""
    select subject_id, sleep_hours, nsrr, round((sleep_hours - nsrr) / nullif(nsrr, 0), 6) as rel_error, coalesce(abs((sleep_hours - nsrr) / nullif(nsrr, 0)) > 0.05, false) as off
    from (select subject_id, count(*) filter (sleep_stage in ('N1','N2','N3','REM'))::double as sleep_hours, count(*) filter (sleep_stage <> 'W') * 0.75::double as nsrr from v_epochs group by 1)""", "v_epochs"))
def cross_source_check(spark, sf) -> DataFrame:
    from nightjar.operators.quality import cross_source_check

    g = V.epochs(spark, sf).groupBy("subject_id").agg(
        F.count_if(X.is_sleep("sleep_stage")).cast("double").alias("sleep_hours"), (F.count_if(F.col("sleep_stage") != "W") * F.lit(0.75)).alias("nsrr"))
    return rounded(cross_source_check(g, "sleep_hours", "nsrr"))


@query("""
    select l_returnflag as run_group, count(*) as n_runs, count(distinct l_linestatus) = 1 as one_linestatus, count(distinct l_tax) = 1 as one_tax from lineitem group by 1""")
def run_consistency(spark, sf) -> DataFrame:
    from nightjar.operators.quality import run_consistency

    l = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run_group"), F.col("l_linestatus").alias("linestatus"), F.col("l_tax").alias("tax"))
    return run_consistency(l, ["run_group"], ["linestatus", "tax"])


@query("""
    select user_id as subject_id, event_id, recorded, recomputed from (
        select user_id, event_id, case when value > 100 then 'high' else '' end as recorded,
               concat_ws(',', case when value > 100 then 'high' end, case when event_type = 'error' then 'error' end) as recomputed,
               row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
    where rn = 1 and recorded <> recomputed""")
def flag_drift(spark, sf) -> DataFrame:
    from nightjar.operators.quality import flag_drift, latest

    e = V.table(spark, sf, "events").select(F.col("user_id").alias("subject_id"), "ts", "event_id", "value", "event_type",
                                            F.when(F.col("value") > 100, "high").otherwise("").alias("recorded"))
    flags = F.array(F.when(F.col("value") > 100, "high"), F.when(F.col("event_type") == "error", "error"))
    return flag_drift(latest(e, ["subject_id"], ["ts", "event_id"]), "recorded", flags).select("subject_id", "event_id", "recorded", "recomputed")


LAST = "select user_id as subject_id, event_type as detector, value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events"


def _last_attempts(spark, sf) -> DataFrame:
    from nightjar.operators.quality import latest

    e = V.table(spark, sf, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("detector"), "value", "ts", "event_id")
    return latest(e, ["subject_id"], ["ts", "event_id"])


@query(f"select detector, count(*) as n, count(*) filter (value < 5) as n_failed from ({LAST}) where rn = 1 group by 1")
def frontend_quality(spark, sf) -> DataFrame:
    return _last_attempts(spark, sf).groupBy("detector").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("n_failed"))


@query(f"select subject_id, detector, case when value < 2 then 'too_few_peaks' else 'flat_signal' end as reason from ({LAST}) where rn = 1 and value < 5")
def frontend_failures(spark, sf) -> DataFrame:
    reason = F.when(F.col("value") < 2, "too_few_peaks").otherwise("flat_signal")
    return _last_attempts(spark, sf).where("value < 5").select("subject_id", "detector", reason.alias("reason"))


# ---- column sets -------------------------------------------------------------------------------

NAMES = "select p_partkey, case p_partkey % 6 " + " ".join(
    f"when {i} then '{b}'" for i, b in enumerate(("spo2_min", "hr_mean", "resp_thor_rms", "eeg_beta_rel", "odi3_count", "position_supine_frac"))
) + " end || case p_size % 4 when 0 then '' when 1 then '_lag1' when 2 then '_lead1' else '_roll5_std' end as name from part"


@query(f"""
    select p_partkey, name, regexp_replace(name, '(_lag1|_lead1|_roll5_std)$', '') as base,
           case when name like 'spo2_min%' or name like 'odi3_count%' then 'aasm' when name like 'resp_thor%' then 'unknown' else 'physio' end as class from ({NAMES})""")
def feature_taxonomy(spark, sf) -> DataFrame:
    bases = F.array(*[F.lit(b) for b in ("spo2_min", "hr_mean", "resp_thor_rms", "eeg_beta_rel", "odi3_count", "position_supine_frac")])
    suffix = F.array(F.lit(""), F.lit("_lag1"), F.lit("_lead1"), F.lit("_roll5_std"))
    p = V.table(spark, sf, "part").select("p_partkey", F.concat(
        F.element_at(bases, (F.col("p_partkey") % 6 + 1).cast("int")), F.element_at(suffix, F.col("p_size") % 4 + 1)).alias("name"))
    return p.select("p_partkey", "name", C.base_column(F.col("name")).alias("base"), C.kind_column(F.col("name")).alias("class"))


@query(with_views("select subject_id, epoch_idx, x as hr_mean, lag(x) over (partition by subject_id order by epoch_idx) as hr_mean_lag1 from v_epochs", "v_epochs"))
def causal_column_selection(spark, sf) -> DataFrame:
    from nightjar.operators.epochs import contextual

    d = contextual(V.epochs(spark, sf).select("subject_id", "epoch_idx", F.col("x").alias("hr_mean")), ["hr_mean"])
    return d.select("subject_id", "epoch_idx", *C.select_features(d.columns, C.causal))


@query(with_views("select subject_id, epoch_idx, x as hr_mean, x / 2 as resp_thor_rms from v_epochs", "v_epochs"))
def physiological_subset(spark, sf) -> DataFrame:
    d = V.epochs(spark, sf).select("subject_id", "epoch_idx", (F.col("x") * 3).alias("spo2_min"), F.col("x").alias("hr_mean"), (F.col("x") / 2).alias("resp_thor_rms"))
    return d.select("subject_id", "epoch_idx", *C.select_features(d.columns, C.of_kind("physio", "unknown")))


@query(with_views("""
    select 'a' as run, count(*) as n, round(sum(pred_prob), 4) as total, null::double as extra from v_pred_a union all
    select 'b', count(*), round(sum(pred_prob), 4), round(sum(pred_prob * 2), 4) from v_pred_b""", "v_pred_a", "v_pred_b"))
def stacked_runs(spark, sf) -> DataFrame:
    a = V.predictions(spark, sf, "a").withColumn("run", F.lit("a"))
    b = V.predictions(spark, sf, "b").withColumn("run", F.lit("b")).withColumn("extra", F.col("pred_prob") * 2)
    return union_all([a, b]).groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("pred_prob"), 4).alias("total"), F.round(F.sum("extra"), 4).alias("extra"))


@query(with_views("""
    select key, n from (select l_orderkey || '-' || l_linenumber as key, count(*) as n from lineitem group by 1) where n > 1"""))
def duplicate_keys(spark, sf) -> DataFrame:
    return V.table(spark, sf, "lineitem").groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")).agg(
        F.count("*").alias("n")).where("n > 1")


@query(with_views("""
    select a.subject_id, a.epoch_idx, round((a.pred_prob + b.pred_prob) / 2, 6) as p_mean,
           round((exp((0.79 - 0.785) * 50) * a.pred_prob + exp((0.78 - 0.785) * 50) * b.pred_prob) / (exp((0.79 - 0.785) * 50) + exp((0.78 - 0.785) * 50)), 6) as p_weighted,
           round((a.ra + b.ra) / 2 / n, 6) as p_rank_mean
    from (select *, rank() over (order by pred_prob) + (count(*) over (partition by pred_prob) - 1) / 2.0 as ra, count(*) over () as n from v_pred_a) a
    join (select *, rank() over (order by pred_prob) + (count(*) over (partition by pred_prob) - 1) / 2.0 as ra from v_pred_b) b using (subject_id, epoch_idx)""",
                  "v_pred_a", "v_pred_b"))
def run_ensemble(spark, sf) -> DataFrame:
    from nightjar.operators.fitting import ensemble

    return rounded(ensemble(both_runs(spark, sf), {"a": 0.79, "b": 0.78}).select("subject_id", "epoch_idx", "p_mean", "p_weighted", "p_rank_mean"))


@query(with_views("""
    select subject_id, epoch_idx, case when r is null and l is null and s is null then 'unknown'
        when coalesce(r, -1) >= coalesce(l, -1) and coalesce(r, -1) >= coalesce(s, -1) then 'lateral' when coalesce(l, -1) >= coalesce(s, -1) then 'lateral' else 'supine' end as posture
    from (select subject_id, epoch_idx, case when event_id % 3 <> 0 then (event_id % 7) / 10.0 end as r, case when event_id % 5 <> 0 then (event_id % 4) / 10.0 end as l,
                 case when event_id % 3 <> 0 then (event_id % 11) / 10.0 end as s from v_epochs)""", "v_epochs"))
def dominant_posture(spark, sf) -> DataFrame:
    i = F.col("event_id")
    fr = {"right": F.when(i % 3 != 0, (i % 7) / 10.0), "left": F.when(i % 5 != 0, (i % 4) / 10.0), "supine": F.when(i % 3 != 0, (i % 11) / 10.0)}
    return V.epochs(spark, sf).select("subject_id", "epoch_idx", X.posture(fr).alias("posture"))


@query("""
    select detail, count(*) as n, round(avg(value), 6) as mean_value from (select 'k=' || (props::json->>'k') as detail, value from events) group by 1""")
def json_field_lookup(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return rounded(e.groupBy(F.concat(F.lit("k="), F.col("k")).alias("detail")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))
