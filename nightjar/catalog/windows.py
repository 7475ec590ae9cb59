"""Queries for five-minute model windows and window scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.epochs import SLEEP
from nightjar.catalog.metrics import rounded
from nightjar.catalog.splits import draw
from nightjar.functions import expressions as X
from nightjar.operators import metrics as M
from nightjar.operators import windows as W
from nightjar.plans import views as V
from nightjar.plans.views import with_views

EVAL = f"select subject_id, cast(epoch_idx // 6 as integer) as j, count(*) as n_sleep from v_epochs where {SLEEP} group by 1, 2"


@query(with_views("select subject_id, j, 0 as phase, j * 180 - 60 as start_sec, n_sleep from ev", "v_epochs", ev=EVAL))
def evaluation_windows(spark, sf) -> DataFrame:
    return W.eval_windows(V.epochs(spark, sf))


TRAIN = f"""
    select w.subject_id, j, phase, (phase + j * 180 - 60)::int as start_sec, count(s.sec) as sleep_sec from (
        select subject_id, phase, unnest(generate_series(0, ceil(n_epochs / 6.0)::int - 1 - (phase > 0)::int))::int as j
        from (select subject_id, n_epochs, cast({draw("'7'", "'0'", "subject_id::varchar")} % 180 as integer) as phase from v_nights)) w
    join (select subject_id, epoch_idx * 30 + g as sec from v_epochs, generate_series(0, 29) t(g) where {SLEEP}) s
      on s.subject_id = w.subject_id and s.sec >= phase + j * 180 and s.sec < phase + j * 180 + 180 group by 1, 2, 3, 4"""


@query(with_views("select subject_id, j, phase, start_sec, sleep_sec from tr", "v_epochs", "v_nights", tr=TRAIN))
def training_windows(spark, sf) -> DataFrame:
    d = W.train_windows(V.epochs(spark, sf), V.nights(spark, sf), 7, 0)
    return d.withColumn("sleep_sec", F.col("sleep_sec").cast("bigint"))


@query(with_views(f"""
    select subject_id, j from (select *, row_number() over (order by {draw("'7'", "'0'", "subject_id || '-' || j")}, subject_id || '-' || j) as r, count(*) over () as n from tr) where r <= floor(n * 0.5)""",
                  "v_epochs", "v_nights", tr=TRAIN))
def subsampled_training_windows(spark, sf) -> DataFrame:
    return W.train_windows(V.epochs(spark, sf), V.nights(spark, sf), 7, 0, keep=0.5).select("subject_id", "j")


def _seconds(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf)
    s = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("s")
    return e.select("subject_id", "epoch_idx", "x", "apnoea_label", X.is_sleep("sleep_stage").cast("int").alias("asleep"), s).select(
        "subject_id", (F.col("epoch_idx") * 30 + F.col("s")).alias("sec"), "x", F.col("apnoea_label").alias("target"), "asleep")


@query(with_views(f"""
    select w.subject_id, w.j, count(*) filter (sec >= 0 and sec < n_epochs * 30) as n_valid, coalesce(sum(apnoea_label), 0)::bigint as target_sec,
           coalesce(sum(({SLEEP})::int), 0)::bigint as loss_sec, round(max(x), 6) as peak
    from (select subject_id, j, unnest(generate_series(j * 180 - 60, j * 180 + 239)) as sec from ev) w join v_nights using (subject_id)
    left join v_epochs e on e.subject_id = w.subject_id and sec >= 0 and e.epoch_idx = sec // 30 group by 1, 2""", "v_epochs", "v_nights", ev=EVAL))
def gathered_windows(spark, sf) -> DataFrame:
    g = W.gather(W.eval_windows(V.epochs(spark, sf)), _seconds(spark, sf), V.nights(spark, sf), ["x"])
    count = lambda c, f: F.size(F.filter(c, f)).cast("bigint")
    return rounded(g.select("subject_id", "j", count("valid", lambda v: v).alias("n_valid"), count("y", lambda v: v == 1).alias("target_sec"),
                            count("mask", lambda v: v).alias("loss_sec"), F.array_max("x").alias("peak")))


def _scores(spark, sf) -> DataFrame:
    """A probability per second of every evaluation window, from the window and second numbers."""
    p = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.pmod(k * 37 + F.col("j") * 11 + F.col("subject_id") * 7, F.lit(101)) / 100.0)
    return W.eval_windows(V.epochs(spark, sf)).select("subject_id", "j", p.alias("p"))


SCORED = f"""
    select e.subject_id, e.epoch_idx, e.apnoea_label, list(((60 + (e.epoch_idx % 6) * 30 + s) * 37 + (e.epoch_idx // 6) * 11 + e.subject_id * 7) % 101 / 100.0::double order by s) as p
    from v_epochs e, generate_series(0, 29) g(s) where {SLEEP} group by 1, 2, 3"""
AGG = """
    select subject_id, epoch_idx, apnoea_label, list_avg(p) as mean, list_max(p) as max, list_reverse_sort(p)[10] as k10,
           list_max(list_transform(generate_series(1, 21), lambda i: list_min(list_slice(p, i, i + 9)))) as c10 from scored"""


@query(with_views("select subject_id, epoch_idx, apnoea_label, round(mean, 6) as mean, max, k10, c10 from agg", "v_epochs", scored=SCORED, agg=AGG))
def scored_epochs(spark, sf) -> DataFrame:
    d = W.score_epochs(_scores(spark, sf), V.epochs(spark, sf), V.nights(spark, sf))
    return d.withColumn("mean", F.round("mean", 6))


@query(with_views("""
    select case when mean_auc >= best_auc - 0.002 then 'mean' else best end as chosen, best, round(best_auc, 6) as best_auc, round(mean_auc, 6) as mean_auc from (
        select arg_max(name, {'a': auc, 'm': name = 'mean'}) as best, max(auc) as best_auc, max(auc) filter (name = 'mean') as mean_auc from (
            select name, (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc
            from (select name, y, rank() over (partition by name order by v) + (count(*) over (partition by name, v) - 1) / 2.0::double as r from (
                select 'mean' as name, apnoea_label as y, round(mean, 9) as v from agg union all select 'max', apnoea_label, max from agg
                union all select 'k10', apnoea_label, k10 from agg union all select 'c10', apnoea_label, c10 from agg)) group by 1))""", "v_epochs", scored=SCORED, agg=AGG))
def aggregator_choice(spark, sf) -> DataFrame:
    d = W.score_epochs(_scores(spark, sf), V.epochs(spark, sf), V.nights(spark, sf)).withColumn("mean", F.round("mean", 9))
    long = d.unpivot(["subject_id", "epoch_idx", "apnoea_label"], list(X.AGGREGATORS), "name", "v")
    return rounded(M.choose_aggregator(M.discrimination(long, ["name"], "apnoea_label", "v")).select("chosen", "best", "best_auc", "mean_auc"))
