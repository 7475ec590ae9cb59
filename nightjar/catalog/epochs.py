"""Epoch-table queries: stages, interval labels, summaries, positional context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.functions import expressions as X
from nightjar.operators import epochs as E
from nightjar.plans import views as V
from nightjar.plans.views import with_views


def r(c, digits: int = 6):
    return F.round(c, digits)


SLEEP = "sleep_stage in ('N1','N2','N3','REM')"


@query(with_views(f"""
    select e.subject_id, count(*) as n_epochs, count(*) * 0.5::double as tib_min,
           count(*) filter ({SLEEP}) * 0.5::double as tst_min,
           round((count(*) filter ({SLEEP}))::double / count(*), 6) as sleep_efficiency,
           count(*) filter (sleep_stage = 'W' and epoch_idx >= onset) * 0.5::double as waso_min,
           count(*) filter ({SLEEP} and apnoea_label = 1) as n_apnoea_epochs,
           round(count(*) filter ({SLEEP} and apnoea_label = 1) * 120.0::double / nullif(count(*) filter ({SLEEP}), 0), 6) as ahi_proxy_per_hr,
           round(sum(x) * 2.0 / nullif(count(*) filter ({SLEEP}), 0), 4) as hypoxic_burden_per_night
    from v_epochs e left join (select subject_id, min(epoch_idx) as onset from v_epochs where {SLEEP} group by 1) o using (subject_id)
    group by 1""", "v_epochs"))
def night_summary(spark, sf) -> DataFrame:
    d = E.night_summary(V.epochs(spark, sf), burden="x")
    return d.select("subject_id", "n_epochs", "tib_min", "tst_min", r("sleep_efficiency").alias("sleep_efficiency"), "waso_min",
                    "n_apnoea_epochs", r("ahi_proxy_per_hr").alias("ahi_proxy_per_hr"),
                    r("hypoxic_burden_per_night", 4).alias("hypoxic_burden_per_night"))


@query(with_views(f"""
    select subject_id, epoch_idx, sleep_stage, apnoea_label,
           case sleep_stage when 'W' then 0 when 'N1' then 1 when 'N2' then 2 when 'N3' then 3 when 'REM' then 5 else 9 end as stage_code
    from v_epochs where {SLEEP}""", "v_epochs"))
def sleep_epochs(spark, sf) -> DataFrame:
    return V.epochs(spark, sf).where(X.is_sleep("sleep_stage")).select(
        "subject_id", "epoch_idx", "sleep_stage", "apnoea_label", X.encode_stage("sleep_stage").alias("stage_code"))


@query(with_views(f"""
    select subject_id, cast(epoch_idx * 30 + s as integer) as sec, cast({SLEEP} as integer) as asleep
    from v_epochs, generate_series(0, 29) g(s)""", "v_epochs"))
def sleep_second_mask(spark, sf) -> DataFrame:
    per = F.posexplode(F.array_repeat(X.is_sleep("sleep_stage").cast("int"), 30)).alias("s", "asleep")
    return V.epochs(spark, sf).select("subject_id", "epoch_idx", per).select(
        "subject_id", (F.col("epoch_idx") * 30 + F.col("s")).alias("sec"), "asleep")


STAGE_RUNS = """
    select subject_id, epoch_idx * 30.0::double as start_sec, x * 1.0 as duration_sec, sleep_stage as stage, event_id as run_seq
    from v_epochs where sleep_stage <> '?'"""


def _stage_runs(spark, sf) -> DataFrame:
    return V.epochs(spark, sf).where("sleep_stage <> '?'").select(
        "subject_id", (F.col("epoch_idx") * 30.0).alias("start_sec"), F.col("x").alias("duration_sec"),
        F.col("sleep_stage").alias("stage"), F.col("event_id").alias("run_seq"))


EXPANDED = """
    select subject_id, epoch_idx, arg_max(stage, run_seq) as sleep_stage from (
        select subject_id, stage, run_seq,
               unnest(generate_series(floor(start_sec / 30)::int, floor(start_sec / 30)::int + greatest(1, round_even(duration_sec / 30, 0)::int) - 1))::int as epoch_idx
        from runs) group by 1, 2"""


@query(with_views("select subject_id, epoch_idx, sleep_stage from expanded", "v_epochs", runs=STAGE_RUNS, expanded=EXPANDED))
def stage_run_expansion(spark, sf) -> DataFrame:
    return E.expand_stage_runs(_stage_runs(spark, sf))


@query(with_views("""
    select s.subject_id, s.epoch_idx, coalesce(e.sleep_stage, '?') as sleep_stage
    from (select subject_id, unnest(generate_series(0, n_epochs - 1))::int as epoch_idx from v_nights) s
    left join expanded e using (subject_id, epoch_idx)""", "v_epochs", "v_nights", runs=STAGE_RUNS, expanded=EXPANDED))
def hypnogram_alignment(spark, sf) -> DataFrame:
    stages = E.expand_stage_runs(_stage_runs(spark, sf))
    return E.align_to_spine(V.nights(spark, sf), stages, {"sleep_stage": "?"})


TOUCHED = """
    select *, greatest(0, least(start_sec + duration_sec, (epoch_idx + 1) * 30.0::double) - greatest(start_sec, epoch_idx * 30.0::double)) as overlap_sec
    from (select *, unnest(generate_series(greatest(0, floor(start_sec / 30)::int), floor((start_sec + duration_sec) / 30)::int))::int as epoch_idx
          from v_scored_events)"""


@query(with_views("""
    select e.subject_id, e.epoch_idx, coalesce(h.hit, 0) as apnoea_label
    from v_epochs e left join (select distinct subject_id, epoch_idx, 1 as hit from touched where overlap_sec >= 10) h using (subject_id, epoch_idx)
    """, "v_epochs", "v_scored_events", touched=TOUCHED))
def interval_labels(spark, sf) -> DataFrame:
    return E.label_epochs(V.epochs(spark, sf).select("subject_id", "epoch_idx"), V.scored_events(spark, sf))


@query(with_views("""
    select e.subject_id, e.epoch_idx, round(b.ev.d, 6) as event_duration_s, coalesce(b.ev.k, '') as event_kind,
           cast(b.ev is not null as integer) as xml_label
    from v_epochs e left join (
        select subject_id, epoch_idx,
               arg_max({'d': duration_sec, 'k': case when lower(kind) like 'hypopn%' then 'hypopnoea' else 'apnoea' end},
                       {'a': duration_sec, 'b': -event_seq}) as ev
        from touched where overlap_sec >= 10 group by 1, 2) b using (subject_id, epoch_idx)""",
                  "v_epochs", "v_scored_events", touched=TOUCHED))
def event_context(spark, sf) -> DataFrame:
    d = E.event_context(V.epochs(spark, sf).select("subject_id", "epoch_idx"), V.scored_events(spark, sf))
    return d.withColumn("event_duration_s", r("event_duration_s"))


@query(with_views(f"""
    select v.subject_id, count(s.subject_id) as n_sleep_events, count(*) as n_events_total
    from v_scored_events v left join (select subject_id, epoch_idx from v_epochs where {SLEEP}) s
      on s.subject_id = v.subject_id and s.epoch_idx = floor((v.start_sec + v.duration_sec / 2) / 30)
    group by 1""", "v_epochs", "v_scored_events"))
def sleep_event_counts(spark, sf) -> DataFrame:
    return E.sleep_event_counts(V.epochs(spark, sf), V.scored_events(spark, sf))


@query(with_views("""
    select subject_id, sec, bit_or(bit) as mask from (
        select v.subject_id, case kind when 'Obstructive apnea' then 1 when 'Central apnea' then 2 when 'Mixed apnea' then 4 else 8 end as bit,
               unnest(generate_series(greatest(0, ceil(start_sec - 0.5)::bigint), least(n_epochs * 30, ceil(start_sec + duration_sec - 0.5)::bigint) - 1)) as sec
        from v_scored_events v join v_nights using (subject_id))
    group by 1, 2""", "v_scored_events", "v_nights"))
def event_second_mask(spark, sf) -> DataFrame:
    return E.event_seconds(V.scored_events(spark, sf), V.nights(spark, sf))


_CTX = ", ".join(
    [f"lag({c}) over w as {c}_lag1, lead({c}) over w as {c}_lead1" for c in ("x", "apnoea_label")]
    + [f"round(avg({c}) over (w rows between {k} preceding and {k} following), 6) as {c}_roll{2 * k + 1}_mean, "
       f"round(stddev_samp({c}) over (w rows between {k} preceding and {k} following), 6) as {c}_roll{2 * k + 1}_std"
       for k in (2, 5) for c in ("x", "apnoea_label")])


@query(with_views(f"select subject_id, epoch_idx, {_CTX} from v_epochs window w as (partition by subject_id order by epoch_idx)", "v_epochs"))
def contextual_features(spark, sf) -> DataFrame:
    d = E.contextual(V.epochs(spark, sf).select("subject_id", "epoch_idx", "x", "apnoea_label"), ["x", "apnoea_label"])
    return d.select("subject_id", "epoch_idx", *[
        r(c).alias(c) if "_roll" in c else F.col(c) for c in d.columns if "_lag" in c or "_lead" in c or "_roll" in c])


@query(with_views(f"""
    select subject_id, epoch_idx, m5 as x_past_roll5_mean, s5 as x_past_roll5_std, m11 as x_past_roll11_mean, s11 as x_past_roll11_std from (
        select subject_id, epoch_idx, sleep_stage,
               round(avg(x) over (w rows between 4 preceding and current row), 6) as m5, round(stddev_samp(x) over (w rows between 4 preceding and current row), 6) as s5,
               round(avg(x) over (w rows between 10 preceding and current row), 6) as m11, round(stddev_samp(x) over (w rows between 10 preceding and current row), 6) as s11
        from v_epochs window w as (partition by subject_id order by epoch_idx)) where {SLEEP}""", "v_epochs"))
def past_only_context(spark, sf) -> DataFrame:
    d = E.past_context(V.epochs(spark, sf).select("subject_id", "epoch_idx", "sleep_stage", "x"), ["x"])
    d = d.where(X.is_sleep("sleep_stage"))
    return d.select("subject_id", "epoch_idx", *[r(c).alias(c) for c in d.columns if "_past_" in c])


@query(with_views(f"""
    select subject_id, min(epoch_idx) as first_sleep_idx from v_epochs where {SLEEP} group by 1""", "v_epochs"))
def first_sleep_epoch(spark, sf) -> DataFrame:
    return E.first_sleep(V.epochs(spark, sf))


@query(with_views("""
    select subject_id, count(*) as n_runs from (
        select subject_id, epoch_idx - lag(epoch_idx) over (partition by subject_id order by epoch_idx) as gap from v_epochs where apnoea_label = 1)
    where gap is null or gap > 1 group by 1""", "v_epochs"))
def flagged_run_counts(spark, sf) -> DataFrame:
    return E.count_runs(V.epochs(spark, sf), F.col("apnoea_label") == 1, ["subject_id"])


@query(with_views("""
    select subject_id, min(epoch_idx) as start, count(*) as length from (
        select subject_id, epoch_idx, epoch_idx - row_number() over (partition by subject_id order by epoch_idx) as g from v_epochs where apnoea_label = 1)
    group by subject_id, g""", "v_epochs"))
def label_islands(spark, sf) -> DataFrame:
    return E.label_islands(V.epochs(spark, sf), F.col("apnoea_label") == 1)


_TRIM = f"""
    select e.subject_id, epoch_idx, sleep_stage from v_epochs e
    join (select subject_id, min(epoch_idx) as lo, max(epoch_idx) as hi from v_epochs where {SLEEP} group by 1) s using (subject_id)
    where sleep_stage <> '?'"""


@query(with_views(_TRIM + " and epoch_idx between lo - 1 and hi + 1", "v_epochs"))
def in_bed_window(spark, sf) -> DataFrame:
    return E.trim_window(V.epochs(spark, sf), margin=1).select("subject_id", "epoch_idx", "sleep_stage")


@query(with_views(_TRIM, "v_epochs"))
def whole_night_window(spark, sf) -> DataFrame:
    return E.trim_window(V.epochs(spark, sf), whole_night=True).select("subject_id", "epoch_idx", "sleep_stage")


@query(with_views(f"""
    select subject_id, event_seq, cast(count(s.sec) as bigint) as sleep_sec from (
        select subject_id, event_seq, greatest(0, floor(start_sec)::int - 60) as t0, floor(start_sec + duration_sec)::int + 60 as t1 from v_scored_events) i
    left join (select subject_id, epoch_idx * 30 + g as sec from v_epochs, generate_series(0, 29) t(g) where {SLEEP}) s using (subject_id)
    where s.sec >= t0 and s.sec < t1 group by 1, 2""", "v_epochs", "v_scored_events"))
def sleep_seconds_in_intervals(spark, sf) -> DataFrame:
    i = V.scored_events(spark, sf).select(
        "subject_id", F.col("event_seq").alias("interval_id"),
        F.greatest(F.lit(0), F.floor("start_sec").cast("int") - 60).alias("t0"),
        (F.floor(F.col("start_sec") + F.col("duration_sec")).cast("int") + 60).alias("t1"))
    return E.sleep_seconds(i, V.epochs(spark, sf)).where("sleep_sec > 0").select(
        "subject_id", F.col("interval_id").alias("event_seq"), F.col("sleep_sec").cast("bigint").alias("sleep_sec"))
