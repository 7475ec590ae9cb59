"""Queries over the one-second saturation trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.epochs import SLEEP, r
from nightjar.operators import oxygen as O
from nightjar.operators import signals as S
from nightjar.plans import views as V
from nightjar.plans.views import with_views

BASE = """
    select subject_id, sec, value, case when value is not null then max(value) over (
               partition by subject_id, gap order by sec rows between 99 preceding and current row) end as baseline
    from (select *, sum(case when value is null then 1 else 0 end) over (partition by subject_id order by sec) as gap from v_signal)"""


def _runs(threshold: float, min_len: int) -> str:
    return f"""
    select subject_id, cast(min(sec) as integer) as start_sec, count(*) as duration_sec, min(value) as nadir, arg_min(baseline, sec) as baseline
    from (select *, sec - row_number() over (partition by subject_id order by sec) as isl from base where baseline - value >= {threshold})
    group by subject_id, isl having count(*) >= {min_len}"""


@query(with_views("select subject_id, sec, value, baseline from base", "v_signal", base=BASE))
def trailing_baseline(spark, sf) -> DataFrame:
    return O.trailing_max(V.signal(spark, sf))


@query(with_views("select subject_id, start_sec, duration_sec, nadir, baseline from runs", "v_signal", base=BASE, runs=_runs(3.0, 3)))
def desaturation_events(spark, sf) -> DataFrame:
    return O.desaturations(V.signal(spark, sf), 3.0, min_duration=3)


@query(with_views(f"""
    select e.subject_id, e.epoch_idx, case when {SLEEP} then coalesce(n3, 0) else 0 end as odi3_count,
           case when {SLEEP} then coalesce(n4, 0) else 0 end as odi4_count,
           case when {SLEEP} then round(depth, 6) end as desat_depth
    from v_epochs e
    left join (select subject_id, start_sec // 30 as epoch_idx, count(*) as n3 from r3 group by 1, 2) a using (subject_id, epoch_idx)
    left join (select subject_id, start_sec // 30 as epoch_idx, count(*) as n4, max(baseline - nadir) as depth from r4 group by 1, 2) b using (subject_id, epoch_idx)
    """, "v_signal", base=BASE, r3=_runs(3.0, 3), r4=_runs(4.0, 3)))
def desaturation_counts(spark, sf) -> DataFrame:
    d = O.desaturation_counts(V.epochs(spark, sf).select("subject_id", "epoch_idx", "sleep_stage"), V.signal(spark, sf), min_duration=3)
    return d.drop("sleep_stage").withColumn("desat_depth", r("desat_depth"))


@query(with_views("""
    select subject_id, cast(sec // 30 as integer) as epoch_idx, round(avg(value), 6) as spo2_mean, min(value) as spo2_min, max(value) as spo2_max,
           round(stddev_pop(value), 6) as spo2_std from v_signal group by 1, 2""", "v_signal"))
def saturation_stats(spark, sf) -> DataFrame:
    d = O.epoch_stats(V.signal(spark, sf))
    return d.withColumns({"spo2_mean": r("spo2_mean"), "spo2_std": r("spo2_std")})


@query(with_views("""
    select subject_id, sec, case when v >= 50 then round(v, 6) end as value from (
        select subject_id, sec, case when max(abs(f)) over (partition by subject_id) <= 2 then f * 100 else f end as v
        from (select subject_id, sec, case when subject_id % 2 = 0 then value / 100 else value - 40 end as f from v_signal))""", "v_signal"))
def saturation_cleaning(spark, sf) -> DataFrame:
    v = F.when(F.col("subject_id") % 2 == 0, F.col("value") / 100).otherwise(F.col("value") - 40)
    return O.clean(V.signal(spark, sf).withColumn("value", v)).withColumn("value", r("value"))


@query(with_views("""
    select subject_id, cast(sec // 3 as integer) as sec, value from v_signal where sec % 3 = 0""", "v_signal"))
def one_hertz_samples(spark, sf) -> DataFrame:
    s = V.signal(spark, sf).withColumnRenamed("sec", "idx")
    return O.every_nth_sample(s, 3.0).select("subject_id", "sec", "value")


BAD = """
    select subject_id, cast(min(sec) as integer) as start, count(*) as length, count(*) > 1 as is_long from (
        select subject_id, sec, sec - row_number() over (partition by subject_id order by sec) as isl
        from v_signal where value is null or value < 50 or value > 99.9) group by subject_id, isl"""


@query(with_views("select * from bad", "v_signal", bad=BAD))
def invalid_sample_runs(spark, sf) -> DataFrame:
    return O.bad_runs(V.signal(spark, sf), max_gap=1, top=99.9)


@query(with_views("""
    select subject_id, cast(sec * 4 + q as bigint) as tick, round(coalesce(z + q / 4.0::double * (lead_z - z), z), 6) as spo2_4hz
    from (select *, lead(z) over (partition by subject_id order by sec) as lead_z from filled), generate_series(0, 3) t(q)""",
                  "v_signal", bad=BAD, filled="""
    select s.subject_id, s.sec, case when good then (value - 95) / 5 when is_long then 0 else
               (coalesce(vl + (s.sec - start + 1) / (length + 1)::double * (vr - vl), vl, vr) - 95) / 5 end as z
    from (select *, coalesce(value between 50 and 99.9, false) as good,
                 last_value(case when value between 50 and 99.9 then value end ignore nulls) over (partition by subject_id order by sec) as vl,
                 first_value(case when value between 50 and 99.9 then value end ignore nulls) over (
                     partition by subject_id order by sec rows between current row and unbounded following) as vr from v_signal) s
    left join bad b on b.subject_id = s.subject_id and s.sec >= b.start and s.sec < b.start + b.length"""))
def saturation_channel(spark, sf) -> DataFrame:
    d = O.channel_4hz(V.signal(spark, sf), max_gap=1, top=99.9)
    return d.select("subject_id", F.col("tick").cast("bigint").alias("tick"), r("spo2_4hz").alias("spo2_4hz"))


def _oxygen_events(spark, sf) -> DataFrame:
    """Scored events placed on the signal's own second axis (one second per position)."""
    return V.scored_events(spark, sf).withColumn("start_sec", F.col("start_sec") / 30)


OX_EVENTS = """
    select *, start_sec / 30 + duration_sec as end_sec, round_even(start_sec / 30 + duration_sec, 0)::int as end_idx from v_scored_events"""
NSEC = "select subject_id, max(sec) + 1 as n_sec from v_signal group by 1"

SEARCH = """
    select e.subject_id, coalesce(lo_sec, 3) as lo_sec, coalesce(hi_sec, 9) as hi_sec from (select distinct subject_id from ev) e left join (
        select subject_id, -l.o as lo_sec, rr.o as hi_sec from (
            select m.subject_id, max(n) as n, sum(case when o < 0 and support >= need then 1 else 0 end) / 20.0 as pre_ok,
                   sum(case when o >= 0 and support >= need then 1 else 0 end) / 30.0 as post_ok,
                   arg_max({'o': o, 's': support}, {'m': m, 'o': -o}) filter (o < 0) as l, arg_max({'o': o, 's': support}, {'m': m, 'o': -o}) filter (o >= 0) as rr,
                   max(need) as need
            from (select subject_id, o, avg(value) as m, count(*) as support from aligned group by 1, 2) m
            join (select subject_id, count(distinct event_seq) as n, greatest(2, ceil(count(distinct event_seq) * 0.5)) as need from aligned group by 1) using (subject_id)
            group by 1)
        where n >= 5 and pre_ok >= 0.5 and post_ok >= 0.5 and l.s >= need and rr.s >= need and -l.o between 5 and 90 and rr.o between 5 and 120
    ) f using (subject_id)"""

ALIGNED = """
    select a.subject_id, a.event_seq, a.o, s.value from (
        select ev.subject_id, event_seq, end_idx, unnest(generate_series(-20, 29))::int as o from ev join nsec using (subject_id)
        where end_idx >= 20 and end_idx + 30 <= n_sec) a
    join v_signal s on s.subject_id = a.subject_id and s.sec = a.end_idx + a.o where s.value is not null"""


@query(with_views("select subject_id, cast(lo_sec as integer) as lo_sec, cast(hi_sec as integer) as hi_sec from search",
                  "v_scored_events", "v_signal", ev=OX_EVENTS, nsec=NSEC, aligned=ALIGNED, search=SEARCH))
def burden_search_window(spark, sf) -> DataFrame:
    return O.search_windows(_oxygen_events(spark, sf), V.signal(spark, sf), pre=20, post=30, default=(3, 9))


@query(with_views("""
    select e.subject_id, e.event_seq, cast(floor(end_sec / 30) as integer) as epoch_idx, baseline, round(coalesce(burden, 0), 6) as burden
    from ev e join nsec using (subject_id)
    join (select a.subject_id, event_seq, max(value) as baseline from (
              select subject_id, event_seq, unnest(generate_series(end_idx - 100, end_idx - 1)) as sec from ev) a join v_signal using (subject_id, sec) group by 1, 2) b
      on b.subject_id = e.subject_id and b.event_seq = e.event_seq and baseline is not null
    left join (select a.subject_id, a.event_seq, sum(greatest(0, b2.baseline - value)) as burden from (
              select subject_id, event_seq, unnest(generate_series(end_idx - lo_sec, end_idx + hi_sec - 1)) as sec from ev join search using (subject_id)) a
          join v_signal using (subject_id, sec)
          join (select a.subject_id, event_seq, max(value) as baseline from (
              select subject_id, event_seq, unnest(generate_series(end_idx - 100, end_idx - 1)) as sec from ev) a join v_signal using (subject_id, sec) group by 1, 2) b2
            on b2.subject_id = a.subject_id and b2.event_seq = a.event_seq group by 1, 2) c
      on c.subject_id = e.subject_id and c.event_seq = e.event_seq
    where end_idx > 0 and end_idx <= n_sec""",
                  "v_scored_events", "v_signal", ev=OX_EVENTS, nsec=NSEC, aligned=ALIGNED, search=SEARCH))
def hypoxic_burden(spark, sf) -> DataFrame:
    ev, sig = _oxygen_events(spark, sf), V.signal(spark, sf)
    win = O.search_windows(ev, sig, pre=20, post=30, default=(3, 9))
    return O.hypoxic_burden(ev, sig, win).withColumn("burden", r("burden"))


@query()
def oxygen_spectrum(spark, sf) -> DataFrame:
    sig = V.signal(spark, sf)
    spine = sig.select("subject_id", F.floor(F.col("sec") / 30).cast("int").alias("epoch_idx")).distinct()
    return S.oxygen_spectrum(sig, spine)
