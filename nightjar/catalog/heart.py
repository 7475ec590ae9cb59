"""Queries for beats, intervals, variability and the beat-to-grid front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.metrics import rounded
from nightjar.operators import heart as H
from nightjar.operators import signals as S
from nightjar.plans import views as V
from nightjar.plans.views import with_views

RR = "select subject_id, epoch_idx as beat, (case when event_id % 9 = 0 then 250.0 when event_id % 13 = 0 then 2000.0 else 800.0 + x end)::double as rr from v_epochs"
ROBUST = """
    select subject_id, beat, (unnest(generate_series(0, parts - 1)))::int as part, v / parts as rr from (
        select f.subject_id, f.beat, case when merged or rr / med < 1.8 then 1 else greatest(2, round_even(rr / med, 0)::int) end as parts,
               case when merged then rr + nxt else rr end as v, skipped
        from f join chain using (subject_id, beat)) where not skipped"""
F_SQL = """
    select *, rr / med < 0.5 as short, lead(rr) over (partition by subject_id order by beat) as nxt, count(*) over (partition by subject_id) as n
    from (select *, quantile_cont(rr, 0.5) over (partition by subject_id order by beat rows between 2 preceding and 2 following) as med from rrs)"""
CHAIN = """
    select subject_id, beat, short and beat < n - 1 as merged, false as skipped from f where beat = 0 union all
    select f.subject_id, f.beat, not c.merged and f.short and f.beat < n - 1, c.merged from chain c join f on f.subject_id = c.subject_id and f.beat = c.beat + 1"""


def rr_intervals(spark, sf) -> DataFrame:
    i = F.col("event_id")
    rr = F.when(i % 9 == 0, 250.0).when(i % 13 == 0, 2000.0).otherwise(800.0 + F.col("x"))
    return V.epochs(spark, sf).select("subject_id", F.col("epoch_idx").alias("beat"), rr.alias("rr"))


def _recursive(body: str, **more: str) -> str:
    return with_views(body, "v_epochs", rrs=RR, f=F_SQL, chain=CHAIN, robust=ROBUST, **more).replace("with ", "with recursive ", 1)


@query(_recursive("select subject_id, beat, part, round(rr, 6) as rr from robust"))
def robust_intervals(spark, sf) -> DataFrame:
    return rounded(H.robust_rr(rr_intervals(spark, sf)))


VALID = """
    select subject_id, (row_number() over w - 1)::int as pos, rr, 1.5 + sum(rr) over w / 1000 as t,
           rr between 400 and 1500 and coalesce(rr / lag(rr) over w > 0.6 and rr / lag(rr) over w < 1.6, true) as valid
    from robust window w as (partition by subject_id order by beat, part)"""


def _validity(spark, sf) -> DataFrame:
    first = V.nights(spark, sf).select("subject_id", F.lit(1.5).alias("t0"))
    return H.rr_validity(H.robust_rr(rr_intervals(spark, sf)), first)


@query(_recursive("select subject_id, pos, round(rr, 6) as rr, round(t, 6) as t, valid from valid", valid=VALID))
def interval_validity(spark, sf) -> DataFrame:
    return rounded(_validity(spark, sf))


@query(_recursive("""
    select subject_id, epoch_idx, count(*) as n_rr, round(60000 / avg(rr), 6) as hr_mean, round(stddev_samp(rr), 6) as hrv_sdnn,
           round(sqrt(avg(d * d)), 6) as hrv_rmssd, round(avg((abs(d) > 50)::int), 6) as hrv_pnn50
    from (select *, rr - lag(rr) over (partition by subject_id, epoch_idx order by pos) as d from (select *, floor(t / 30)::int as epoch_idx from valid where valid))
    group by 1, 2 having count(*) >= 3""", valid=VALID))
def heart_rate_variability(spark, sf) -> DataFrame:
    return rounded(H.hrv_time(_validity(spark, sf)).drop("rr_list"))


@query(_recursive("""
    select subject_id, epoch_idx, round(case when a > 0 and b > 0 then -ln(a::double / b) end, 6) as hrv_sampen from (
        select x.subject_id, x.epoch_idx,
               coalesce(sum((x.v1 is not null and y.v1 is not null and abs(x.v - y.v) <= x.r and abs(x.v1 - y.v1) <= x.r)::int), 0) as b,
               coalesce(sum((x.v2 is not null and y.v2 is not null and abs(x.v - y.v) <= x.r and abs(x.v1 - y.v1) <= x.r and abs(x.v2 - y.v2) <= x.r)::int), 0) as a
        from tpl x join tpl y on x.subject_id = y.subject_id and x.epoch_idx = y.epoch_idx and x.pos < y.pos group by 1, 2)""", valid=VALID, tpl="""
    select subject_id, epoch_idx, pos, rr as v, lead(rr) over w as v1, lead(rr, 2) over w as v2, 0.2 * stddev_pop(rr) over (partition by subject_id, epoch_idx) as r, count(*) over (partition by subject_id, epoch_idx) as n
    from (select *, floor(t / 30)::int as epoch_idx from valid where valid) window w as (partition by subject_id, epoch_idx order by pos) qualify n >= 4"""))
def interval_entropy(spark, sf) -> DataFrame:
    d = H.hrv_time(_validity(spark, sf)).where("n_rr >= 4")
    return rounded(d.select("subject_id", "epoch_idx", S.sample_entropy("rr_list").alias("hrv_sampen")))


@query(with_views("""
    select subject_id, epoch_idx, n_beats, round(case when abs(m) > 1e-9 then sd / abs(m) end, 6) as cpc_amp_cv, round(case when abs(md) > 1e-9 then (q3 - q1) / abs(md) end, 6) as cpc_amp_iqr
    from (select subject_id, floor(epoch_idx * 2.5 / 30)::int as epoch_idx, count(*) as n_beats, avg(x - 30) as m, stddev_pop(x - 30) as sd,
                 quantile_cont(x - 30, 0.25) as q1, quantile_cont(x - 30, 0.5) as md, quantile_cont(x - 30, 0.75) as q3 from v_epochs group by 1, 2) where n_beats >= 4""", "v_epochs"))
def beat_amplitude_variability(spark, sf) -> DataFrame:
    b = V.epochs(spark, sf).select("subject_id", (F.col("epoch_idx") * 2.5).alias("t"), (F.col("x") - 30).alias("amp"))
    return rounded(H.amplitude_variability(b))


KNOTS = "select subject_id, epoch_idx as beat, (epoch_idx * 0.9 + floor(epoch_idx / 13) * 4)::double as t, x as v from v_epochs"
SEG = "select *, sum(case when t - prev > 3 then 1 else 0 end) over (partition by subject_id order by beat) as segment from (select *, lag(t) over (partition by subject_id order by beat) as prev from knots)"


def beat_train(spark, sf) -> DataFrame:
    e = F.col("epoch_idx")
    return V.epochs(spark, sf).select("subject_id", e.alias("beat"), (e * 0.9 + F.floor(e / 13) * 4).cast("double").alias("t"), F.col("x").alias("v"))


@query(with_views("select subject_id, beat, segment::bigint as segment from seg", "v_epochs", knots=KNOTS, seg=SEG))
def beat_segments(spark, sf) -> DataFrame:
    return H.beat_segments(beat_train(spark, sf)).select("subject_id", "beat", "segment")


@query(with_views("""
    select subject_id, beat, case when n >= 5 and med > 0 and (v > 2 * med or v < 0.5 * med) then med else v end as v_corrected
    from (select *, count(*) over (partition by subject_id) as n, list_sort([coalesce(lag(v, 2) over w, first_value(v) over w), coalesce(lag(v) over w, first_value(v) over w), v,
                    coalesce(lead(v) over w, l), coalesce(lead(v, 2) over w, l)])[3] as med
          from (select *, last_value(v) over (partition by subject_id order by beat rows between unbounded preceding and unbounded following) as l from knots)
          window w as (partition by subject_id order by beat))""", "v_epochs", knots=KNOTS))
def median_corrected_values(spark, sf) -> DataFrame:
    return H.median5_correct(beat_train(spark, sf), "v").select("subject_id", "beat", "v_corrected")


@query(with_views("""
    select subject_id, tick, round(case when tn is null then v else v + (tick / 4.0::double - t) / (tn - t) * (vn - v) end, 6) as value, not (coalesce(sn = segment, false) or tick / 4.0::double = t) as gap
    from (select *, unnest(generate_series(ceil(t * 4)::bigint, case when tn is null then floor(t * 4)::bigint else ceil(tn * 4)::bigint - 1 end)) as tick
          from (select *, lead(t) over w as tn, lead(v) over w as vn, lead(segment) over w as sn from seg window w as (partition by subject_id order by beat)))""",
                  "v_epochs", knots=KNOTS, seg=SEG))
def linear_resampled_runs(spark, sf) -> DataFrame:
    return rounded(H.interpolate_runs(H.beat_segments(beat_train(spark, sf)), 4, "linear"))


GRID4 = """
    select subject_id, tick, not (coalesce(sn = segment, false) or tick / 4.0::double = t) as gap
    from (select *, unnest(generate_series(ceil(t * 4)::bigint, case when tn is null then floor(t * 4)::bigint else ceil(tn * 4)::bigint - 1 end)) as tick
          from (select *, lead(t) over w as tn, lead(segment) over w as sn from seg window w as (partition by subject_id order by beat)))"""


@query(with_views("""
    select k.subject_id, n_peaks, n_gaps, rr_clip_frac, rr_gap_frac, hr_median_bpm, ok from (select subject_id, count(*) as n_peaks from knots group by 1) k
    join (select subject_id, sum((rr > 3)::int)::bigint as n_gaps, round(avg((rr < 0.3 or rr > 2)::int) filter (rr <= 3), 6) as rr_clip_frac,
                 round(60 / quantile_cont(greatest(0.3, least(2.0, rr)), 0.5) filter (rr <= 3), 6) as hr_median_bpm, count(*) filter (rr <= 3) >= 10 as ok
          from (select subject_id, t - prev as rr from seg where prev is not null) group by 1) using (subject_id)
    join (select subject_id, round(avg(gap::int), 6) as rr_gap_frac from grid4 group by 1) using (subject_id)""", "v_epochs", knots=KNOTS, seg=SEG, grid4=GRID4))
def front_end_quality(spark, sf) -> DataFrame:
    from nightjar.plans.extraction import front_end_quality as quality

    b = H.beat_segments(beat_train(spark, sf))
    return rounded(quality(b, H.interpolate_runs(b, 4, "linear")))


def _end(h0: str, h1: str, d0: str, d1: str) -> str:
    g = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
    return f"case when sign({g}) <> sign({d0}) then 0 when sign({d0}) <> sign({d1}) and abs({g}) > 3 * abs({d0}) then 3 * {d0} else {g} end"


CUBIC_GRID = """
    select subject_id, tick, round(case when tn is null then v when smooth then (1 + 2 * u) * (1 - u) * (1 - u) * v + u * (1 - u) * (1 - u) * h * slope + u * u * (3 - 2 * u) * vn + u * u * (u - 1) * h * slope_next
                                        else v + u * (vn - v) end, 6) as value, not (smooth_seg or tick / 4.0::double = t) as gap
    from (select *, (tick / 4.0::double - t) / (tn - t) as u, tn - t as h, coalesce(sn = segment, false) as smooth_seg, coalesce(sn = segment, false) and m >= 4 as smooth
          from (select *, unnest(generate_series(ceil(t * 4)::bigint, case when tn is null then floor(t * 4)::bigint else ceil(tn * 4)::bigint - 1 end)) as tick
                from (select *, lead(t) over w as tn, lead(v) over w as vn, lead(segment) over w as sn, lead(slope) over w as slope_next from slopes window w as (partition by subject_id order by beat))))"""
NEAR = """
    select subject_id, beat, t, v, segment, count(*) over (partition by subject_id, segment) as m, t - lag(t) over w as hl, lead(t) over w - t as hr, (v - lag(v) over w) / (t - lag(t) over w) as dl, (lead(v) over w - v) / (lead(t) over w - t) as dr,
           lead(t, 2) over w - lead(t) over w as hr2, (lead(v, 2) over w - lead(v) over w) / (lead(t, 2) over w - lead(t) over w) as dr2, lag(t) over w - lag(t, 2) over w as hl2, (lag(v) over w - lag(v, 2) over w) / (lag(t) over w - lag(t, 2) over w) as dl2
    from seg window w as (partition by subject_id, segment order by beat)"""


@query(with_views(CUBIC_GRID,
                  "v_epochs", knots=KNOTS, seg=SEG, near=NEAR, slopes=f"""
    select *, case when hl is not null and hr is not null then case when dl * dr > 0 then (3 * hr + 3 * hl) / ((2 * hr + hl) / dl + (hr + 2 * hl) / dr) else 0 end
                   when hr is not null then {_end('hr', 'hr2', 'dr', 'dr2')} when hl is not null then {_end('hl', 'hl2', 'dl', 'dl2')} end as slope from near"""))
def smooth_resampled_runs(spark, sf) -> DataFrame:
    return rounded(H.interpolate_runs(H.beat_segments(beat_train(spark, sf)), 4, "pchip"))


# the spline's slopes by one sweep down and one up each run, all runs side by side
@query(with_views(CUBIC_GRID, "v_epochs", knots=KNOTS, seg=SEG, near=NEAR, system="""
    select *, row_number() over (partition by subject_id, segment order by beat) as i,
           case when hl is null then 0 when hr is null then hl + hl2 else hr end as a, case when hl is null then hr2 when hr is null then hl2 else 2 * (hl + hr) end as b,
           case when hl is null then hr + hr2 when hr is null then 0 else hl end as c,
           case when hl is null then ((3 * hr + 2 * hr2) * hr2 * dr + hr * hr * dr2) / (hr + hr2) when hr is null then (hl * hl * dl2 + (3 * hl + 2 * hl2) * hl2 * dl) / (hl + hl2)
                else 3 * (hr * dl + hl * dr) end as y from near where m >= 4""", down="""
    select subject_id, segment, i, m, c / b as up, y / b as known from system where i = 1
    union all select s.subject_id, s.segment, s.i, s.m, s.c / (s.b - s.a * d.up), (s.y - s.a * d.known) / (s.b - s.a * d.up)
    from down d join system s on s.subject_id = d.subject_id and s.segment = d.segment and s.i = d.i + 1""", climb="""
    select subject_id, segment, i, known as slope from down where i = m
    union all select d.subject_id, d.segment, d.i, d.known - d.up * c.slope from climb c join down d on d.subject_id = c.subject_id and d.segment = c.segment and d.i = c.i - 1""", slopes="""
    select n.*, slope from near n left join system s using (subject_id, beat) left join climb c on c.subject_id = s.subject_id and c.segment = s.segment and c.i = s.i""").replace("with ", "with recursive ", 1))
def spline_resampled_runs(spark, sf) -> DataFrame:
    return rounded(H.interpolate_runs(H.beat_segments(beat_train(spark, sf)), 4, "cubic"))


@query(with_views("""
    select subject_id, beat, round(0.5 * abs(sum(x0 * y1 - x1 * y0)), 6) as edr from (
        select subject_id, beat, k, x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1
        from (select b.subject_id, b.beat, o + 4 as k, s.x, s2.x as y, count(*) over (partition by b.subject_id, b.beat) as n
              from (select subject_id, epoch_idx as beat, epoch_idx * 7 as p, unnest(generate_series(-4, 3)) as o from v_epochs) b
              join whole s on s.subject_id = b.subject_id and s.epoch_idx = b.p + o join whole s2 on s2.subject_id = b.subject_id and s2.epoch_idx = b.p + o + 1) where n = 8
        window w as (partition by subject_id, beat order by k)) group by 1, 2""", "v_epochs",
                  whole="select subject_id, epoch_idx, x from (select *, count(*) over (partition by subject_id, epoch_idx // 30) as n from v_epochs) where n = 30"))
def beat_window_area(spark, sf) -> DataFrame:
    s = V.epochs(spark, sf).select("subject_id", F.col("epoch_idx").alias("idx"), F.col("x").alias("value"))
    beats = V.epochs(spark, sf).select("subject_id", F.col("epoch_idx").alias("beat"), (F.col("epoch_idx") * 7.0).alias("t"))
    return rounded(H.edr_area(S.epoch_view(s, 1.0), beats, 1.0, half_s=4.0, tau_s=1.0).select("subject_id", "beat", "edr"))


@query(with_views("""
    select subject_id, n as hr_check_n, case when n >= 60 then round(med, 6) end as hr_check_median_abs_bpm, case when n >= 60 then round(w, 6) end as hr_check_frac_within_5bpm, case when n >= 60 then round(c, 6) end as hr_check_r
    from (select subject_id, count(*) as n, quantile_cont(abs(hr - pulse), 0.5) as med, avg((abs(hr - pulse) <= 5)::int) as w, corr(hr, pulse) as c
          from (select subject_id, 60 / (0.5 + x / 400) as hr, 40 + event_id % 100 as pulse from v_epochs) group by 1)""", "v_epochs"))
def pulse_agreement(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf)
    rr = e.select("subject_id", (F.col("epoch_idx") * 4).alias("tick"), (0.5 + F.col("x") / 400).alias("rr_s"))
    return rounded(H.rate_agreement(rr, e.select("subject_id", F.col("epoch_idx").alias("sec"), (40 + F.col("event_id") % 100).alias("pulse"))))


@query(with_views("""
    select e.subject_id, case when n >= 20 then round(m, 6) end as hr_sleep from v_nights e left join (
        select subject_id, count(*) as n, quantile_cont(40 + x, 0.5) as m from v_epochs where sleep_stage in ('N1','N2','N3','REM') and 40 + x between 30 and 150 group by 1) using (subject_id)""", "v_epochs", "v_nights"))
def sleeping_heart_rate(spark, sf) -> DataFrame:
    d = V.epochs(spark, sf).select("subject_id", "sleep_stage", (40 + F.col("x")).alias("hr_mean"))
    return rounded(H.sleeping_heart_rate(d, min_valid=20))


@query()
def heart_rate_spectrum(spark, sf) -> DataFrame:
    b = V.epochs(spark, sf)
    beats = b.select("subject_id", (F.col("epoch_idx") * 0.8 + F.least("x", F.lit(100.0)) / 1000).alias("t"))
    nights = V.nights(spark, sf).select("subject_id", F.greatest(F.lit(1), F.floor(F.col("n_epochs") * 0.8 / 30)).cast("int").alias("n_epochs"))
    return rounded(H.hrv_freq(beats, nights, min_peaks=30))


# ---- long sample trains laid end to end from the vectors ----------------------------------------

def sample_chunks(spark, sf, fs: float, channels: list[str]) -> DataFrame:
    """Vectors of subject vec_id mod 5 and one channel, in id order, cut into 30 s epochs."""
    e = V.embed_signal(spark, sf)
    n = len(channels)
    names = F.array(*[F.lit(c) for c in channels])
    s = e.select((F.col("vec_id") % 5).alias("subject_id"), F.element_at(names, (F.floor(F.col("vec_id") / 5) % n + 1).cast("int")).alias("channel"),
                 F.floor(F.col("vec_id") / (5 * n)).alias("_b"), F.posexplode("samples").alias("_k", "value"))
    s = s.withColumn("idx", F.col("_b") * 64 + F.col("_k"))
    per = round(30 * fs)
    g = s.groupBy("subject_id", "channel", F.floor(F.col("idx") / per).cast("int").alias("epoch_idx")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_s")).where(F.size("_s") == per)
    return g.select("subject_id", "channel", "epoch_idx", F.transform("_s", lambda v: v["value"]).alias("samples"))


@query()
def filtered_signal(spark, sf) -> DataFrame:
    d = S.filtered_chunks(sample_chunks(spark, sf, 4.0, ["THOR", "ABDO", "AIRFLOW"]), 4.0, 0.05, 1.5)
    return d.select("subject_id", "channel", "epoch_idx", F.round(S.rms("samples"), 6).alias("rms"))


@query()
def respiratory_features(spark, sf) -> DataFrame:
    return rounded(S.respiratory_features(sample_chunks(spark, sf, 4.0, ["THOR", "ABDO", "AIRFLOW"]), 4.0, 0.05, 1.5))


@query()
def resampled_effort(spark, sf) -> DataFrame:
    d = S.resample_chunks(sample_chunks(spark, sf, 10.0, ["THOR"]), 10, 2, 5)
    return d.select("subject_id", "channel", "epoch_idx", F.size("samples").alias("n"), F.round(S.array_mean("samples"), 6).alias("mean"))


@query()
def detected_beats(spark, sf) -> DataFrame:
    b = H.number_beats(H.detect_beats(sample_chunks(spark, sf, 32.0, ["ECG"]), 32.0))
    return rounded(H.rr_intervals(b))
