"""Queries over sample arrays: spectra, entropy, beats, model windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.epochs import r
from nightjar.functions import expressions as X
from nightjar.operators import signals as S
from nightjar.plans import views as V
from nightjar.plans.views import with_views

FS, NPERSEG = 64.0, 32

SAMPLES = "select vec_id, label as subject_id, unnest(embedding)::double as v, unnest(generate_series(0, 63)) as i from embeddings"
SEGMENTS = """
    select vec_id, seg, k, v - avg(v) over (partition by vec_id, seg) as v from (
        select vec_id, s.seg, i - s.seg * 16 as k, v from samples join (select unnest([0, 1, 2]) as seg) s on i >= s.seg * 16 and i < s.seg * 16 + 32)"""
DENSITY = """
    select vec_id, bin, avg(p) as psd from (
        select vec_id, seg, bin, (power(sum(w * v * cos(2 * pi() * bin * k / 32)), 2) + power(sum(w * v * sin(2 * pi() * bin * k / 32)), 2))
               / (64.0::double * sum(w * w)) * case when bin in (0, 16) then 1 else 2 end as p
        from (select *, 0.5 - 0.5 * cos(2 * pi() * k / 32) as w from segments), generate_series(0, 16) g(bin) group by 1, 2, 3)
    group by 1, 2"""


@query(with_views("select vec_id, cast(bin as integer) as bin, round(psd, 8) as psd from density",
                  samples=SAMPLES, segments=SEGMENTS, density=DENSITY))
def welch_density(spark, sf) -> DataFrame:
    d = V.embed_signal(spark, sf).select("vec_id", S.welch_density("samples", FS, NPERSEG).alias("p"))
    return d.select("vec_id", F.posexplode("p").alias("bin", "psd")).withColumn("psd", r("psd", 8))


def _trap(lo: float, hi: float, closed: bool) -> str:
    ks = [k for k in range(17) if lo <= 2 * k and (2 * k <= hi if closed else 2 * k < hi)]
    if len(ks) < 2:
        return "0.0::double"
    return f"sum(case when bin in ({ks[0]}, {ks[-1]}) then psd / 2 when bin > {ks[0]} and bin < {ks[-1]} then psd else 0 end) * 2.0::double"


def _bands(bands: dict, prefix: str, total: tuple[float, float]) -> str:
    tot = _trap(*total, True)
    parts = [f"round({tot}, 7) as {prefix}_total_power"]
    for b, (lo, hi) in bands.items():
        if min(hi, 32.0) > lo:
            parts += [f"round({_trap(lo, min(hi, 32.0), False)}, 7) as {prefix}_{b}_power",
                      f"round({_trap(lo, min(hi, 32.0), False)} / nullif({tot}, 0), 6) as {prefix}_{b}_rel"]
    return ", ".join(parts)


def _rounded(d: DataFrame, prefix: str) -> DataFrame:
    return d.withColumns({c: r(c, 6 if c.endswith("_rel") else 7) for c in d.columns if c.startswith(prefix)})


@query(with_views(f"""
    select vec_id, {_bands(S.EEG_BANDS, 'eeg', (0.5, 30.0))}, max(edge) as eeg_spectral_edge95
    from density left join (
        select vec_id, min(bin) * 2.0::double as edge from (
            select vec_id, bin, sum(case when bin > 1 then (psd + prev) / 2 * 2 else 0 end) over (partition by vec_id order by bin) as cum
            from (select *, lag(psd) over (partition by vec_id order by bin) as prev from density) where bin between 1 and 15)
        join (select vec_id, {_trap(0.5, 30.0, True)} as tot from density group by 1) using (vec_id) where cum >= 0.95 * tot group by 1) using (vec_id)
    group by vec_id""", samples=SAMPLES, segments=SEGMENTS, density=DENSITY))
def eeg_band_power(spark, sf) -> DataFrame:
    d = S.eeg_band_power(V.embed_signal(spark, sf).select("vec_id", "samples"), FS, NPERSEG)
    edge = d.select("vec_id", "eeg_spectral_edge95")
    return _rounded(d.drop("eeg_spectral_edge95"), "eeg").join(edge, "vec_id")


@query(with_views(f"select vec_id, {_bands(S.ECG_BANDS, 'ecg_band', (0.5, 32.0))} from density group by vec_id",
                  samples=SAMPLES, segments=SEGMENTS, density=DENSITY))
def ecg_band_power(spark, sf) -> DataFrame:
    return _rounded(S.ecg_band_power(V.embed_signal(spark, sf).select("vec_id", "samples"), FS, NPERSEG), "ecg_band")


@query(with_views("""
    select vec_id, round(-ln(a::double / b), 6) as sample_entropy from (
        select x.vec_id, sum(case when abs(x.v - y.v) <= x.r and abs(x.v1 - y.v1) <= x.r then 1 else 0 end) as b,
               sum(case when x.v2 is not null and y.v2 is not null and abs(x.v - y.v) <= x.r and abs(x.v1 - y.v1) <= x.r and abs(x.v2 - y.v2) <= x.r then 1 else 0 end) as a
        from t x join t y on x.vec_id = y.vec_id and x.i < y.i and x.v1 is not null and y.v1 is not null group by 1)
    where a > 0 and b > 0""", samples=SAMPLES, t="""
    select vec_id, i, v, lead(v) over w as v1, lead(v, 2) over w as v2, 0.2 * stddev_pop(v) over (partition by vec_id) as r
    from samples window w as (partition by vec_id order by i)"""))
def sample_entropy(spark, sf) -> DataFrame:
    d = V.embed_signal(spark, sf).select("vec_id", r(S.sample_entropy("samples")).alias("sample_entropy"))
    return d.where("sample_entropy IS NOT NULL")


@query(with_views("""
    select vec_id, round(sqrt(avg(v * v)), 6) as rms, round(stddev_pop(v), 6) as std, round(corr(v, w), 6) as corr_next
    from (select s.*, e.embedding[i + 1]::double as w from samples s join embeddings e on e.vec_id = (s.vec_id + 1) % (select count(*) from embeddings)) group by 1""",
                  samples=SAMPLES))
def epoch_rms_std_corr(spark, sf) -> DataFrame:
    e = V.embed_signal(spark, sf).select("vec_id", "samples")
    n = e.agg(F.count("*")).scalar()
    nxt = e.select(F.col("vec_id").alias("_n"), F.col("samples").alias("s2"))
    d = e.withColumn("_n", (F.col("vec_id") + 1) % n).join(nxt, "_n")
    return d.select("vec_id", r(S.rms("samples")).alias("rms"), r(S.array_std("samples")).alias("std"),
                    r(S.array_corr("samples", "s2")).alias("corr_next"))


@query(with_views("""
    select vec_id, round(arg_max(bin, {'m': m, 'b': -bin}) * 64.0::double / 64 / 5 * 60, 6) as breaths_per_min from (
        select vec_id, bin, sqrt(power(sum(c * cos(2 * pi() * bin * i / 64)), 2) + power(sum(c * sin(2 * pi() * bin * i / 64)), 2)) as m
        from (select *, v - avg(v) over (partition by vec_id) as c from samples), generate_series(1, 2) g(bin) group by 1, 2) group by 1""",
                  samples=SAMPLES))
def breath_rate(spark, sf) -> DataFrame:
    # 64 samples at 12.8 Hz: 5 s per array, bins every 0.2 Hz, of which 0.2 and 0.4 lie in the band
    return V.embed_signal(spark, sf).select("vec_id", r(S.breath_rate("samples", 12.8, seconds=5)).alias("breaths_per_min"))


@query(with_views("""
    select vec_id, cast(i as integer) as i, round((v - (-128)) * 0.25 + 2.0, 6) as value from samples""", samples=SAMPLES))
def physical_units(spark, sf) -> DataFrame:
    d = V.embed_signal(spark, sf).select("vec_id", S.to_physical("samples", F.lit(0.25), F.lit(-128.0), F.lit(2.0)).alias("s"))
    return d.select("vec_id", F.posexplode("s").alias("i", "value")).withColumn("value", r("value"))


@query(with_views("""
    select subject_id, cast(sec // 30 as integer) as epoch_idx, cast(sec % 30 as integer) as k, value
    from (select *, count(*) over (partition by subject_id, sec // 30) as n from v_signal) where n = 30""", "v_signal"))
def whole_epochs(spark, sf) -> DataFrame:
    d = S.epoch_view(V.signal(spark, sf).withColumnRenamed("sec", "idx"), 1.0)
    return d.select("subject_id", "epoch_idx", F.posexplode("samples").alias("k", "value"))


@query(with_views("""
    select subject_id, cast(epoch_idx // 30 as integer) as block, """ + ", ".join(
        f"avg(case when round_even(x / 40, 0) = {k} then 1.0 else 0.0 end) as position_{n}_frac" for k, n in S.POSITION_CODES.items())
                  + " from v_epochs group by 1, 2", "v_epochs"))
def position_fractions(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf).select("subject_id", F.floor(F.col("epoch_idx") / 30).cast("int").alias("block"), (F.col("x") / 40).alias("value"))
    return S.position_fractions(e, ["subject_id", "block"])


# ---- candidate channels: five vectors of a subject compete ----------------------------------------------

CHANNELS = """
    select label as subject_id, cast(vec_id % 5 as integer) as channel_index, 'CH' || (vec_id % 5) as label,
           stddev_pop(v) as std_lsb from (select label, vec_id, unnest(embedding)::double * (1 + vec_id % 5) as v from embeddings) group by 1, 2, 3"""


def _channels(spark, sf) -> DataFrame:
    e = V.embed_signal(spark, sf)
    k = (F.col("vec_id") % 5).cast("int")
    return e.select("subject_id", k.alias("channel_index"), F.concat(F.lit("CH"), k).alias("label"),
                    F.transform("samples", lambda x: x * (1 + F.col("vec_id") % 5)).alias("samples"))


@query(with_views("select subject_id, channel_index, label, round(std_lsb, 6) as std_lsb from ch", ch=CHANNELS))
def channel_spread(spark, sf) -> DataFrame:
    return S.channel_spread(_channels(spark, sf), ["subject_id", "channel_index", "label"]).withColumn("std_lsb", r("std_lsb"))


@query(with_views("""
    select subject_id, arg_max(channel_index, {'s': std_lsb, 'i': -channel_index}) as channel_index,
           arg_max(label, {'s': std_lsb, 'i': -channel_index}) as label, round(max(std_lsb), 6) as std_lsb, max(std_lsb) > 0.6 as ok,
           count(*) - 1 as n_rejected, arg_min(std_lsb, channel_index) <= 0.6 as dead_first from ch group by 1""", ch=CHANNELS))
def live_channel_choice(spark, sf) -> DataFrame:
    s = S.channel_spread(_channels(spark, sf), ["subject_id", "channel_index", "label"])
    d = S.pick_live_channel(s, live_std=0.6)
    return d.select("subject_id", "channel_index", "label", r("std_lsb").alias("std_lsb"), "ok",
                    F.size("rejected").cast("bigint").alias("n_rejected"), "dead_first")


ALIASES = [("ECG", "ECG", 0), ("EKG", "ECG", 1), ("automobile", "SPO2", 0), ("Machinery", "SPO2", 1), ("building", "HR", 0),
           ("FURNITURE", "HR", 1), ("household", "HR", 2)]


@query("""
    select subject_id, canonical, arg_min(label, {'p': priority, 'i': channel_index}) as label,
           arg_min(channel_index, {'p': priority, 'i': channel_index}) as channel_index
    from (select cast(c_nationkey as bigint) as subject_id, c_mktsegment as label, c_custkey as channel_index from customer) c
    join (values """ + ", ".join(f"('{a.upper()}', '{c}', {p})" for a, c, p in ALIASES) + """) a(k, canonical, priority) on upper(trim(label)) = k
    group by 1, 2""")
def channel_alias_choice(spark, sf) -> DataFrame:
    c = V.table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("subject_id"), F.col("c_mktsegment").alias("label"),
                                              F.col("c_custkey").alias("channel_index"))
    return S.pick_alias(c, spark.createDataFrame(ALIASES, "alias string, canonical string, priority int"))


@query("""
    select l_suppkey as subject_id, canonical, fs, want_fs, required from (
        select l_suppkey, l_returnflag as canonical, max(l_quantity) as fs from lineitem group by 1, 2)
    join (values ('A', 50.0::double, true), ('N', 50.0::double, false), ('R', 49.0::double, true)) w(c, want_fs, required) on canonical = c where fs <> want_fs""")
def sampling_rate_check(spark, sf) -> DataFrame:
    c = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("canonical")).agg(
        F.max("l_quantity").alias("fs"))
    return S.rate_check(c, {"A": 50.0, "N": 50.0, "R": 49.0}, ("A", "R")).select("subject_id", "canonical", "fs", "want_fs", "required")


@query(with_views("""
    select subject_id, channel_index, round(stddev_pop(v), 6) as std_lsb, round(avg(case when v in (0, 4) then 1.0::double else 0 end), 6) as clip_frac,
           round(avg(case when v < 50 then 1.0::double else 0 end), 6) as lt50_frac, count(distinct v) as n_unique,
           concat_ws(',', case when stddev_pop(v) < 5 then 'low_amplitude' end, case when avg(case when v in (0, 4) then 1.0 else 0 end) > 0.01 then 'clipped' end) as flags
    from (select label as subject_id, cast(vec_id % 5 as integer) as channel_index, unnest(list_transform(embedding, lambda x: round_even(x::double * 20, 0))) as v from embeddings)
    group by 1, 2"""))
def channel_quality(spark, sf) -> DataFrame:
    e = V.embed_signal(spark, sf).select("subject_id", (F.col("vec_id") % 5).cast("int").alias("channel_index"),
                                         F.transform("samples", lambda x: F.rint(x * 20)).alias("samples"))
    d = S.channel_quality(e, ["subject_id", "channel_index"], F.lit(0.0), F.lit(4.0))
    return d.withColumns({c: r(c) for c in ("std_lsb", "clip_frac", "lt50_frac")}).withColumn("flags", F.array_join("flags", ","))


# ---- thirty probabilities -> one score --------------------------------------------------------------------

_P30 = "select vec_id, list_slice(embedding, 1, 30)::double[] as p from embeddings"


@query(with_views("""
    select vec_id, round(list_avg(p), 6) as mean, list_max(p) as max, list_reverse_sort(p)[10] as k10,
           list_max(list_transform(generate_series(1, 21), lambda i: list_min(list_slice(p, i, i + 9)))) as c10 from p30""", p30=_P30))
def second_to_epoch_scores(spark, sf) -> DataFrame:
    p = F.slice("samples", 1, 30)
    d = V.embed_signal(spark, sf).select("vec_id", p.alias("p"))
    return d.select("vec_id", *[(r(X.seconds_to_epoch("p", a)) if a == "mean" else X.seconds_to_epoch("p", a)).alias(a) for a in X.AGGREGATORS])


@query("""
    select vec_id, cast(i as integer) as i, round(case when i >= 60 then 0 when q95 - q05 < 1e-6 then 0 else (v - q05) / (q95 - q05) end, 6) as z from (
        select s.*, quantile_cont(v, 0.05) filter (i < 60) over (partition by vec_id) as q05, quantile_cont(v, 0.95) filter (i < 60) over (partition by vec_id) as q95
        from (""" + SAMPLES + """) s)""")
def window_normalisation(spark, sf) -> DataFrame:
    e = V.embed_signal(spark, sf).select("vec_id", F.posexplode("samples").alias("i", "v"))
    valid = F.col("i") < 60
    q = S.window_quantiles(e.where(valid), ["vec_id"], "v")
    d = e.join(q, "vec_id")
    return d.select("vec_id", "i", r(S.soft_min_max(F.col("v"), F.col("q05"), F.col("q95"), valid)).alias("z"))
