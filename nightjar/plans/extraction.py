"""Recordings and annotations -> the wide epoch table: every feature group joined on the epoch spine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import EPOCH_SECONDS
from nightjar.operators import epochs as E
from nightjar.operators import heart as H
from nightjar.operators import oxygen as O
from nightjar.operators import signals as S
from nightjar.operators.columns import BASE_FEATURES
from nightjar.session import cut_lineage


def nights_of(channels: DataFrame) -> DataFrame:
    """Epochs per subject: the longest channel."""
    return channels.groupBy("subject_id").agg((F.max("epoch_idx") + 1).alias("n_epochs"))


def one_hertz(channels: DataFrame, channel: str, fs: int) -> DataFrame:
    """(subject_id, sec, value) of one channel, every fs-th sample."""
    d = channels.where(F.col("channel") == channel).select("subject_id", "epoch_idx", F.posexplode("samples").alias("k", "value"))
    return d.where(F.col("k") % fs == 0).select(
        "subject_id", (F.col("epoch_idx") * EPOCH_SECONDS + F.floor(F.col("k") / fs)).cast("int").alias("sec"), F.col("value").cast("double").alias("value"))


def label_epochs(nights: DataFrame, stage_runs: DataFrame, events: DataFrame) -> DataFrame:
    """Spine with aligned stages and event labels."""
    staged = E.align_to_spine(nights, E.expand_stage_runs(stage_runs), {"sleep_stage": "?"})
    return E.label_epochs(staged, events)


def extract_epochs(channels: DataFrame, stage_runs: DataFrame, events: DataFrame, rates: dict[str, int],
                   version: str, with_context: bool = True) -> DataFrame:
    """One wide row per epoch. ``channels``: (subject_id, channel, epoch_idx, samples) in physical units.

    Each feature group is an aggregate or an Arrow kernel over the channel it needs; all of them are
    keyed by (subject, epoch) and joined on that key. A missing channel leaves NULL columns.
    """
    nights = cut_lineage(nights_of(channels))
    base = cut_lineage(label_epochs(nights, stage_runs, events))
    groups: list[DataFrame] = []
    have = set(rates)

    if "SPO2" in have:
        spo2 = cut_lineage(O.clean(one_hertz(channels, "SPO2", rates["SPO2"])))
        groups.append(O.epoch_stats(spo2))
        per = S.epoch_view(spo2.withColumnRenamed("sec", "idx"), 1.0)
        groups.append(per.select("subject_id", "epoch_idx", S.sample_entropy("samples").alias("spo2_sampen")))
        groups.append(S.oxygen_spectrum(spo2, base.select("subject_id", "epoch_idx")))
        groups.append(O.desaturation_counts(base.select("subject_id", "epoch_idx", "sleep_stage"), spo2).drop("sleep_stage"))
        groups.append(O.burden_per_epoch(base.select("subject_id", "epoch_idx"), events, spo2))
    if "ECG" in have:
        fs = rates["ECG"]
        ecg = channels.where(F.col("channel") == "ECG")
        beats = cut_lineage(H.number_beats(H.detect_beats(ecg, fs)))
        first = beats.groupBy("subject_id").agg(F.min("t").alias("t0"))
        rr = H.rr_validity(H.robust_rr(H.rr_intervals(beats).select("subject_id", "beat", "rr")), first)
        hrv = H.hrv_time(cut_lineage(rr))
        groups.append(hrv.select("subject_id", "epoch_idx", "hr_mean", "hrv_sdnn", "hrv_rmssd", "hrv_pnn50",
                                 F.when(F.col("n_rr") >= 4, S.sample_entropy("rr_list")).alias("hrv_sampen")))
        groups.append(H.amplitude_variability(beats).drop("n_beats"))
        groups.append(H.hrv_freq(beats, nights))
        groups.append(S.ecg_band_power(ecg.select("subject_id", "epoch_idx", "samples"), float(fs)))
    if "EEG" in have:
        fs = rates["EEG"]
        eeg = S.filtered_chunks(channels.where(F.col("channel") == "EEG"), fs, 0.3, 35.0)
        groups.append(S.eeg_band_power(eeg.drop("channel"), float(fs)))
    if have & {"THOR", "ABDO", "AIRFLOW"}:
        fs = next(rates[c] for c in ("THOR", "ABDO", "AIRFLOW") if c in rates)
        groups.append(S.respiratory_features(channels, fs))
    if "POSITION" in have:
        pos = channels.where(F.col("channel") == "POSITION").select("subject_id", "epoch_idx", F.explode("samples").alias("value"))
        groups.append(S.position_fractions(pos, ["subject_id", "epoch_idx"]))

    wide = base
    for g in groups:
        wide = wide.join(g, ["subject_id", "epoch_idx"], "left")
    bases = [b for b in BASE_FEATURES if b in wide.columns]
    wide = wide.withColumn("features_version", F.lit(version))
    return E.contextual(cut_lineage(wide), bases) if with_context else wide


CHANNELS = ("RR", "EDR", "THOR", "ABDO", "AIRFLOW", "SPO2")


def derive_channels(channels: DataFrame, rates: dict[str, int]) -> DataFrame:
    """4 Hz model channels in long form: (subject_id, channel, tick, value) with quality kept apart.

    RR is in ms around the subject's median, EDR relative to its median, effort channels are
    resampled, SpO2 is (percent - 95) / 5. A channel without spread (std <= 1e-6) is left out.
    """
    from nightjar.operators.running import grouped_quantiles, union_all

    parts = []
    if "ECG" in rates:
        ecg = channels.where(F.col("channel") == "ECG")
        beats = cut_lineage(H.beat_segments(H.number_beats(H.detect_beats(ecg, rates["ECG"]))))
        rr = H.rr_intervals(beats).join(beats.select("subject_id", (F.col("beat") - 1).alias("beat"), "segment"), ["subject_id", "beat"])
        rr = rr.where(F.col("rr") <= H.GAP_SECONDS * 1000).withColumn("v", F.greatest(F.lit(0.3), F.least(F.lit(2.0), F.col("rr") / 1000)))
        knots = H.number_beats(rr.select("subject_id", "t", "v", "segment"))
        rr4 = cut_lineage(H.interpolate_runs(knots, 4, "cubic").withColumn("value", F.greatest(F.lit(0.3), F.least(F.lit(2.0), F.col("value")))))
        med = grouped_quantiles(rr4, ["subject_id"], "value", {"m": 0.5})
        parts.append(rr4.join(med, "subject_id").select("subject_id", F.lit("RR").alias("channel"), "tick", (1000 * (F.col("value") - F.col("m"))).alias("value")))
        edr = H.edr_area(ecg, beats, rates["ECG"]).join(beats.select("subject_id", "beat", "segment"), ["subject_id", "beat"])
        good = cut_lineage(H.number_beats(edr.select("subject_id", "t", F.col("edr").alias("v"), "segment")))
        fixed = H.median5_correct(good, "v").select("subject_id", "beat", "t", F.col("v_corrected").alias("v"), "segment")
        e4 = cut_lineage(H.interpolate_runs(fixed, 4))
        em = grouped_quantiles(e4, ["subject_id"], "value", {"m": 0.5}).where("m > 0")
        parts.append(e4.join(em, "subject_id").select("subject_id", F.lit("EDR").alias("channel"), "tick", (F.col("value") / F.col("m") - 1).alias("value")))
    belts = [c for c in ("THOR", "ABDO", "AIRFLOW") if c in rates]
    if belts:
        fs = rates[belts[0]]
        r = S.resample_chunks(channels.where(F.col("channel").isin(*belts)), fs, 2, 5)
        live = S.channel_spread(r, ["subject_id", "channel"]).where("std_lsb > 1e-6").select("subject_id", "channel")
        long = r.join(live, ["subject_id", "channel"]).select("subject_id", "channel", "epoch_idx", F.posexplode("samples").alias("k", "value"))
        parts.append(long.select("subject_id", "channel", (F.col("epoch_idx") * 120 + F.col("k")).cast("bigint").alias("tick"), "value"))
    if "SPO2" in rates:
        s = O.channel_4hz(one_hertz(channels, "SPO2", rates["SPO2"]))
        parts.append(s.select("subject_id", F.lit("SPO2").alias("channel"), F.col("tick").cast("bigint").alias("tick"), F.col("spo2_4hz").alias("value")))
    d = union_all([p.withColumn("tick", F.col("tick").cast("bigint")) for p in parts])
    return d.withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))


def front_end_quality(beats: DataFrame, grid: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """Per subject: beats, gaps, clipped intervals, gap share of the 4 Hz grid, median rate, corrected values.

    ``beats`` carries (subject_id, beat, t) with contiguous numbers, ``grid`` (subject_id, tick, gap),
    ``corrected`` (subject_id, was_corrected).
    """
    from nightjar.operators.running import grouped_quantiles

    rr = H.rr_intervals(beats).select("subject_id", (F.col("rr") / 1000).alias("rr"))
    is_gap = F.col("rr") > H.GAP_SECONDS
    clean = F.when(~is_gap, F.greatest(F.lit(0.3), F.least(F.lit(2.0), F.col("rr"))))
    clipped = F.when(~is_gap, ((F.col("rr") < 0.3) | (F.col("rr") > 2.0)).cast("double"))
    n = beats.groupBy("subject_id").agg(F.count("*").alias("n_peaks"))
    a = rr.groupBy("subject_id").agg(F.sum(is_gap.cast("int")).alias("n_gaps"), F.avg(clipped).alias("rr_clip_frac"))
    med = grouped_quantiles(rr.withColumn("c", clean), ["subject_id"], "c", {"m": 0.5})
    g = grid.groupBy("subject_id").agg(F.avg(F.col("gap").cast("double")).alias("rr_gap_frac"))
    out = n.join(a, "subject_id", "left").join(med, "subject_id", "left").join(g, "subject_id", "left").select(
        "subject_id", "n_peaks", "n_gaps", "rr_clip_frac", "rr_gap_frac", (F.lit(60.0) / F.col("m")).alias("hr_median_bpm"),
        (F.coalesce("n_values", F.lit(0)) >= 10).alias("ok"))
    if corrected is None:
        return out
    return out.join(corrected.groupBy("subject_id").agg(F.avg(F.col("was_corrected").cast("double")).alias("edr_corrected_frac")), "subject_id", "left")
