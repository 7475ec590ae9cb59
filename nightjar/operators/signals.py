"""Per-epoch and per-window signal features over sample arrays.

Samples arrive as ``signal_chunks``: one row per (subject, channel, epoch) with the epoch's samples
in an array, so a row is bounded by 30 s of signal. Filters that need neighbours run on chunks of
epochs with a margin on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from nightjar.functions import kernels
from nightjar.functions.expressions import EPOCH_SECONDS, col
from nightjar.operators.filters import filtered_chunks

# Frequency bands in Hz.
EEG_BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "sigma": (11.0, 16.0), "beta": (13.0, 30.0)}
ECG_BANDS = {"low": (0.5, 2.0), "mid_low": (2.0, 8.0), "mid": (8.0, 16.0), "mid_high": (16.0, 32.0), "high": (32.0, 62.0)}
POSITION_CODES = {0: "right", 1: "left", 2: "supine", 3: "prone", 4: "upright"}

CHUNK_OF_EPOCHS = 20
MARGIN_EPOCHS = 2


def epoch_view(samples: DataFrame, fs: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """Long samples -> whole 30 s epochs as arrays; an incomplete tail is dropped."""
    per = round(EPOCH_SECONDS * fs)
    return (
        samples.groupBy("subject_id", F.floor(F.col(idx) / per).cast("int").alias("epoch_idx"))
        .agg(F.sort_array(F.collect_list(F.struct(idx, value))).alias("_s"))
        .where(F.size("_s") == per)
        .select("subject_id", "epoch_idx", F.transform("_s", lambda s: s[value]).alias("samples"))
    )


def to_physical(samples: Column | str, gain: Column | str, dmin: Column | str, pmin: Column | str) -> Column:
    """Signed digital-to-physical scaling of a sample array."""
    g, d, p = col(gain), col(dmin), col(pmin)
    return F.transform(col(samples), lambda x: (x - d) * g + p)


# ---- spectra ----------------------------------------------------------------------------------

def welch_density(samples: Column | str, fs: float, nperseg: int, detrend: str = "constant") -> Column:
    """Welch density of a sample array; bin k sits at k * fs / min(nperseg, size). NULL for a flat or empty array."""

    @pandas_udf("array<double>")
    def density(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_density(a, fs, nperseg, detrend) for a in s])

    return density(col(samples))


def _density(a, fs: float, nperseg: int, detrend: str):
    x = None if a is None else np.asarray(a, dtype=float)
    if x is None or not np.isfinite(x).any() or np.nanstd(x) == 0:
        return None
    return kernels.welch(x, fs, nperseg, detrend)[1]


def _trapezoid(psd: Column, lo: float, hi: float, closed: bool, df: float, n_bins: int) -> Column:
    """Trapezoid over the bins inside [lo, hi), or [lo, hi] when ``closed``."""
    ks = [k for k in range(n_bins) if lo <= k * df and (k * df <= hi if closed else k * df < hi)]
    if not ks:
        return F.when(psd.isNotNull(), F.lit(0.0))
    part = F.slice(psd, ks[0] + 1, len(ks))
    total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)
    return (total - (F.element_at(part, 1) + F.element_at(part, -1)) / 2) * F.lit(df)


def band_power(df: DataFrame, psd: str, fs: float, nperseg: int, bands: dict, prefix: str,
               total: tuple[float, float], edge: bool = False) -> DataFrame:
    """Absolute and relative band power, total power and (EEG) the 95 % spectral edge."""
    step, n_bins, p = fs / nperseg, nperseg // 2 + 1, F.col(psd)
    out = {f"{prefix}_total_power": _trapezoid(p, *total, True, step, n_bins)}
    for b, (lo, hi) in bands.items():
        if min(hi, fs / 2) > lo:
            out[f"{prefix}_{b}_power"] = _trapezoid(p, lo, min(hi, fs / 2), False, step, n_bins)
    d = df.withColumns(out)
    safe = F.when(F.col(f"{prefix}_total_power") > 1e-20, F.col(f"{prefix}_total_power"))
    d = d.withColumns({f"{prefix}_{b}_rel": F.col(f"{prefix}_{b}_power") / safe
                       for b in bands if f"{prefix}_{b}_power" in out})
    if edge:
        ks = [k for k in range(n_bins) if total[0] <= k * step <= total[1]]
        zero = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("prev"), F.lit(-1).alias("k"), F.lit(-1).alias("hit"))
        target = F.col(f"{prefix}_total_power") * 0.95

        def advance(acc, x):
            k = acc["k"] + 1
            cum = F.when(k == 0, F.lit(0.0)).otherwise(acc["cum"] + (x + acc["prev"]) / 2 * F.lit(step))
            hit = F.when((acc["hit"] < 0) & (cum >= target), k).otherwise(acc["hit"])
            return F.struct(cum.alias("cum"), x.alias("prev"), k.alias("k"), hit.alias("hit"))

        hit = F.aggregate(F.slice(p, ks[0] + 1, len(ks)), zero, advance, lambda acc: acc["hit"])
        d = d.withColumn(f"{prefix}_spectral_edge95", F.when(
            (F.col(f"{prefix}_total_power") > 0) & (hit >= 0), (hit + ks[0]) * F.lit(step)))
    return d


def eeg_band_power(chunks: DataFrame, fs: float, nperseg: int | None = None, samples: str = "samples") -> DataFrame:
    nperseg = nperseg or int(4 * fs)
    d = chunks.withColumn("_psd", welch_density(samples, fs, nperseg))
    return band_power(d, "_psd", fs, nperseg, EEG_BANDS, "eeg", (0.5, 30.0), edge=True).drop("_psd", samples)


def ecg_band_power(chunks: DataFrame, fs: float, nperseg: int | None = None, samples: str = "samples") -> DataFrame:
    nperseg = nperseg or int(4 * fs)
    d = chunks.withColumn("_psd", welch_density(samples, fs, nperseg))
    return band_power(d, "_psd", fs, nperseg, ECG_BANDS, "ecg_band", (0.5, min(fs / 2, 62.0))).drop("_psd", samples)


def sample_entropy(samples: Column | str) -> Column:
    """Sample entropy (m = 2, r = 0.2 std) of a bounded array, missing samples dropped."""

    @pandas_udf("double")
    def entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if a is None else kernels.sample_entropy(np.asarray(a, dtype=float)) for a in s],
                            dtype=float)

    return F.nanvl(entropy(col(samples)), F.lit(None).cast("double"))


def oxygen_spectrum(signal: DataFrame, epochs: DataFrame, window: int = 120,
                    band: tuple[float, float] = (0.01, 0.067)) -> DataFrame:
    """Apnoea-cycle band, total power and their ratio in the 120 s around each epoch centre.

    Each second is sent to the epochs whose window holds it (four at most); a window is one array.
    """
    half, centre = window // 2, EPOCH_SECONDS // 2
    first = F.floor((F.col("sec") - half - centre) / EPOCH_SECONDS).cast("int") + 1
    last = F.floor((F.col("sec") + half - centre) / EPOCH_SECONDS).cast("int")
    windows = (
        signal.where("value IS NOT NULL")
        .select("subject_id", "sec", "value", F.explode(F.sequence(first, last)).alias("epoch_idx"))
        .groupBy("subject_id", "epoch_idx")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("sec", "value"))), lambda s: s["value"]).alias("x"))
    )

    step = F.lit(1.0) / F.least(F.size("x"), F.lit(64))
    density = windows.where(F.size("x") >= 30).select("subject_id", "epoch_idx", step.alias("step"), welch_density("x", 1.0, 64, "linear").alias("psd"))
    inside = F.filter("psd", lambda _, k: (k * F.col("step") >= band[0]) & (k * F.col("step") <= band[1]))
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v) * F.col("step")
    feats = density.select("subject_id", "epoch_idx", added(inside).alias("b"), added(F.col("psd")).alias("t")).select(
        "subject_id", "epoch_idx", F.col("b").alias("spo2_psd_apnea_band"), F.col("t").alias("spo2_psd_total"),
        F.when(F.col("t") > 0, F.col("b") / F.col("t")).alias("spo2_psd_apnea_ratio"))
    return epochs.join(feats, ["subject_id", "epoch_idx"], "left")


def _own_epochs(pdf: pd.DataFrame, own: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """The chunk's own epochs with their new samples; a chunk of halo rows only gives no row."""
    out = pdf.loc[own, ["subject_id", "channel", "epoch_idx"]].reset_index(drop=True)
    return out.assign(samples=pd.Series(list(y[own]), dtype=object))


def rms(samples: Column | str) -> Column:
    s = col(samples)
    return F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(s))


def array_mean(samples: Column | str) -> Column:
    s = col(samples)
    return F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x) / F.size(s)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once: Spark computes an expression inside a lambda anew for every element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def array_std(samples: Column | str) -> Column:
    """Population std by centred sums."""
    s = col(samples)
    return once(array_mean(s), lambda m: F.sqrt(F.aggregate(F.transform(s, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda acc, x: acc + x) / F.size(s)))


def array_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson r of two aligned arrays; NULL when either is flat (std at most 1e-12)."""
    a, b = col(a), col(b)
    means = F.struct(array_mean(a).alias("a"), array_mean(b).alias("b"))
    cov = once(means, lambda m: F.aggregate(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"])), F.lit(0.0), lambda acc, x: acc + x) / F.size(a))
    return once(F.struct(cov.alias("cov"), array_std(a).alias("a"), array_std(b).alias("b")),
                lambda s: F.when((s["a"] > 1e-12) & (s["b"] > 1e-12), s["cov"] / (s["a"] * s["b"])))


def breath_rate(samples: Column | str, fs: float, seconds: float = EPOCH_SECONDS, lo: float = 0.1, hi: float = 0.5) -> Column:
    """Breaths per minute: the strongest harmonic of the epoch between ``lo`` and ``hi`` Hz, NULL for a flat epoch.

    The few harmonics k / seconds of the band are correlated with the centred samples one by one.
    """
    x = col(samples)
    n = round(seconds * fs)
    ks = range(math.ceil(lo * seconds - 1e-9), math.floor(hi * seconds + 1e-9) + 1)

    def strongest(centred: Column) -> Column:
        def squared(k: int, wave) -> Column:
            turned = F.transform(centred, lambda v, i: v * wave(i * F.lit(2 * math.pi * k / n)))
            return once(F.aggregate(turned, F.lit(0.0), lambda acc, v: acc + v), lambda p: p * p)

        powers = [F.struct((squared(k, F.cos) + squared(k, F.sin)).alias("power"), F.lit(-k).alias("k")) for k in ks]
        flat = F.array_max(F.transform(centred, F.abs)) <= 1e-8
        return F.when(~flat, -F.array_max(F.array(*powers))["k"] * F.lit(60.0 / seconds))

    return once(array_mean(x), lambda mean: once(F.transform(x, lambda v: v - mean), strongest))


def respiratory_features(chunks: DataFrame, fs: float, lo: float = 0.05, hi: float = 3.0) -> DataFrame:
    """Effort and airflow summaries per epoch from the channels THOR, ABDO and AIRFLOW."""
    f = filtered_chunks(chunks.where(F.col("channel").isin("THOR", "ABDO", "AIRFLOW")), fs, lo, hi)
    wide = f.groupBy("subject_id", "epoch_idx").agg(*[
        F.max(F.when(F.col("channel") == c, F.col("samples"))).alias(c) for c in ("THOR", "ABDO", "AIRFLOW")])
    return wide.select(
        "subject_id", "epoch_idx",
        rms("AIRFLOW").alias("resp_airflow_rms"), array_std("AIRFLOW").alias("resp_airflow_std"),
        rms("THOR").alias("resp_thor_rms"), rms("ABDO").alias("resp_abdo_rms"),
        array_corr("THOR", "ABDO").alias("resp_thor_abdo_corr"),
        breath_rate("AIRFLOW", fs).alias("resp_breath_rate_bpm"))


def position_fractions(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Share of samples that round (half to even) to each position code; a missing sample matches none."""
    code = F.rint(F.col(value))
    return samples.groupBy(*by).agg(*[
        F.avg(F.when(code == k, 1.0).otherwise(0.0)).alias(f"position_{n}_frac") for k, n in POSITION_CODES.items()])


def resample_chunks(chunks: DataFrame, fs: int, up: int, down: int,
                    size: int = CHUNK_OF_EPOCHS, margin: int = 1) -> DataFrame:
    """Polyphase resampling by up/down, chunk by chunk, with margin epochs covering the filter length."""
    from nightjar.operators.chunks import with_halo

    out_per = EPOCH_SECONDS * fs * up // down
    d = with_halo(chunks.select("subject_id", "channel", "epoch_idx", "samples"), "epoch_idx", size, margin, margin)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch_idx")
        x = np.concatenate([np.asarray(s, dtype=float) for s in pdf["samples"]])
        y = kernels.resample(np.where(np.isfinite(x), x, 0.0), up, down).reshape(len(pdf), out_per)
        own = pdf["_own"].to_numpy()
        return _own_epochs(pdf, own, y)

    schema = d.select("subject_id", "channel", "epoch_idx").schema.add("samples", T.ArrayType(T.DoubleType()))
    return d.groupBy("subject_id", "channel", "_chunk").applyInPandas(run, schema)


# ---- live channel choice ----------------------------------------------------------------------

def channel_spread(chunks: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """Whole-night population std of each channel from per-epoch sums, merged by partial aggregation."""
    s = F.col(samples)
    d = chunks.select(*by, F.size(s).alias("_n"), array_mean(s).alias("_m"), array_std(s).alias("_sd"))
    means = d.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_mean"))
    off = F.col("_m") - F.col("_mean")  # centred before squaring: a large offset costs no digits
    return d.join(means, by).groupBy(*by).agg(
        F.sqrt(F.sum(F.col("_n") * (F.col("_sd") * F.col("_sd") + off * off)) / F.sum("_n")).alias("std_lsb"))


def pick_live_channel(spread: DataFrame, live_std: float = 5.0) -> DataFrame:
    """Per subject the candidate with the largest std (lowest index on ties) and whether it is live.

    ``spread`` has subject_id, channel_index, label, std_lsb. Rejected candidates stay listed, and
    ``dead_first`` flags a first candidate that would have been a dead pick.
    """
    c = F.struct("channel_index", "label", "std_lsb")
    g = spread.groupBy("subject_id").agg(
        F.max_by(c, F.struct("std_lsb", -F.col("channel_index"))).alias("best"),
        F.min_by("std_lsb", "channel_index").alias("first_std"),
        F.sort_array(F.collect_list(c)).alias("all"))
    return g.select(
        "subject_id", F.col("best.channel_index").alias("channel_index"), F.col("best.label").alias("label"),
        F.col("best.std_lsb").alias("std_lsb"), (F.col("best.std_lsb") > live_std).alias("ok"),
        F.filter("all", lambda x: x["channel_index"] != F.col("best.channel_index")).alias("rejected"),
        (F.col("first_std") <= live_std).alias("dead_first"))


def pick_alias(channels: DataFrame, aliases: DataFrame) -> DataFrame:
    """First alias present wins: (subject, canonical) -> the channel with the smallest priority.

    Labels match trimmed and case-insensitively; ``aliases`` has alias, canonical, priority.
    """
    key = F.upper(F.trim("label"))
    a = aliases.select(F.upper(F.trim("alias")).alias("_key"), "canonical", "priority")
    return (
        channels.withColumn("_key", key).join(a, "_key")
        .groupBy("subject_id", "canonical")
        .agg(F.min_by("label", F.struct("priority", "channel_index")).alias("label"),
             F.min_by("channel_index", F.struct("priority", "channel_index")).alias("channel_index"))
    )


def rate_check(channels: DataFrame, expected: dict[str, float], required: tuple[str, ...]) -> DataFrame:
    """Channels whose native rate differs from the expected one, and whether that blocks the recording."""
    spark = channels.sparkSession
    want = spark.createDataFrame([(k, float(v), k in required) for k, v in expected.items()],
                                 "canonical string, want_fs double, required boolean")
    return channels.join(want, "canonical").where(F.col("fs") != F.col("want_fs"))


def channel_quality(chunks: DataFrame, by: list[str], dmin: Column, dmax: Column, samples: str = "samples") -> DataFrame:
    """Std, clipped share, share below 50, distinct codes and the resulting flag list, per channel."""
    s = F.col(samples)
    spread = channel_spread(chunks, by, samples)
    per = chunks.select(*by, F.size(s).alias("_n"),
                        F.size(F.filter(s, lambda x: (x == dmin) | (x == dmax))).alias("_clip"),
                        F.size(F.filter(s, lambda x: x < 50)).alias("_low"))
    shares = per.groupBy(*by).agg((F.sum("_clip") / F.sum("_n")).alias("clip_frac"), (F.sum("_low") / F.sum("_n")).alias("lt50_frac"))
    codes = chunks.select(*by, F.explode(F.array_distinct(s)).alias("_v")).distinct().groupBy(*by).agg(
        F.count("*").alias("n_unique"))
    return spread.join(shares, by).join(codes, by).withColumn("flags", F.array_compact(F.array(
        F.when(F.col("std_lsb") < 5.0, "low_amplitude"), F.when(F.col("clip_frac") > 0.01, "clipped"))))


def window_quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """5 % and 95 % of the valid samples of one window (1,200 samples at most)."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return df.groupBy(*by).agg(q[0].alias("q05"), q[1].alias("q95"))


def soft_min_max(x: Column, q05: Column, q95: Column, valid: Column, skip: Column | bool = False, eps: float = 1e-6) -> Column:
    """(x - q05) / (q95 - q05); flat windows and padding give 0; skipped channels pass through."""
    skip = F.lit(skip) if isinstance(skip, bool) else skip
    scaled = F.when(q95 - q05 < eps, F.lit(0.0)).otherwise((x - q05) / (q95 - q05))
    return F.when(~valid, F.lit(0.0)).when(skip, x).otherwise(scaled)

