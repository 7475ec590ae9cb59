"""Beats, RR intervals, heart-rate variability and the beat-to-grid front end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from nightjar.functions import kernels
from nightjar.functions.expressions import EPOCH_SECONDS
from nightjar.operators.chunks import chunk_window, own_rows, with_halo
from nightjar.operators.running import row_positions
from nightjar.operators.signals import CHUNK_OF_EPOCHS, MARGIN_EPOCHS
from nightjar.operators.splines import spline_slopes
from nightjar.session import cut_lineage

BEAT_CHUNK = 20_000
RUN_HALO = 64
GAP_SECONDS = 3.0


def _per_subject_fill(chunks: DataFrame) -> DataFrame:
    """One value for missing samples per subject: the median over its epochs of the epoch's own median."""
    seen = F.sort_array(F.filter("samples", lambda x: x.isNotNull() & ~F.isnan(x)))
    return chunks.select("subject_id", F.when(F.size(seen) > 0, F.element_at(seen, F.floor(F.size(seen) / 2).cast("int") + 1)).alias("_m")).groupBy(
        "subject_id").agg(F.coalesce(F.percentile("_m", 0.5), F.lit(0.0)).alias("fill"))


def _high_level(energy: DataFrame, share: float = 0.9, per_octave: int = 64) -> DataFrame:
    """Per subject the energy that ``share`` of its samples do not exceed, by a histogram of 1/``per_octave`` octaves.

    Counts per (subject, bin) fold map-side and are exact, so the level does not depend on how a night
    was cut into chunks.
    """
    step = F.when(F.col("e") > 0, F.floor(F.log2("e") * per_octave)).otherwise(F.lit(-(1 << 30)))
    bins = energy.select("subject_id", F.explode("energy").alias("e")).groupBy("subject_id", step.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("subject_id").orderBy("bin")
    cum = bins.withColumns({"below": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("subject_id"))})
    reached = cum.where(F.col("below") >= F.lit(share) * F.col("all")).groupBy("subject_id").agg(F.min("bin").alias("bin"))
    return reached.select("subject_id", F.when(F.col("bin") > -(1 << 30), F.pow(F.lit(2.0), (F.col("bin") + 1) / per_octave)).otherwise(0.0).alias("level"))


def detect_beats(chunks: DataFrame, fs: float, size: int = CHUNK_OF_EPOCHS, margin: int = MARGIN_EPOCHS) -> DataFrame:
    """Beats (subject_id, t, amp): peaks of the slope energy of the 5-15 Hz band, at least 0.2 s apart.

    A peak must reach 0.3 of the subject's own 90th percentile of that energy. The percentile and the value
    that stands in for missing samples come from the whole night, by aggregates; the trace itself is
    only ever held as one chunk of epochs with its margins, so chunks of another size give the same beats.
    """
    per = round(EPOCH_SECONDS * fs)
    d = chunks.select("subject_id", "epoch_idx", "samples")

    def traced(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("epoch_idx")
        x = np.concatenate([np.asarray(s, dtype=float) for s in pdf["samples"]])
        fill = float(pdf["fill"].iloc[0])
        return pdf, np.where(np.isfinite(x), x, fill), kernels.slope_energy(kernels.zero_phase_bandpass(x, fs, 5.0, 15.0, fill), fs)

    def energies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, energy = traced(pdf)
        own = pdf["_own"].to_numpy()
        return pd.DataFrame({"subject_id": pdf["subject_id"].to_numpy()[own], "energy": pd.Series(list(energy.reshape(-1, per)[own]), dtype=object)})

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, energy = traced(pdf)
        level = float(pdf["level"].iloc[0])
        # in millionths of the level: what the filter's margins leave of a difference between chunks is less
        at = kernels.separated_peaks(np.round(energy / level, 6) if level > 0 else energy, 0.3, max(1, int(0.2 * fs)))
        at = at[pdf["_own"].to_numpy()[at // per]]
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[0], "t": (at + int(pdf["epoch_idx"].iloc[0]) * per) / fs, "amp": x[at]})

    key = d.select("subject_id").schema
    halo = cut_lineage(with_halo(d.join(_per_subject_fill(d), "subject_id"), "epoch_idx", size, margin, margin))
    energy = halo.groupBy("subject_id", "_chunk").applyInPandas(energies, T.StructType(list(key.fields)).add("energy", T.ArrayType(T.DoubleType())))
    levels = _high_level(energy)
    return halo.join(levels, "subject_id").groupBy("subject_id", "_chunk").applyInPandas(peaks, T.StructType(list(key.fields)).add("t", "double").add("amp", "double"))


def number_beats(beats: DataFrame, time: str = "t") -> DataFrame:
    """``beat`` = 0, 1, 2, ... per subject in time order, numbered block by block."""
    return row_positions(beats, ["subject_id"], F.floor(F.col(time) / 3600), [time], "beat")


def rr_intervals(beats: DataFrame) -> DataFrame:
    """RR of beat k is the time since beat k-1, by an equi join on the beat number."""
    prev = beats.select("subject_id", (F.col("beat") + 1).alias("beat"), F.col("t").alias("_t0"))
    return beats.join(prev, ["subject_id", "beat"]).select(
        "subject_id", (F.col("beat") - 1).alias("beat"), "t", ((F.col("t") - F.col("_t0")) * 1000.0).alias("rr"))


def robust_rr(rr: DataFrame, size: int = BEAT_CHUNK) -> DataFrame:
    """Merge spurious and split missed beats against the centred five-beat median.

    Input (subject_id, beat, rr) with contiguous beat numbers; output (subject_id, beat, part, rr) in
    beat, part order. A beat is short when rr < 0.5 median; a short beat that is not the last one
    swallows its successor. Inside a run of consecutive short beats the swallowing therefore
    alternates, so a beat merges iff it sits at an odd place of its run, and a beat is swallowed iff
    its predecessor merged. Unswallowed beats with rr >= 1.8 median split into
    max(2, round-half-even(rr / median)) equal parts. Subjects with fewer than 3 intervals pass unchanged.

    A run of short beats is itself short: no beat of a run that lies two beats inside it can be the
    largest, or the middle of a monotone stretch, of its own five-beat window, which leaves room for
    a valley of about nine beats. The halo covers that several times over.
    """
    n = rr.groupBy("subject_id").agg(F.count("*").alias("_n"))
    d = with_halo(rr.select("subject_id", "beat", "rr"), "beat", size, before=RUN_HALO + 2, after=2)
    w = chunk_window(["subject_id"], "beat")
    med = F.percentile("rr", F.lit(0.5)).over(w.rowsBetween(-2, 2))
    d = d.withColumn("_med", F.when(med > 0, med).otherwise(F.lit(1.0))).join(n, "subject_id")
    d = d.withColumn("_short", F.col("rr") / F.col("_med") < 0.5)
    run = F.col("beat") - F.sum(F.col("_short").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_run", run)
    place = F.sum(F.col("_short").cast("int")).over(
        Window.partitionBy("subject_id", "_chunk", "_run").orderBy("beat").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_merge", F.col("_short") & (place % 2 == 1) & (F.col("beat") < F.col("_n") - 1))
    d = d.withColumn("_swallowed", F.coalesce(F.lag("_merge").over(w), F.lit(False))).withColumn(
        "_next", F.lead("rr").over(w))
    ratio = F.col("rr") / F.col("_med")
    parts = F.when(F.col("_merge") | (ratio < 1.8), 1).otherwise(F.greatest(F.lit(2), F.rint(ratio).cast("int")))
    value = F.when(F.col("_merge"), F.col("rr") + F.col("_next")).otherwise(F.col("rr"))
    small = F.col("_n") < 3
    return (
        own_rows(d.withColumn("_parts", F.when(small, 1).otherwise(parts))
                 .withColumn("_value", F.when(small, F.col("rr")).otherwise(value)))
        .where(small | ~F.col("_swallowed"))
        .select("subject_id", "beat", F.posexplode(F.array_repeat(F.col("_value") / F.col("_parts"), F.col("_parts"))).alias("part", "rr"))
    )


def rr_validity(rr: DataFrame, first_beat: DataFrame) -> DataFrame:
    """Flag plausible intervals and place each at the cumulative time of its later beat.

    Valid: 400-1500 ms and a ratio to the previous corrected interval strictly inside (0.6, 1.6);
    the first interval's ratio is 1. ``first_beat`` holds (subject_id, t0) in seconds. Intervals add up in fixed point
    and times are whole nanoseconds, so a beat on the border of an epoch lies on the same side in any order of additions.
    """
    d = row_positions(rr, ["subject_id"], F.floor(F.col("beat") / BEAT_CHUNK), ["beat", "part"], "pos")
    block = F.floor(F.col("pos") / BEAT_CHUNK)
    d = d.withColumn("_block", block)
    prev = d.select("subject_id", (F.col("pos") + 1).alias("pos"), F.col("rr").alias("_prev"))
    earlier = Window.partitionBy("subject_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ms = F.col("rr").try_cast("decimal(28,10)")
    offsets = d.groupBy("subject_id", "_block").agg(F.sum(ms).alias("_s")).select(
        "subject_id", "_block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_offset"))
    running = F.sum(ms).over(Window.partitionBy("subject_id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    ratio = F.when(F.col("_prev").isNull(), F.lit(1.0)).otherwise(F.col("rr") / F.greatest(F.col("_prev"), F.lit(1e-6)))
    return (
        d.join(prev, ["subject_id", "pos"], "left").join(offsets, ["subject_id", "_block"]).join(first_beat, "subject_id")
        .withColumn("t", F.round(F.col("t0") + (F.col("_offset") + running).cast("double") / 1000.0, 9))
        .withColumn("valid", F.col("rr").between(400.0, 1500.0) & (ratio > 0.6) & (ratio < 1.6))
        .select("subject_id", "pos", "rr", "t", "valid")
    )


def hrv_time(rr: DataFrame) -> DataFrame:
    """Per epoch over valid intervals: mean rate, SDNN (ddof 1), RMSSD, pNN50; at least three intervals.

    Successive differences are between valid neighbours inside the epoch, so the window is one epoch.
    """
    d = rr.where("valid").withColumn("epoch_idx", F.floor(F.col("t") / EPOCH_SECONDS).cast("int"))
    w = Window.partitionBy("subject_id", "epoch_idx").orderBy("pos")
    g = d.withColumn("_d", F.col("rr") - F.lag("rr").over(w)).groupBy("subject_id", "epoch_idx").agg(
        F.count("*").alias("n_rr"),
        (F.lit(60000.0) / F.avg("rr")).alias("hr_mean"), F.stddev_samp("rr").alias("hrv_sdnn"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("hrv_rmssd"),
        F.avg((F.abs("_d") > 50.0).cast("double")).alias("hrv_pnn50"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "rr"))), lambda s: s["rr"]).alias("rr_list"))
    return g.where("n_rr >= 3")


def amplitude_variability(beats: DataFrame) -> DataFrame:
    """Per epoch: std(ddof 0) / |mean| and IQR / |median| of beat amplitudes; at least four beats."""
    q = F.percentile("amp", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = beats.groupBy("subject_id", F.floor(F.col("t") / EPOCH_SECONDS).cast("int").alias("epoch_idx")).agg(
        F.count("amp").alias("n_beats"), F.avg("amp").alias("_m"), F.stddev_pop("amp").alias("_sd"), q.alias("_q"))
    med = F.abs(F.col("_q")[1])
    return g.where("n_beats >= 4").select(
        "subject_id", "epoch_idx", "n_beats",
        F.when(F.abs("_m") > 1e-9, F.col("_sd") / F.abs("_m")).alias("cpc_amp_cv"),
        F.when(med > 1e-9, (F.col("_q")[2] - F.col("_q")[0]) / med).alias("cpc_amp_iqr"))


def hrv_freq(beats: DataFrame, nights: DataFrame, window: int = 120, min_peaks: int = 80,
             clamp: float = 5e4) -> DataFrame:
    """LF, HF, ratio and total power of the 120 s around each epoch centre.

    Beats are sent to the windows that hold them (at most five). A window clipped by the night's
    ends needs max(20, floor(min_peaks * seconds / 120)) beats and a median RR inside 400-1500 ms.
    """
    half, centre = window / 2, EPOCH_SECONDS / 2
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - half - centre) / EPOCH_SECONDS).cast("int"))
    last = F.least(F.col("n_epochs").cast("int") - 1, F.floor((F.col("t") + half - centre) / EPOCH_SECONDS).cast("int"))
    c = F.col("epoch_idx") * EPOCH_SECONDS + centre
    span = F.least((F.col("n_epochs") * EPOCH_SECONDS).cast("double"), c + half) - F.greatest(F.lit(0.0), c - half)
    need = F.greatest(F.lit(20), F.floor(min_peaks * span / window).cast("int"))
    w = (
        beats.join(nights, "subject_id").where(last >= first)
        .select("subject_id", "n_epochs", "t", F.explode(F.sequence(first, last)).alias("epoch_idx"))
        .groupBy("subject_id", "epoch_idx", "n_epochs").agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .where(F.size("ts") >= need)
    )

    @pandas_udf("struct<lf double, hf double, total double>")
    def spectrum(s: pd.Series) -> pd.DataFrame:
        out = []
        for ts in s:
            t = np.asarray(ts, dtype=float)
            ok = t.size > 8 and 0.4 <= np.median(np.diff(t)) <= 1.5
            out.append(kernels.heart_rate_spectrum(t) if ok else (None, None, None))
        return pd.DataFrame(out, columns=["lf", "hf", "total"], dtype=float)

    d = w.withColumn("p", spectrum("ts"))

    def bounded(name: str, limit: float) -> Column:
        x = F.nanvl(f"p.{name}", F.lit(None).cast("double"))
        return F.when(x <= limit, x)

    lf, hf = bounded("lf", clamp), bounded("hf", clamp)
    return d.select("subject_id", "epoch_idx", lf.alias("hrv_lf_power"), hf.alias("hrv_hf_power"),
                    F.when(hf > 0, lf / hf).alias("hrv_lf_hf_ratio"),
                    bounded("total", 2 * clamp).alias("hrv_total_power_freq"))


# ---- beat train -> 4 Hz channels --------------------------------------------------------------

def beat_segments(beats: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """Number the stretches of beats without a gap above ``gap`` seconds.

    Gaps are found by joining each beat to its predecessor; the running count is taken per hour
    block and offset by the blocks before it. ``beats`` has contiguous ``beat`` numbers.
    """
    prev = beats.select("subject_id", (F.col("beat") + 1).alias("beat"), F.col("t").alias("_t0"))
    d = beats.join(prev, ["subject_id", "beat"], "left").withColumn(
        "_cut", F.coalesce((F.col("t") - F.col("_t0") > gap).cast("int"), F.lit(0)))
    d = d.withColumn("_block", F.floor(F.col("beat") / BEAT_CHUNK))
    earlier = Window.partitionBy("subject_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("subject_id", "_block").agg(F.sum("_cut").alias("_n")).select(
        "subject_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("subject_id", "_block").orderBy("beat").rowsBetween(Window.unboundedPreceding, 0)
    return d.join(offsets, ["subject_id", "_block"]).withColumn(
        "segment", F.col("_offset") + F.sum("_cut").over(inside)).drop("_t0", "_cut", "_block", "_offset")


def median5_correct(beats: DataFrame, value: str, size: int = BEAT_CHUNK) -> DataFrame:
    """Replace values above twice or below half the width-5 median; the ends repeat the edge value.

    Subjects with fewer than five values stay unchanged. Positions are in ``beat``.
    """
    ends = beats.groupBy("subject_id").agg(F.count("*").alias("_n"), F.min_by(value, "beat").alias("_first"),
                                           F.max_by(value, "beat").alias("_last"))
    d = with_halo(beats, "beat", size, before=2, after=2)
    w = chunk_window(["subject_id"], "beat")
    names = {-2: "_a", -1: "_b", 1: "_c", 2: "_d"}
    d = d.select("*", *[F.lag(value, -k).over(w).alias(n) for k, n in names.items()])
    d = own_rows(d).join(ends, "subject_id")
    near = F.array(*[F.coalesce(F.col(n), F.col("_first") if k < 0 else F.col("_last")) for k, n in names.items()], F.col(value))
    med = F.element_at(F.sort_array(near), 3)
    bad = (F.col("_n") >= 5) & (med > 0) & ((F.col(value) > 2 * med) | (F.col(value) < 0.5 * med))
    return d.withColumn(f"{value}_corrected", F.when(bad, med).otherwise(F.col(value))).withColumn(
        "was_corrected", bad).drop(*names.values(), "_n", "_first", "_last")


def edr_area(chunks: DataFrame, beats: DataFrame, fs: float, half_s: float = 0.040, tau_s: float = 0.008) -> DataFrame:
    """Shoelace area of the delay-embedded +-40 ms around each beat; beats cut by the night's ends drop out.

    Each beat is exploded to its 2 * half + 1 sample numbers and equi-joined to the samples.
    """
    half, tau = round(half_s * fs), max(1, round(tau_s * fs))
    per = round(EPOCH_SECONDS * fs)
    samples = chunks.select("subject_id", "epoch_idx", F.posexplode("samples").alias("_k", "x")).select(
        "subject_id", (F.col("epoch_idx") * per + F.col("_k")).cast("bigint").alias("idx"), "x")
    want = beats.withColumn("_p", F.rint(F.col("t") * fs).cast("bigint")).select(
        "subject_id", "beat", "t", "_p", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"))
    w = want.withColumn("idx", F.col("_p") + F.col("o")).join(samples, ["subject_id", "idx"])
    g = w.groupBy("subject_id", "beat", "t").agg(F.sort_array(F.collect_list(F.struct("o", "x"))).alias("_w")).where(
        F.size("_w") == 2 * half + 1)
    m = 2 * half + 1 - tau
    v = F.transform("_w", lambda s: s["x"].cast("double"))
    X, Y = F.slice(v, 1, m), F.slice(v, tau + 1, m)

    def rolled(a: Column) -> Column:
        return F.concat(F.slice(a, 2, m - 1), F.slice(a, 1, 1))

    terms = F.zip_with(F.zip_with(X, rolled(Y), lambda a, b: a * b), F.zip_with(rolled(X), Y, lambda a, b: a * b), lambda p, q: p - q)
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)) * 0.5
    return g.select("subject_id", "beat", "t", area.alias("edr"))


def interpolate_runs(knots: DataFrame, fs_out: int, method: str = "pchip", min_points: int = 4, size: int = BEAT_CHUNK) -> DataFrame:
    """Irregular knots -> the 1/fs_out grid between the first and last knot, with a gap flag.

    ``knots``: (subject_id, beat, t, v, segment), contiguous ``beat``. Inside a segment with at least
    ``min_points`` knots ``method`` is used (``pchip``, the shape-preserving cubic, or ``cubic``, the spline with
    continuous curvature), elsewhere linear; grid points strictly between two segments are gap points. Each knot
    owns the grid points up to its successor. A shape-preserving slope needs two neighbours on each side, so chunks
    with a two-knot halo suffice; the spline's slopes come from a solve over the whole run (``spline_slopes``).
    """
    if method not in ("pchip", "cubic", "linear"):
        raise ValueError(f"unknown interpolation method {method!r}")
    if method == "cubic":
        knots = cut_lineage(knots)
    seg = knots.groupBy("subject_id", "segment").agg(F.count("*").alias("_m"))
    d = with_halo(spline_slopes(knots, min_points, size) if method == "cubic" else knots, "beat", size, before=2, after=3)
    w = chunk_window(["subject_id"], "beat")
    shift = {"_tp": (-1, "t"), "_vp": (-1, "v"), "_sp": (-1, "segment"), "_tn": (1, "t"), "_vn": (1, "v"),
             "_sn": (1, "segment"), "_tq": (2, "t"), "_vq": (2, "v"), "_sq": (2, "segment"),
             "_tb": (-2, "t"), "_vb": (-2, "v"), "_sb": (-2, "segment")}
    d = d.select("*", *[F.lead(c, k).over(w).alias(n) if k > 0 else F.lag(c, -k).over(w).alias(n) for n, (k, c) in shift.items()])

    def known(name: str, seg_name: str) -> Column:
        return F.when(F.col(seg_name) == F.col("segment"), F.col(name))

    tb, vb, tp, vp = known("_tb", "_sb"), known("_vb", "_sb"), known("_tp", "_sp"), known("_vp", "_sp")
    tn, vn, tq, vq = known("_tn", "_sn"), known("_vn", "_sn"), known("_tq", "_sq"), known("_vq", "_sq")
    t, v = F.col("t"), F.col("v")
    if method != "cubic":
        d = d.withColumn("_slope", _pchip_slope(tb, vb, tp, vp, t, v, tn, vn, tq, vq))
    d = d.withColumn("_slope_next", F.lead("_slope").over(w))
    d = own_rows(d).join(seg, ["subject_id", "segment"])
    step = F.lit(1.0 / fs_out)
    k0 = F.ceil(F.col("t") * fs_out).cast("bigint")
    k1 = F.when(F.col("_tn").isNull(), F.floor(F.col("t") * fs_out)).otherwise(F.ceil(F.col("_tn") * fs_out) - 1).cast("bigint")
    g = d.where(k1 >= k0).withColumn("tick", F.explode(F.sequence(k0, k1)))
    x = F.col("tick") * step
    same = F.coalesce(F.col("_sn") == F.col("segment"), F.lit(False))
    h = F.col("_tn") - F.col("t")
    u = (x - F.col("t")) / h
    linear = F.col("v") + u * (F.col("_vn") - F.col("v"))
    cubic = ((1 + 2 * u) * (1 - u) * (1 - u) * F.col("v") + u * (1 - u) * (1 - u) * h * F.col("_slope")
             + u * u * (3 - 2 * u) * F.col("_vn") + u * u * (u - 1) * h * F.col("_slope_next"))
    smooth = F.lit(method != "linear") & (F.col("_m") >= (max(4, min_points) if method == "cubic" else min_points)) & same
    return g.select("subject_id", "tick", F.when(F.col("_tn").isNull(), F.col("v")).when(smooth, cubic).otherwise(linear).alias("value"),
                    (~(same | (x == F.col("t")))).alias("gap"))


def _pchip_slope(tb, vb, tp, vp, t, v, tn, vn, tq, vq) -> Column:
    """Shape-preserving slope at (t, v): weighted harmonic mean inside, three-point rule at the ends."""
    hl, dl = t - tp, (v - vp) / (t - tp)
    hr, dr = tn - t, (vn - v) / (tn - t)
    w1, w2 = 2 * hr + hl, hr + 2 * hl
    inner = F.when(dl * dr > 0, (w1 + w2) / (w1 / dl + w2 / dr)).otherwise(F.lit(0.0))

    def end(h0, h1, d0, d1) -> Column:
        g = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(F.signum(g) != F.signum(d0), F.lit(0.0)).when(
            (F.signum(d0) != F.signum(d1)) & (F.abs(g) > 3 * F.abs(d0)), 3 * d0).otherwise(g)

    left_end = end(hr, tq - tn, dr, (vq - vn) / (tq - tn))
    right_end = end(hl, tp - tb, dl, (vp - vb) / (tp - tb))
    return F.when(tp.isNotNull() & tn.isNotNull(), inner).when(tn.isNotNull(), left_end).when(tp.isNotNull(), right_end)


def rate_agreement(rr_4hz: DataFrame, pulse: DataFrame, min_valid: int = 60) -> DataFrame:
    """60 / RR at whole seconds against the oximeter pulse: median gap, share within 5 bpm, correlation."""
    from nightjar.operators.running import grouped_quantiles

    sec = rr_4hz.where(F.pmod("tick", F.lit(4)) == 0).select(
        "subject_id", (F.col("tick") / 4).cast("int").alias("sec"), F.col("rr_s"))
    d = sec.join(pulse.select("subject_id", "sec", "pulse"), ["subject_id", "sec"]).where(
        (F.col("rr_s") > 0) & F.col("pulse").between(30, 200)).select(
        "subject_id", (F.lit(60.0) / F.col("rr_s")).alias("hr"), "pulse").withColumn("d", F.abs(F.col("hr") - F.col("pulse")))
    stats = d.groupBy("subject_id").agg(F.count("*").alias("n"), F.avg((F.col("d") <= 5).cast("double")).alias("within5"),
                                        F.stddev_pop("pulse").alias("_sd"), F.corr("hr", "pulse").alias("_r"))
    med = grouped_quantiles(d, ["subject_id"], "d", {"median_abs": 0.5}).drop("n_values")
    enough = F.col("n") >= min_valid
    return stats.join(med, "subject_id").select(
        "subject_id", F.col("n").alias("hr_check_n"), F.when(enough, F.col("median_abs")).alias("hr_check_median_abs_bpm"),
        F.when(enough, F.col("within5")).alias("hr_check_frac_within_5bpm"),
        F.when(enough & (F.col("_sd") > 0), F.col("_r")).alias("hr_check_r"))


def sleeping_heart_rate(epochs: DataFrame, min_valid: int = 240) -> DataFrame:
    """Median epoch heart rate over sleep inside 30-150 bpm; NULL below ``min_valid`` epochs."""
    from nightjar.functions.expressions import is_sleep
    from nightjar.operators.running import grouped_quantiles

    ok = epochs.where(is_sleep("sleep_stage") & F.col("hr_mean").between(30, 150))
    q = grouped_quantiles(ok, ["subject_id"], "hr_mean", {"m": 0.5})
    return epochs.select("subject_id").distinct().join(q, "subject_id", "left").select(
        "subject_id", F.when(F.col("n_values") >= min_valid, F.col("m")).alias("hr_sleep"))
