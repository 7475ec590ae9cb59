"""Numpy re-derivations of the signal operators and chunk independence."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightjar.functions import kernels as K
from nightjar.operators import heart as H
from nightjar.operators import oxygen as O
from nightjar.operators import signals as S
from nightjar.operators import splines as SP


def pchip_slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Shape-preserving derivative at each knot."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros(t.size)
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        g = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(g) != np.sign(d0):
            g = 0.0
        elif np.sign(d0) != np.sign(d1) and abs(g) > 3 * abs(d0):
            g = 3 * d0
        m[end] = g
    return m


def chunk_frame(spark, x, fs, channel="C", subject=1):
    per = int(30 * fs)
    ep = x[: len(x) // per * per].reshape(-1, per)
    return spark.createDataFrame([(subject, channel, i, [float(v) for v in e]) for i, e in enumerate(ep)],
                                 "subject_id int, channel string, epoch_idx int, samples array<double>")


def test_welch_of_a_sine_integrates_to_its_power():
    t = np.arange(3000) / 100
    f, p = K.welch(3 * np.sin(2 * np.pi * 5 * t), 100, 400)
    assert abs(f[p.argmax()] - 5) < 0.26 and abs(p.sum() * (f[1] - f[0]) - 4.5) < 0.05


def test_sample_entropy_brute_force():
    x = np.random.default_rng(0).normal(size=30)
    r = 0.2 * x.std()

    def count(m):
        t = [x[i:i + m] for i in range(len(x) - m + 1)]
        return sum(np.abs(t[i] - t[j]).max() <= r for i in range(len(t)) for j in range(i + 1, len(t)))

    a, b = count(3), count(2)
    want = -np.log(a / b) if a and b else None
    got = K.sample_entropy(x)
    assert got == want or abs(got - want) < 1e-12
    assert K.sample_entropy(np.ones(30)) is None and K.sample_entropy(x[:3]) is None


def test_filter_passes_the_band_and_keeps_phase():
    t = np.arange(6000) / 100
    low, mid = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 8 * t)
    y = K.zero_phase_bandpass(low + mid, 100, 5, 15)
    assert np.abs(y[500:-500] - mid[500:-500]).max() < 0.02


def serial_filter(x, fs, lo, hi):
    """Sample by sample, section by section, forward and backward, after 27 samples of odd reflection at both ends."""
    sections = K.bandpass_sections(fs, lo, hi)
    y = np.concatenate([2 * x[0] - x[27:0:-1], x, 2 * x[-1] - x[-2:-29:-1]])
    for _ in range(2):
        for g, a1, a2 in sections:
            held = y[0] * g * (1 - 1) / (1 + a1 + a2)  # the section's output for the constant input before the first sample
            before, past, out = [y[0], y[0]], [held, held], []
            for v in y.tolist():
                o = g * (v - before[1]) - a1 * past[0] - a2 * past[1]
                before, past = [v, before[0]], [o, past[0]]
                out.append(o)
            y = np.array(out)
        y = y[::-1]
    return y[27:-27]


def test_sections_have_the_gain_of_the_filter():
    """Squared gain 1 / (1 + q^8) with q from the bilinear map; half power at both band edges."""
    for fs, lo, hi in ((100, 5, 15), (125, 0.3, 35), (10, 0.05, 1.5)):
        f = np.array([lo, hi, (lo * hi) ** 0.5, lo / 3, (hi + fs / 2) / 2])
        z = np.exp(-2j * np.pi * f / fs)
        h = np.prod([g * (1 - z * z) / (1 + a1 * z + a2 * z * z) for g, a1, a2 in K.bandpass_sections(fs, lo, hi)], axis=0)
        w, wl, wh = (np.tan(np.pi * v / fs) for v in (f, lo, hi))
        np.testing.assert_allclose(np.abs(h) ** 2, 1 / (1 + ((w * w - wl * wh) / ((wh - wl) * w)) ** 8), rtol=1e-9)
        np.testing.assert_allclose(np.abs(h[:2]) ** 2, 0.5, rtol=1e-9)


@pytest.mark.parametrize("fs,lo,hi", [(10, 0.5, 3.0), (125, 0.3, 35.0), (10, 0.05, 1.5)])
def test_blocks_equal_the_serial_recursion(fs, lo, hi):
    x = np.random.default_rng(5).normal(size=3001) + 40
    np.testing.assert_allclose(K.zero_phase_bandpass(x, fs, lo, hi), serial_filter(x, fs, lo, hi), atol=1e-9)


@pytest.mark.parametrize("size", [1, 7, 60, 1000])
def test_chunked_filter_equals_the_serial_recursion(spark, size):
    """At any chunk size, first and last epochs included, also where epochs are absent."""
    x = np.random.default_rng(1).normal(size=60 * 30 * 10) + 5
    got = S.filtered_chunks(chunk_frame(spark, x, 10), 10, 0.05, 1.5, size=size).orderBy("epoch_idx").toPandas()
    assert got["epoch_idx"].tolist() == list(range(60))
    np.testing.assert_allclose(np.concatenate(got["samples"]), serial_filter(x, 10, 0.05, 1.5), atol=1e-9)
    if size == 7:
        some = S.filtered_chunks(chunk_frame(spark, x, 10).where("epoch_idx NOT BETWEEN 5 AND 22"), 10, 0.5, 3.0, size=size).orderBy("epoch_idx").toPandas()
        np.testing.assert_allclose(np.concatenate(some["samples"]), serial_filter(np.concatenate([x[:1500], x[6900:]]), 10, 0.5, 3.0), atol=1e-9)


def test_filter_fills_with_the_median_of_the_night(spark):
    x = np.random.default_rng(2).normal(size=8 * 300)
    holed = x.copy()
    holed[[3, 700, 701, 2399]] = np.nan
    got = S.filtered_chunks(chunk_frame(spark, holed, 10), 10, 0.5, 3.0, size=3).orderBy("epoch_idx").toPandas()
    whole = np.where(np.isnan(holed), np.nanmedian(holed), holed)
    np.testing.assert_allclose(np.concatenate(got["samples"]), serial_filter(whole, 10, 0.5, 3.0), atol=1e-9)
    assert S.filtered_chunks(chunk_frame(spark, x, 10), 10, 3.0, 5.0).count() == 8 and S.filtered_chunks(chunk_frame(spark, x, 10).where("false"), 10, 0.5, 3.0).count() == 0


def test_chunked_resampling_equals_whole_night(spark):
    x = np.random.default_rng(2).normal(size=45 * 300)
    got = S.resample_chunks(chunk_frame(spark, x, 10), 10, 2, 5, size=10).orderBy("epoch_idx").toPandas()
    np.testing.assert_allclose(np.concatenate(got["samples"]), K.resample(x, 2, 5), atol=1e-9)


def test_resampler_keeps_a_slow_sine():
    t = np.arange(3000) / 10
    y = K.resample(np.sin(2 * np.pi * 0.25 * t), 2, 5)
    want = np.sin(2 * np.pi * 0.25 * np.arange(1200) / 4)
    assert np.abs(y - want)[40:-40].max() < 0.02


def ecg(seconds, bpm=60, fs=125):
    t = np.arange(seconds * fs) / fs
    beats = np.arange(0.5, seconds, 60 / bpm)
    x = np.zeros_like(t)
    for b in beats:
        x += np.exp(-0.5 * ((t - b) / 0.02) ** 2)
    return x, beats


def test_beats_are_found_once_across_chunks(spark):
    x, beats = ecg(60 * 30)
    d = chunk_frame(spark, x, 125, "ECG")
    got = np.array(sorted(r.t for r in H.detect_beats(d, 125, size=7, margin=1).collect()))
    assert len(got) == len(beats)
    assert np.abs(got - beats).max() < 0.12
    one, two = (np.array(sorted(r.t for r in H.detect_beats(d, 125, size=n).collect())) for n in (20, 9))
    # beats do not depend on the chunk size, but for twin peaks of equal height
    assert np.mean(one == two) > 0.98 and np.abs(one - two).max() < 0.06
    rr = H.rr_intervals(H.number_beats(H.detect_beats(d, 125)))
    assert abs(rr.agg(F.avg("rr")).first()[0] - 1000) < 2


def scalar_robust(rr):
    n = len(rr)
    if n < 3:
        return list(rr)
    med = [np.median(rr[max(0, i - 2): i + 3]) for i in range(n)]
    out, skip = [], False
    for i in range(n):
        if skip:
            skip = False
            continue
        q = rr[i] / (med[i] if med[i] > 0 else 1.0)
        if q < 0.5 and i + 1 < n:
            out.append(rr[i] + rr[i + 1])
            skip = True
        elif q >= 1.8:
            k = max(2, round(q))
            out += [rr[i] / k] * k
        else:
            out.append(rr[i])
    return out


@pytest.mark.parametrize("size", [17, 20000])
def test_robust_rr_equals_the_sequential_rule(spark, size):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in range(40):
        n = int(rng.integers(1, 90))
        rr = rng.choice([150.0, 250.0, 380.0, 800.0, 900.0, 1900.0, 2600.0], size=n) + rng.random(n)
        want[s] = scalar_robust(rr)
        rows += [(s, i, float(v)) for i, v in enumerate(rr)]
    d = spark.createDataFrame(rows, "subject_id int, beat int, rr double")
    got = H.robust_rr(d, size).orderBy("subject_id", "beat", "part").toPandas()
    for s, w in want.items():
        np.testing.assert_allclose(got[got.subject_id == s]["rr"], w, atol=1e-9)


def test_pchip_matches_the_kernel_and_does_not_overshoot(spark):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.uniform(0.3, 1.4, 60))
    v = rng.normal(size=60)
    d = spark.createDataFrame([(1, i, float(a), float(b), 0) for i, (a, b) in enumerate(zip(t, v))],
                              "subject_id int, beat int, t double, v double, segment int")
    got = H.interpolate_runs(d, 4).orderBy("tick").toPandas()
    m = pchip_slopes(t, v)
    x = got["tick"].to_numpy() / 4
    k = np.clip(np.searchsorted(t, x, side="right") - 1, 0, 58)
    h = t[k + 1] - t[k]
    u = (x - t[k]) / h
    want = ((1 + 2 * u) * (1 - u) ** 2 * v[k] + u * (1 - u) ** 2 * h * m[k] + u * u * (3 - 2 * u) * v[k + 1] + u * u * (u - 1) * h * m[k + 1])
    np.testing.assert_allclose(got["value"], want, atol=1e-9)
    assert got["value"].max() <= v.max() + 1e-9 and not got["gap"].any()


def spline_system(t, v):
    """Dense matrix and right side of the slopes: second derivatives agree at inner knots, third ones at the two outer inner knots."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    n = len(t)
    a, y = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        y[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    for row, i in ((0, 1), (n - 1, n - 2)):  # (s[i-1] + s[i] - 2 d[i-1]) / h[i-1]^2 = (s[i] + s[i+1] - 2 d[i]) / h[i]^2
        l, r = h[i - 1] ** -2, h[i] ** -2
        a[row, i - 1:i + 2] = l, l - r, -r
        y[row] = 2 * (l * d[i - 1] - r * d[i])
    return a, y


@pytest.mark.parametrize("size", [2, 7, 100, 20_000])
def test_spline_slopes_equal_a_dense_solve(spark, size):
    rng = np.random.default_rng(7)
    rows, want, beat = [], {}, 0
    for seg, n in enumerate([4, 3, 5, 150, 1, 41]):
        t = 1000 * seg + np.cumsum(rng.uniform(0.3, 1.4, n))
        v = rng.normal(size=n)
        if n >= 4:
            want |= {beat + i: s for i, s in enumerate(np.linalg.solve(*spline_system(t, v)))}
        rows += [(1, beat + i, float(x), float(y), seg) for i, (x, y) in enumerate(zip(t, v))]
        beat += n
    d = spark.createDataFrame(rows, "subject_id int, beat int, t double, v double, segment int")
    got = {r.beat: r._slope for r in SP.spline_slopes(d, 4, size).collect()}
    assert len(got) == len(rows) and {k for k, v in got.items() if v is not None} == set(want)
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_long_arrays_take_time_in_proportion(spark):
    """Mean and centred samples are found once an array: once a sample, these arrays took minutes."""
    rng = np.random.default_rng(10)
    x = 3 + np.sin(2 * np.pi * 0.3 * np.arange(60_000) / 2000) + rng.normal(size=60_000) / 10
    z = x + rng.normal(size=60_000)
    d = spark.createDataFrame([(x.tolist(), z.tolist()), ([1.0] * 60_000, z.tolist()), (None, z.tolist())], "x array<double>, z array<double>")
    d.select(S.array_mean("x")).collect()
    began = time.perf_counter()
    one, flat, none = d.select(S.array_std("x").alias("std"), S.array_corr("x", "z").alias("corr"), S.breath_rate("x", 2000.0).alias("rate")).collect()
    assert time.perf_counter() - began < 30
    assert abs(one.std - x.std()) < 1e-9 and abs(one.corr - np.corrcoef(x, z)[0, 1]) < 1e-9 and one.rate == 18.0
    assert flat == (0.0, None, None) and none == (None, None, None)


def test_spline_runs_are_solved_from_a_stream_of_batches():
    """Many short runs need no group each: they come in one stream, and a run may be parted by the border of a batch."""
    rng = np.random.default_rng(8)
    lengths = [4, 4, 9, 30, 5]
    n, run = sum(lengths), np.repeat(np.arange(5), lengths)
    a, b, c, y = rng.random(n), 3 + rng.random(n), rng.random(n), rng.normal(size=n)
    t = pa.table({"subject_id": ["u"] * 4 + ["v"] * 48, "segment": [0] * 4 + (run[4:] // 2).tolist(), "beat": np.arange(n), "_chunk": [0] * 17 + [1] * 35,
                  "_cut": run > 2, "_a": a, "_b": b, "_c": c, "_y": y})
    got = pa.Table.from_batches(list(SP.solve_runs(iter(t.to_batches(max_chunksize=3)))))
    assert got.select(["beat", "segment"]).to_pydict() == t.select(["beat", "segment"]).to_pydict()
    want = np.concatenate([SP.eliminate(a[run == k], b[run == k], c[run == k], y[run == k]) for k in range(5)])
    np.testing.assert_array_equal(np.column_stack([got.column(x) for x in ("p", "q", "r")]), want)
    assert not list(SP.solve_runs(iter([])))


def test_spline_of_a_hundred_thousand_knots(spark):
    """Chunks of 4,096 knots satisfy all equations of the one system, and a cubic comes back exactly."""
    n = 100_000
    rng = np.random.default_rng(8)
    t = np.cumsum(rng.uniform(0.3, 1.4, n))
    v = rng.normal(size=n)
    d = spark.createDataFrame(pd.DataFrame({"subject_id": 1, "beat": np.arange(n), "t": t, "v": v, "segment": 0}))
    s = SP.spline_slopes(d, 4, 4096).orderBy("beat").toPandas()["_slope"].to_numpy()
    h, k = np.diff(t), np.diff(v) / np.diff(t)
    inner = h[1:] * s[:-2] + 2 * (h[:-1] + h[1:]) * s[1:-1] + h[:-1] * s[2:] - 3 * (h[1:] * k[:-1] + h[:-1] * k[1:])
    assert np.abs(inner).max() < 1e-9
    for i in (1, n - 2):
        assert abs((s[i - 1] + s[i] - 2 * k[i - 1]) / h[i - 1] ** 2 - (s[i] + s[i + 1] - 2 * k[i]) / h[i] ** 2) < 1e-8
    whole = SP.eliminate(*serial_diagonals(t, v))[:, 0]
    np.testing.assert_allclose(s, whole, atol=1e-9)
    few = spark.createDataFrame([(1, i, float(x), float(x ** 3 - 2 * x), 0) for i, x in enumerate(np.cumsum(rng.uniform(0.2, 0.5, 30)))], "subject_id int, beat int, t double, v double, segment int")
    got = H.interpolate_runs(few, 4, "cubic", size=8).toPandas()
    x = got["tick"].to_numpy() / 4
    np.testing.assert_allclose(got["value"], x ** 3 - 2 * x, atol=1e-8)


def serial_diagonals(t, v):
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    a = np.concatenate([[0], h[1:], [h[-1] + h[-2]]])
    b = np.concatenate([[h[1]], 2 * (h[:-1] + h[1:]), [h[-2]]])
    c = np.concatenate([[h[0] + h[1]], h[:-1], [0]])
    y = np.concatenate([[((3 * h[0] + 2 * h[1]) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])], 3 * (h[1:] * d[:-1] + h[:-1] * d[1:]),
                        [(h[-1] ** 2 * d[-2] + (3 * h[-1] + 2 * h[-2]) * h[-2] * d[-1]) / (h[-1] + h[-2])]])
    return a, b, c, y


def test_trailing_max_restarts_after_a_gap(spark):
    x = [96.0, 97.0, None, 90.0, 91.0, 89.0]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "subject_id int, sec int, value double")
    for size in (2, 100):
        got = [r.baseline for r in O.trailing_max(d, rows=3, size=max(size, 3)).orderBy("sec").collect()]
        assert got == [96.0, 97.0, None, 90.0, 91.0, 91.0]


@pytest.mark.parametrize("size", [120, 36000])
def test_desaturations_equal_a_scalar_scan(spark, size):
    rng = np.random.default_rng(7)
    x = 96 + np.cumsum(rng.normal(scale=0.5, size=900)) * 0.3
    x[rng.random(900) < 0.01] = np.nan
    d = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "subject_id int, sec int, value double")
    base = np.full(900, np.nan)
    for i in range(900):
        if np.isnan(x[i]):
            continue
        j = i
        while j > 0 and i - (j - 1) < 100 and not np.isnan(x[j - 1]):
            j -= 1
        base[i] = x[j:i + 1].max()
    hit = base - x >= 3
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
    want = [(int(a), int(b - a), float(np.nanmin(x[a:b])), float(base[a])) for a, b in zip(edges[::2], edges[1::2]) if b - a >= 10]
    got = sorted(tuple(r)[1:] for r in O.desaturations(d, 3.0, 10, size=size).collect())
    assert got == want and want


def test_saturation_channel_gap_rules(spark):
    x = np.full(600, 96.0)
    x[100:130] = 0
    x[300:400] = 0
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "subject_id int, sec int, value double")
    got = {r.tick: r.spo2_4hz for r in O.channel_4hz(d).collect()}
    assert len(got) == 2400
    assert abs(got[115 * 4] - 0.2) < 1e-12 and got[350 * 4] == 0.0 and abs(got[10] - 0.2) < 1e-12
    runs = {r.start: r.is_long for r in O.bad_runs(d).collect()}
    assert runs == {100: False, 300: True}


def test_hypoxic_burden_single_event(spark):
    x = np.full(400, 96.0)
    x[150:170] = 90.0
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "subject_id int, sec int, value double")
    ev = spark.createDataFrame([(1, 140.0, 15.0, "Hypopnea", 0), (1, 140.0, 15.0, "Arousal", 1)],
                               "subject_id int, start_sec double, duration_sec double, kind string, event_seq int")
    r = O.hypoxic_burden(ev, d).collect()
    assert len(r) == 1 and r[0].baseline == 96.0 and r[0].burden == 20 * 6.0 and r[0].epoch_idx == 5


def test_soft_min_max(spark):
    d = spark.createDataFrame([(1, i, float(i)) for i in range(101)] + [(2, i, 5.0) for i in range(10)], "w int, k int, x double")
    q = S.window_quantiles(d, ["w"], "x")
    z = d.join(q, "w").select("w", "k", S.soft_min_max(F.col("x"), F.col("q05"), F.col("q95"), F.lit(True)).alias("z")).toPandas()
    one = z[z.w == 1].sort_values("k")["z"].to_numpy()
    assert abs(one[5]) < 1e-12 and abs(one[95] - 1) < 1e-12 and (z[z.w == 2]["z"] == 0).all()


def test_live_channel_ties_go_to_the_lowest_index(spark):
    d = spark.createDataFrame([(1, 3, "A", 9.0), (1, 1, "B", 9.0), (1, 0, "C", 1.0), (2, 0, "A", 2.0)],
                              "subject_id int, channel_index int, label string, std_lsb double")
    got = {r.subject_id: r for r in S.pick_live_channel(d).collect()}
    assert got[1].channel_index == 1 and got[1].ok and got[1].dead_first and len(got[1].rejected) == 2
    assert not got[2].ok


def test_heart_rate_variability_closed_form(spark):
    rr = [800.0, 900.0, 850.0, 800.0]
    d = spark.createDataFrame([(1, i, v, 1.0 + i, True) for i, v in enumerate(rr)], "subject_id int, pos int, rr double, t double, valid boolean")
    r = H.hrv_time(d).first()
    diff = np.diff(rr)
    assert abs(r.hr_mean - 60000 / np.mean(rr)) < 1e-9 and abs(r.hrv_sdnn - np.std(rr, ddof=1)) < 1e-9
    assert abs(r.hrv_rmssd - np.sqrt(np.mean(diff ** 2))) < 1e-9 and abs(r.hrv_pnn50 - 1 / 3) < 1e-9


def test_oxygen_spectrum_finds_the_apnoea_cycle(spark):
    t = np.arange(600)
    x = 94 + 2 * np.sin(2 * np.pi * t / 32)
    d = spark.createDataFrame([(1, int(i), float(v)) for i, v in zip(t, x)], "subject_id int, sec int, value double")
    ep = spark.createDataFrame([(1, i) for i in range(20)], "subject_id int, epoch_idx int")
    got = S.oxygen_spectrum(d, ep).toPandas()
    assert len(got) == 20 and got["spo2_psd_apnea_ratio"].min() > 0.9


def test_features_frame_is_pandas_free_of_rows_lost(spark):
    pdf = pd.DataFrame({"subject_id": [1] * 90, "idx": range(90), "value": np.arange(90.0)})
    got = S.epoch_view(spark.createDataFrame(pdf), 1.0).orderBy("epoch_idx").collect()
    assert [len(r.samples) for r in got] == [30, 30, 30] and got[1].samples[0] == 30.0
