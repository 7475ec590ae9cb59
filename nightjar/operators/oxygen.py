"""Oxygen saturation on a one-second grid: cleaning, desaturations, hypoxic burden, 4 Hz channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.expressions import EPOCH_SECONDS, exact_mean, is_sleep, missing_to_null
from nightjar.operators.chunks import CHUNK_SECONDS, chunk_window, islands, own_rows, with_halo

MIN_VALID = 50.0
BASELINE_SECONDS = 100
# Event kinds that count towards the burden.
BURDEN_KINDS = ("Obstructive Apnea", "Central Apnea", "Mixed Apnea", "Hypopnea",
                "Obstructive apnea", "Central apnea", "Mixed apnea")


def clean(signal: DataFrame, value: str = "value") -> DataFrame:
    """Fractions become percent (judged per subject) and values below 50 become NULL."""
    x = missing_to_null(value)
    scale = signal.groupBy("subject_id").agg(F.max(F.abs(x)).alias("_top"))
    v = F.when(F.col("_top") <= 2.0, x * 100.0).otherwise(x)
    return signal.join(scale, "subject_id").withColumn(value, F.when(v >= MIN_VALID, v)).drop("_top")


def every_nth_sample(samples: DataFrame, fs: float, idx: str = "idx") -> DataFrame:
    """One sample per second from a faster trace: every round(fs)-th row."""
    step = max(1, round(fs))
    return samples.where(F.pmod(F.col(idx), F.lit(step)) == 0).withColumn("sec", (F.col(idx) / step).cast("int"))


def trailing_max(signal: DataFrame, value: str = "value", rows: int = BASELINE_SECONDS,
                 size: int = CHUNK_SECONDS, name: str = "baseline") -> DataFrame:
    """Max over up to ``rows`` samples ending here, restarting after every missing sample."""
    d = with_halo(signal, "sec", size, before=rows - 1)
    w = chunk_window(["subject_id"], "sec")
    d = d.withColumn("_gap", F.sum(F.col(value).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("subject_id", "_chunk", "_gap").orderBy("sec").rowsBetween(-(rows - 1), 0)
    return own_rows(
        d.withColumn(name, F.when(F.col(value).isNotNull(), F.max(value).over(inside))).drop("_gap"))


def desaturations(signal: DataFrame, threshold: float = 3.0, min_duration: int = 10,
                  value: str = "value", size: int = CHUNK_SECONDS) -> DataFrame:
    """Maximal runs at least ``threshold`` below the trailing baseline: start, duration, nadir, baseline."""
    b = trailing_max(signal.select("subject_id", "sec", value), value, size=size)
    runs = islands(b, ["subject_id"], "sec", F.col("baseline") - F.col(value) >= threshold,
                   {"nadir": (value, "min"), "baseline": ("baseline", "first")}, size)
    return runs.where(F.col("length") >= min_duration).select(
        "subject_id", F.col("start").alias("start_sec"), F.col("length").alias("duration_sec"), "nadir", "baseline")


def desaturation_counts(epochs: DataFrame, signal: DataFrame, min_duration: int = 10) -> DataFrame:
    """Per epoch: 3 % and 4 % desaturations starting in it and the deepest 4 % drop; sleep epochs only."""
    epoch = F.floor(F.col("start_sec") / EPOCH_SECONDS).cast("int").alias("epoch_idx")
    d3 = desaturations(signal, 3.0, min_duration).groupBy("subject_id", epoch).agg(F.count("*").alias("_n3"))
    d4 = desaturations(signal, 4.0, min_duration).groupBy("subject_id", epoch).agg(
        F.count("*").alias("_n4"), F.max(F.col("baseline") - F.col("nadir")).alias("_depth"))
    asleep = is_sleep("sleep_stage")
    key = ["subject_id", "epoch_idx"]
    return epochs.join(d3, key, "left").join(d4, key, "left").select(
        epochs["*"],
        F.when(asleep, F.coalesce("_n3", F.lit(0))).otherwise(0).alias("odi3_count"),
        F.when(asleep, F.coalesce("_n4", F.lit(0))).otherwise(0).alias("odi4_count"),
        F.when(asleep, F.col("_depth")).alias("desat_depth"),
    )


def epoch_stats(signal: DataFrame, value: str = "value") -> DataFrame:
    """Mean, min, max and population std of the non-missing samples of each epoch."""
    return signal.groupBy("subject_id", F.floor(F.col("sec") / EPOCH_SECONDS).cast("int").alias("epoch_idx")).agg(
        F.avg(value).alias("spo2_mean"), F.min(value).alias("spo2_min"),
        F.max(value).alias("spo2_max"), F.stddev_pop(value).alias("spo2_std"))


def _event_end(events: DataFrame) -> DataFrame:
    end = F.col("start_sec") + F.col("duration_sec")
    return events.where(F.col("kind").isin(*BURDEN_KINDS)).withColumn("end_sec", end).withColumn(
        "end_idx", F.rint(end).cast("int"))


def _at_offsets(events: DataFrame, signal: DataFrame, lo: Column, hi: Column, keep: list[str]) -> DataFrame:
    """Range join as an equi join: each event is exploded to the seconds end+lo .. end+hi-1."""
    return (
        events.select("subject_id", *keep, "end_idx", F.explode(F.sequence(lo, hi - 1)).alias("offset"))
        .withColumn("sec", F.col("end_idx") + F.col("offset"))
        .join(signal.select("subject_id", "sec", "value"), ["subject_id", "sec"])
    )


def search_windows(events: DataFrame, signal: DataFrame, pre: int = 60, post: int = 120,
                   default: tuple[int, int] = (30, 90)) -> DataFrame:
    """Per subject (lo_sec, hi_sec) around event end, from the event-aligned average trace.

    Events need the whole -60..+120 s span inside the recording and one valid sample in it. The
    peaks left and right of the end bound the window, of equal peaks the earliest; weak support or odd bounds give the default.
    """
    length = signal.groupBy("subject_id").agg((F.max("sec") + 1).alias("n_sec"))
    ev = _event_end(events)
    inside = ev.join(length, "subject_id").where((F.col("end_idx") >= pre) & (F.col("end_idx") + post <= F.col("n_sec")))
    aligned = _at_offsets(inside, signal, F.lit(-pre), F.lit(post), ["event_seq"])
    # a column's mean and support need only the events with a valid sample somewhere in their span
    seen = aligned.where("value IS NOT NULL")
    n_events = seen.groupBy("subject_id").agg(F.count_distinct("event_seq").alias("n"))
    mean = seen.groupBy("subject_id", "offset").agg(exact_mean("value").alias("m"), F.count("*").alias("support"))
    need = F.greatest(F.lit(2), F.ceil(F.col("n") * 0.5).cast("int"))
    before = F.col("offset") < 0

    def peak(side: Column, what: Column) -> Column:
        return F.max_by(F.when(side, what), F.when(side, F.struct("m", -F.col("offset"))))

    stats = mean.join(n_events, "subject_id").groupBy("subject_id").agg(
        F.max("n").alias("n"),
        (F.sum((before & (F.col("support") >= need)).cast("int")) / pre).alias("pre_ok"),
        (F.sum((~before & (F.col("support") >= need)).cast("int")) / post).alias("post_ok"),
        peak(before, F.struct("offset", "support")).alias("l"),
        peak(~before, F.struct("offset", "support")).alias("r"),
    )
    lo, hi = -F.col("l.offset"), F.col("r.offset")
    good = (
        (F.col("n") >= 5) & (F.col("pre_ok") >= 0.5) & (F.col("post_ok") >= 0.5)
        & (F.col("l.support") >= need) & (F.col("r.support") >= need)
        & (lo >= 5) & (hi >= 5) & (lo <= 90) & (hi <= 120)
    )
    found = stats.where(good).select("subject_id", lo.alias("lo_sec"), hi.alias("hi_sec"))
    return ev.select("subject_id").distinct().join(found, "subject_id", "left").select(
        "subject_id", F.coalesce("lo_sec", F.lit(default[0])).alias("lo_sec"),
        F.coalesce("hi_sec", F.lit(default[1])).alias("hi_sec"))


def hypoxic_burden(events: DataFrame, signal: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Per event: baseline (max of the 100 s before its end) and the area below it in the search window."""
    length = signal.groupBy("subject_id").agg((F.max("sec") + 1).alias("n_sec"))
    ev = _event_end(events).join(length, "subject_id").where((F.col("end_idx") > 0) & (F.col("end_idx") <= F.col("n_sec")))
    win = windows if windows is not None else search_windows(events, signal)
    key = ["subject_id", "event_seq"]
    base = (
        _at_offsets(ev, signal, F.lit(-BASELINE_SECONDS), F.lit(0), ["event_seq"])
        .groupBy(*key).agg(F.max("value").alias("baseline"))
    )
    area = (
        _at_offsets(ev.join(win, "subject_id"), signal, -F.col("lo_sec"), F.col("hi_sec"), ["event_seq"])
        .join(base, key)
        .groupBy(*key).agg(F.sum(F.greatest(F.lit(0.0), F.col("baseline") - F.col("value"))).alias("burden"))
    )
    return (
        ev.select(*key, "end_sec").join(base.where("baseline IS NOT NULL"), key).join(area, key, "left")
        .select(*key, F.floor(F.col("end_sec") / EPOCH_SECONDS).cast("int").alias("epoch_idx"), "baseline",
                F.coalesce("burden", F.lit(0.0)).alias("burden"))
    )


def burden_per_epoch(epochs: DataFrame, events: DataFrame, signal: DataFrame) -> DataFrame:
    """Burden of the events that end in each epoch, zero elsewhere."""
    b = hypoxic_burden(events, signal).groupBy("subject_id", "epoch_idx").agg(
        F.sum("burden").alias("hypoxic_burden_epoch"))
    return epochs.join(b, ["subject_id", "epoch_idx"], "left").fillna({"hypoxic_burden_epoch": 0.0})


# ---- 4 Hz model channel -----------------------------------------------------------------------

def bad_runs(signal: DataFrame, value: str = "value", max_gap: int = 60, top: float = 100.5) -> DataFrame:
    """Runs of missing or implausible samples; runs above ``max_gap`` seconds are long."""
    bad = F.col(value).isNull() | (F.col(value) < MIN_VALID) | (F.col(value) > top)
    return islands(signal, ["subject_id"], "sec", bad, {}).withColumn("is_long", F.col("length") > max_gap)


def channel_4hz(signal: DataFrame, value: str = "value", max_gap: int = 60, top: float = 100.5) -> DataFrame:
    """(percent - 95) / 5 at 4 Hz: short gaps linear, long gaps zero, nearest value held at both ends.

    Every gap is a run with one valid neighbour on each side, so filling needs two equi joins on the
    run's borders, not a window over the subject.
    """
    good = F.col(value).between(MIN_VALID, top)
    x = signal.select("subject_id", "sec", F.when(good, F.col(value)).alias("v"))
    valid = x.where("v IS NOT NULL")
    runs = bad_runs(signal, value, max_gap, top)
    left = valid.select("subject_id", (F.col("sec") + 1).alias("start"), F.col("v").alias("vl"))
    right = valid.select("subject_id", F.col("sec").alias("stop"), F.col("v").alias("vr"))
    gaps = (
        runs.withColumn("stop", F.col("start") + F.col("length"))
        .join(left, ["subject_id", "start"], "left").join(right, ["subject_id", "stop"], "left")
        .withColumn("sec", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    )
    t = (F.col("sec") - F.col("start") + 1) / (F.col("length") + 1)
    linear = F.when(F.col("vl").isNotNull() & F.col("vr").isNotNull(), F.col("vl") + t * (F.col("vr") - F.col("vl")))
    filled = gaps.where(F.col("vl").isNotNull() | F.col("vr").isNotNull()).select(
        "subject_id", "sec", F.when(F.col("is_long"), F.lit(0.0)).otherwise(
            (F.coalesce(linear, F.col("vl"), F.col("vr")) - 95.0) / 5.0).alias("z"))
    grid = valid.select("subject_id", "sec", ((F.col("v") - 95.0) / 5.0).alias("z")).unionByName(filled)
    nxt = grid.select("subject_id", (F.col("sec") - 1).alias("sec"), F.col("z").alias("z1"))
    quarter = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("q")
    return grid.join(nxt, ["subject_id", "sec"], "left").select("subject_id", "sec", quarter, "z", "z1").select(
        "subject_id", (F.col("sec") * 4 + F.col("q")).alias("tick"),
        F.when(F.col("z1").isNull(), F.col("z")).otherwise(
            F.col("z") + F.col("q") / 4.0 * (F.col("z1") - F.col("z"))).alias("spo2_4hz"))
