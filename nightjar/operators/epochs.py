"""The thirty-second epoch table: stages, labels, night summaries, positional filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.expressions import EPOCH_SECONDS, EVENT_BITS, event_bit, is_sleep
from nightjar.operators.chunks import CHUNK_EPOCHS, chunk_window, islands, own_rows, with_halo

LABEL_OVERLAP_SECONDS = 10.0


def epoch_spine(nights: DataFrame) -> DataFrame:
    """One row per epoch 0..n_epochs-1 from (subject_id, n_epochs)."""
    return nights.where("n_epochs > 0").select(
        "subject_id", F.explode(F.sequence(F.lit(0), F.col("n_epochs").cast("int") - 1)).alias("epoch_idx"))


def expand_stage_runs(runs: DataFrame) -> DataFrame:
    """Stage runs (subject_id, start_sec, duration_sec, stage, run_seq) -> one stage per epoch.

    A run covers max(1, round-half-even(duration / 30)) epochs; a later run overwrites an earlier one.
    """
    first = F.floor(F.col("start_sec") / EPOCH_SECONDS).cast("int")
    n = F.greatest(F.lit(1), F.rint(F.col("duration_sec") / EPOCH_SECONDS).cast("int"))
    return (
        runs.select("subject_id", "stage", "run_seq", F.explode(F.sequence(first, first + n - 1)).alias("epoch_idx"))
        .groupBy("subject_id", "epoch_idx")
        .agg(F.max_by("stage", "run_seq").alias("sleep_stage"))
    )


def align_to_spine(nights: DataFrame, column: DataFrame, fill: dict | None = None) -> DataFrame:
    """Pad or cut per-epoch columns to exactly n_epochs rows per subject."""
    out = epoch_spine(nights).join(column, ["subject_id", "epoch_idx"], "left")
    return out.fillna(fill) if fill else out


def overlap_rows(events: DataFrame) -> DataFrame:
    """One row per (event, epoch it touches) with the overlap in seconds: an equi-joinable interval."""
    end = F.col("start_sec") + F.col("duration_sec")
    first = F.greatest(F.lit(0), F.floor(F.col("start_sec") / EPOCH_SECONDS).cast("int"))
    last = F.floor(end / EPOCH_SECONDS).cast("int")
    touched = events.where(last >= first).withColumn("epoch_idx", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start_sec"), (F.col("epoch_idx") * EPOCH_SECONDS).cast("double"))
    hi = F.least(end, ((F.col("epoch_idx") + 1) * EPOCH_SECONDS).cast("double"))
    return touched.withColumn("overlap_sec", F.greatest(F.lit(0.0), hi - lo))


def label_epochs(epochs: DataFrame, events: DataFrame, threshold: float = LABEL_OVERLAP_SECONDS) -> DataFrame:
    """apnoea_label 1 where a single event overlaps the epoch by at least ``threshold`` seconds."""
    hit = (
        overlap_rows(events.select("subject_id", "start_sec", "duration_sec"))
        .where(F.col("overlap_sec") >= threshold)
        .groupBy("subject_id", "epoch_idx").agg(F.lit(1).alias("_hit"))
    )
    return (
        epochs.join(hit, ["subject_id", "epoch_idx"], "left")
        .withColumn("apnoea_label", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def event_context(epochs: DataFrame, events: DataFrame, threshold: float = LABEL_OVERLAP_SECONDS) -> DataFrame:
    """Per epoch the longest labelling event (first scored wins a tie), its kind and the re-derived label.

    ``events`` carries ``event_seq``, the order in which events were scored.
    """
    kind = F.when(F.lower("kind").startswith("hypopn"), "hypopnoea").otherwise("apnoea")
    best = (
        overlap_rows(events).where(F.col("overlap_sec") >= threshold)
        .groupBy("subject_id", "epoch_idx")
        .agg(F.max_by(F.struct(F.col("duration_sec").alias("d"), kind.alias("k")),
                      F.struct("duration_sec", -F.col("event_seq"))).alias("_e"))
    )
    return epochs.join(best, ["subject_id", "epoch_idx"], "left").select(
        epochs["*"],
        F.col("_e.d").alias("event_duration_s"),
        F.coalesce(F.col("_e.k"), F.lit("")).alias("event_kind"),
        F.col("_e").isNotNull().cast("int").alias("xml_label"),
    )


def sleep_event_counts(epochs: DataFrame, events: DataFrame) -> DataFrame:
    """Per subject: scored events and those whose midpoint falls in a sleep epoch."""
    mid = F.floor((F.col("start_sec") + F.col("duration_sec") / 2) / EPOCH_SECONDS).cast("int")
    asleep = epochs.where(is_sleep("sleep_stage")).select("subject_id", "epoch_idx", F.lit(1).alias("_s"))
    return (
        events.select("subject_id", mid.alias("epoch_idx"))
        .join(asleep, ["subject_id", "epoch_idx"], "left")
        .groupBy("subject_id")
        .agg(F.count("_s").alias("n_sleep_events"), F.count("*").alias("n_events_total"))
    )


def event_seconds(events: DataFrame, nights: DataFrame) -> DataFrame:
    """Per-second bitmask of event kinds: second s belongs to [start, end) when s + 0.5 does.

    An event sets its seconds as bits of the minutes it touches, one number a kind, so that minutes are grouped and not seconds.
    """
    n_sec = F.col("n_epochs").cast("bigint") * EPOCH_SECONDS
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("start_sec") - 0.5).cast("bigint"))
    hi = F.least(n_sec, F.ceil(F.col("start_sec") + F.col("duration_sec") - 0.5).cast("bigint")) - 1
    touched = (
        events.where("duration_sec > 0").join(nights, "subject_id")
        .select("subject_id", event_bit("kind").alias("bit"), lo.alias("lo"), hi.alias("hi"))
        .where("hi >= lo")
        .select("subject_id", "bit", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / 60), F.floor(F.col("hi") / 60))).alias("minute"))
    )
    first = F.greatest(F.lit(0), F.col("lo") - F.col("minute") * 60).cast("int")
    last = F.least(F.lit(59), F.col("hi") - F.col("minute") * 60).cast("int")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    seconds = F.call_function("shiftleft", F.call_function("shiftleft", one, last - first + 1) - one, first)
    kinds = sorted(set(EVENT_BITS.values()))
    minutes = touched.select("subject_id", "minute", "bit", seconds.alias("_s")).groupBy("subject_id", "minute").agg(
        *[F.bit_or(F.when(F.col("bit") == k, F.col("_s")).otherwise(none)).alias(f"_m{k}") for k in kinds])
    at = minutes.select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("_at"))
    mask = reduce(lambda x, y: x + y, [F.call_function("shiftright", F.col(f"_m{k}"), F.col("_at")).bitwiseAND(1).cast("int") * k for k in kinds])
    return at.select("subject_id", (F.col("minute") * 60 + F.col("_at")).alias("sec"), mask.alias("mask")).where("mask <> 0")


def night_summary(epochs: DataFrame, burden: str | None = None, size: int = CHUNK_EPOCHS) -> DataFrame:
    """Per subject: time in bed, sleep time, efficiency, wake after onset, events per hour of sleep.

    One shuffle on (subject, chunk of epochs): each chunk counts its wake epochs in all and after its
    own first sleep epoch. Only the chunk rows are then ordered per subject: later chunks count in
    full, the onset chunk from its first sleep on, earlier ones not at all.
    """
    half_minute = EPOCH_SECONDS / 60.0
    asleep, wake = is_sleep("sleep_stage"), F.col("sleep_stage") == "W"
    d = epochs.withColumn("_chunk", F.floor(F.col("epoch_idx") / size))
    first = F.min(F.when(asleep, F.col("epoch_idx"))).over(Window.partitionBy("subject_id", "_chunk"))
    aggs = [
        F.count("*").alias("n_epochs"), F.sum(asleep.cast("int")).alias("_sleep"), F.sum(wake.cast("int")).alias("_wake"),
        F.sum((wake & (F.col("epoch_idx") > F.col("_first"))).cast("int")).alias("_wake_after"), F.max("_first").alias("_first"),
        F.sum(F.when(asleep & (F.col("apnoea_label") == 1), 1).otherwise(0)).alias("n_apnoea_epochs"),
        F.sum(F.col(burden) if burden else F.lit(0.0)).alias("_burden"),
    ]
    chunks = d.withColumn("_first", first).groupBy("subject_id", "_chunk").agg(*aggs)
    onset = F.min(F.when(F.col("_first").isNotNull(), F.col("_chunk"))).over(Window.partitionBy("subject_id"))
    chunks = chunks.withColumn("_onset", onset)
    waso = F.when(F.col("_chunk") > F.col("_onset"), F.col("_wake")).when(F.col("_chunk") == F.col("_onset"), F.col("_wake_after")).otherwise(0)
    g = chunks.groupBy("subject_id").agg(
        F.sum("n_epochs").alias("n_epochs"), F.sum("_sleep").alias("_sleep"), F.sum(waso).alias("_waso"),
        F.sum("n_apnoea_epochs").alias("n_apnoea_epochs"), F.sum("_burden").alias("_burden"))
    tst = F.col("_sleep") * half_minute
    hours = F.when(tst > 0, tst / 60.0)
    out = [
        "subject_id", "n_epochs",
        (F.col("n_epochs") * half_minute).alias("tib_min"),
        tst.alias("tst_min"),
        (tst / (F.col("n_epochs") * half_minute)).alias("sleep_efficiency"),
        (F.col("_waso") * half_minute).alias("waso_min"),
        "n_apnoea_epochs",
        (F.col("n_apnoea_epochs") / hours).alias("ahi_proxy_per_hr"),
    ]
    if burden:
        out.append((F.col("_burden") / 60.0 / hours).alias("hypoxic_burden_per_night"))
    return g.select(*out)


def trim_window(epochs: DataFrame, margin: int = 60, whole_night: bool = False) -> DataFrame:
    """In-bed window: first sleep - margin .. last sleep + margin, unscored epochs dropped.

    Subjects without sleep are dropped. ``whole_night`` keeps every scored epoch instead.
    """
    span = epochs.where(is_sleep("sleep_stage")).groupBy("subject_id").agg(
        F.min("epoch_idx").alias("_lo"), F.max("epoch_idx").alias("_hi"))
    d = epochs.where(F.col("sleep_stage").isin("W", "N1", "N2", "N3", "REM")).join(span, "subject_id")
    if not whole_night:
        d = d.where(F.col("epoch_idx").between(F.col("_lo") - margin, F.col("_hi") + margin))
    return d.drop("_lo", "_hi")


# ---- positional context ----------------------------------------------------------------------

def contextual(epochs: DataFrame, cols: list[str], size: int = CHUNK_EPOCHS) -> DataFrame:
    """Six derivatives per column: lag1, lead1, centred 5- and 11-row mean and sample std."""
    d = with_halo(epochs, "epoch_idx", size, before=5, after=5)
    w = chunk_window(["subject_id"], "epoch_idx")
    new = {}
    for c in cols:
        new[f"{c}_lag1"] = F.lag(c, 1).over(w)
        new[f"{c}_lead1"] = F.lead(c, 1).over(w)
        for rows in (5, 11):
            frame = w.rowsBetween(-(rows // 2), rows // 2)
            new[f"{c}_roll{rows}_mean"] = F.avg(c).over(frame)
            new[f"{c}_roll{rows}_std"] = F.stddev_samp(c).over(frame)
    return own_rows(d.select("*", *[v.alias(k) for k, v in new.items()]))


def past_context(epochs: DataFrame, cols: list[str], windows: tuple[int, ...] = (5, 11),
                 size: int = CHUNK_EPOCHS) -> DataFrame:
    """Right-aligned rolling mean and std over the current and earlier rows only.

    Run it before any stage filter: the windows count recorded epochs, not kept ones.
    """
    d = with_halo(epochs, "epoch_idx", size, before=max(windows) - 1)
    w = chunk_window(["subject_id"], "epoch_idx")
    new = []
    for rows in windows:
        frame = w.rowsBetween(-(rows - 1), 0)
        for c in cols:
            new += [F.avg(c).over(frame).alias(f"{c}_past_roll{rows}_mean"),
                    F.stddev_samp(c).over(frame).alias(f"{c}_past_roll{rows}_std")]
    return own_rows(d.select("*", *new))


def first_sleep(epochs: DataFrame) -> DataFrame:
    """First sleep epoch per subject."""
    return epochs.where(is_sleep("sleep_stage")).groupBy("subject_id").agg(
        F.min("epoch_idx").alias("first_sleep_idx"))


def count_runs(epochs: DataFrame, flag: Column, by: list[str], name: str = "n_runs",
               pos: str = "epoch_idx", size: int = CHUNK_EPOCHS) -> DataFrame:
    """Maximal runs of flagged consecutive epochs per group; any index gap starts a new run.

    A run is counted where its first epoch sits: the flagged epoch whose predecessor is not flagged.
    The predecessor may be the halo row, so groups of any length are counted chunk by chunk.
    """
    d = with_halo(epochs.select(*by, pos, F.coalesce(flag, F.lit(False)).alias("_f")).where("_f"),
                  pos, size, before=1)
    w = chunk_window(by, pos)
    starts = own_rows(d.withColumn("_prev", F.lag(pos).over(w))).where(
        F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > 1))
    return starts.groupBy(*by).agg(F.count("*").alias(name))


def sleep_seconds(intervals: DataFrame, epochs: DataFrame) -> DataFrame:
    """Sleep seconds inside each [t0, t1): the interval is exploded to its epochs and equi-joined.

    ``intervals`` carries (subject_id, interval_id, t0, t1) in seconds.
    """
    asleep = epochs.where(is_sleep("sleep_stage")).select("subject_id", "epoch_idx")
    lo = F.floor(F.greatest(F.col("t0"), F.lit(0)) / EPOCH_SECONDS).cast("int")
    hi = F.floor((F.col("t1") - 1) / EPOCH_SECONDS).cast("int")
    parts = (
        intervals.where((F.col("t1") > F.col("t0")) & (hi >= lo)).withColumn("epoch_idx", F.explode(F.sequence(lo, hi)))
        .join(asleep, ["subject_id", "epoch_idx"])
        .groupBy("subject_id", "interval_id")
        .agg(F.sum(F.least(F.col("t1"), (F.col("epoch_idx") + 1) * EPOCH_SECONDS)
                   - F.greatest(F.col("t0"), F.col("epoch_idx") * EPOCH_SECONDS)).alias("sleep_sec"))
    )
    return intervals.join(parts, ["subject_id", "interval_id"], "left").fillna({"sleep_sec": 0})


def label_islands(epochs: DataFrame, flag: Column) -> DataFrame:
    """Runs of flagged epochs with start and length."""
    return islands(epochs, ["subject_id"], "epoch_idx", flag, {}, CHUNK_EPOCHS)
