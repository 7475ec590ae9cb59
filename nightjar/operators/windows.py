"""Five-minute model windows: geometry, gathering, targets, and scores back to epochs.

Window j of a night reads seconds [180 j - 60, 180 j + 240) and scores its centre, epochs 6j .. 6j+5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import AGGREGATORS, EPOCH_SECONDS, hash_draw, is_sleep, seconds_to_epoch

CENTRE, CONTEXT, LENGTH, CENTRE_EPOCHS = 180, 60, 300, 6


def eval_windows(epochs: DataFrame) -> DataFrame:
    """Fixed grid; a window stays when its centre holds a sleep epoch: an aggregate on epoch // 6."""
    return epochs.where(is_sleep("sleep_stage")).groupBy(
        "subject_id", F.floor(F.col("epoch_idx") / CENTRE_EPOCHS).cast("int").alias("j")).agg(
        F.count("*").alias("n_sleep")).select("subject_id", "j", F.lit(0).alias("phase"),
                                              (F.col("j") * CENTRE - CONTEXT).alias("start_sec"), "n_sleep")


def train_windows(epochs: DataFrame, nights: DataFrame, seed: int, pass_idx: int, keep: float = 1.0) -> DataFrame:
    """Grid shifted by a per-subject phase of 0-179 s; the centre lies inside the padded night and holds sleep.

    ``keep`` < 1 takes floor(keep * n) windows with the smallest draws.
    """
    from nightjar.operators.epochs import sleep_seconds
    from nightjar.operators.splits import hash_rank

    phase = F.pmod(hash_draw(F.lit(seed), F.lit(pass_idx), "subject_id"), F.lit(CENTRE)).cast("int")
    grid = F.ceil(F.col("n_epochs") / CENTRE_EPOCHS).cast("int")
    last = grid - 1 - (phase > 0).cast("int")
    w = nights.where(last >= 0).select("subject_id", phase.alias("phase"), F.explode(F.sequence(F.lit(0), last)).alias("j"))
    c0 = F.col("phase") + F.col("j") * CENTRE
    spans = w.select("subject_id", "phase", F.col("j").alias("interval_id"), c0.alias("t0"), (c0 + CENTRE).alias("t1"))
    out = sleep_seconds(spans, epochs).where("sleep_sec > 0").select(
        "subject_id", F.col("interval_id").alias("j"), "phase", (F.col("t0") - CONTEXT).alias("start_sec"), "sleep_sec")
    if keep >= 1.0:
        return out
    keyed = out.withColumn("_key", F.concat_ws("-", "subject_id", "j"))
    d = hash_rank(keyed, [], "_key", F.lit(seed), F.lit(pass_idx))
    return d.where(F.col("_rank") < F.floor(F.col("_size") * keep)).select(*out.columns)


def gather(windows: DataFrame, seconds: DataFrame, nights: DataFrame, values: list[str]) -> DataFrame:
    """Per window the 300 seconds in order: channel values, validity by position, target and loss mask.

    ``seconds`` has (subject_id, sec, values..., target, asleep), one row per second. Seconds are folded to blocks of
    LENGTH seconds; a window meets the two blocks it may reach by an equi join and picks its seconds by position. The
    sides of an exploded join look small to the planner, so nothing here is exploded by seconds.
    """
    blocks = seconds.groupBy("subject_id", F.floor(F.col("sec") / LENGTH).alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("sec", F.col("target").alias("_y"), F.col("asleep").alias("_s"), *values))).alias("_rows"))
    first, last = F.floor(F.col("start_sec") / LENGTH), F.floor((F.col("start_sec") + LENGTH - 1) / LENGTH)
    w = windows.select("subject_id", "j", "start_sec", F.explode(F.sequence(first, last)).alias("_b"))
    near = w.join(blocks.hint("shuffle_merge"), ["subject_id", "_b"], "left").groupBy("subject_id", "j", "start_sec").agg(
        F.flatten(F.sort_array(F.collect_list("_rows"))).alias("_rows"))
    d = near.join(nights.select("subject_id", (F.col("n_epochs") * EPOCH_SECONDS).alias("_n")), "subject_id").withColumn(
        "_lo", F.try_element_at("_rows", F.lit(1))["sec"]).withColumn("_hi", F.try_element_at("_rows", F.lit(-1))["sec"])

    def cell(k: Column) -> Column:
        sec = F.col("start_sec") + k
        there = F.get("_rows", (sec - F.col("_lo")).cast("int"))  # its place when no second is absent
        row = F.when((sec < F.col("_lo")) | (sec > F.col("_hi")), F.lit(None)).when(there["sec"] == sec, there).otherwise(
            F.get(F.filter("_rows", lambda x: x["sec"] == sec), F.lit(0)))
        inside = (sec >= 0) & (sec < F.col("_n"))
        return F.struct(inside.alias("valid"), row.alias("r"))

    cells = d.withColumn("_c", F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), cell))
    g = cells.select("subject_id", "j", "start_sec", F.transform("_c", lambda c: F.struct(
        c["valid"].alias("valid"), F.coalesce(c["r"]["_y"], F.lit(0)).alias("y"), (c["valid"] & (F.coalesce(c["r"]["_s"], F.lit(0)) == 1)).alias("mask"),
        *[c["r"][v].alias(v) for v in values])).alias("_c"))
    pick = lambda name: F.transform("_c", lambda s: s[name])
    return g.select("subject_id", "j", "start_sec", *[pick(v).alias(v) for v in values],
                    pick("valid").alias("valid"), pick("y").alias("y"), pick("mask").alias("mask"))


def centre_epochs(scores: DataFrame, nights: DataFrame, probs: str = "p") -> DataFrame:
    """Window scores (subject_id, j, 300 probabilities) -> (subject_id, epoch_idx, 30 probabilities)."""
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.slice(F.col(probs), CONTEXT + 1 + EPOCH_SECONDS * i, EPOCH_SECONDS).alias("sec"))
                              for i in range(CENTRE_EPOCHS)])).alias("e")
    return (
        scores.select("subject_id", "j", per)
        .select("subject_id", (F.col("j") * CENTRE_EPOCHS + F.col("e.i")).cast("int").alias("epoch_idx"), F.col("e.sec").alias("sec"))
        .join(nights, "subject_id").where(F.col("epoch_idx") < F.col("n_epochs")).drop("n_epochs")
    )


def score_epochs(scores: DataFrame, epochs: DataFrame, nights: DataFrame, probs: str = "p") -> DataFrame:
    """Four aggregates per sleep epoch; an epoch scored never or twice fails the job."""
    per = centre_epochs(scores, nights, probs).select(
        "subject_id", "epoch_idx", *[seconds_to_epoch("sec", a).alias(a) for a in AGGREGATORS])
    once = per.groupBy("subject_id", "epoch_idx").agg(F.count("*").alias("_n"), *[F.max(a).alias(a) for a in AGGREGATORS])
    key = epochs.where(is_sleep("sleep_stage")).select("subject_id", "epoch_idx", "apnoea_label")
    d = key.join(once, ["subject_id", "epoch_idx"], "left")
    ok: Column = F.coalesce(F.col("_n") == 1, F.lit(False))
    checked = F.when(ok, F.col("apnoea_label")).otherwise(F.raise_error(F.lit("sleep epoch not scored exactly once")).cast("int"))
    return d.select("subject_id", "epoch_idx", checked.alias("apnoea_label"), *AGGREGATORS)
