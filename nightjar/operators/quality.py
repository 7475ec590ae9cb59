"""Data-quality reports: parity, drift, cross-source agreement, run consistency, file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import is_sleep


def latest(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Last record per key, as one aggregate."""
    s = F.max_by(F.struct(*records.columns), F.struct(*order)).alias("_r")
    return records.groupBy(*by).agg(s).select("_r.*")


def label_parity(epochs: DataFrame, reference: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """Per subject: epoch, sleep and apnoea counts equal the reference; optionally the key rows too.

    Row equality is checked with order-free fingerprints, so nothing is sorted per subject.
    """
    asleep = is_sleep("sleep_stage")
    g = epochs.groupBy("subject_id").agg(
        F.count("*").alias("n_epochs"), F.count_if(asleep).alias("n_sleep"),
        F.coalesce(F.sum(F.when(asleep, F.col("apnoea_label"))), F.lit(0)).cast("bigint").alias("n_apnoea"))
    r = reference.select("subject_id", *[F.col(c).alias(f"_{c}") for c in ("n_epochs", "n_sleep", "n_apnoea")])
    out = g.join(r, "subject_id").select(
        "subject_id", "n_epochs", "n_sleep", "n_apnoea", (F.col("n_epochs") == F.col("_n_epochs")).alias("n_epochs_ok"),
        (F.col("n_sleep") == F.col("_n_sleep")).alias("n_sleep_ok"), (F.col("n_apnoea") == F.col("_n_apnoea")).alias("apnoea_sum_ok"))
    if key is None:
        return out
    h = F.xxhash64("epoch_idx", F.col("apnoea_label").cast("int"))
    mark = lambda d, n: d.groupBy("subject_id").agg(F.struct(F.count("*").alias("n"), F.bit_xor(h).alias("x")).alias(n))
    ours, theirs = mark(epochs.where(asleep), "_ours"), mark(key, "_key")
    return out.join(ours, "subject_id", "left").join(theirs, "subject_id", "left").withColumn(
        "key_rows_ok", F.when(F.col("_key").isNotNull(), F.col("_ours").eqNullSafe(F.col("_key")))).drop("_ours", "_key")


def cross_source_check(df: DataFrame, ours: str, theirs: str, tolerance: float = 0.05) -> DataFrame:
    """Relative error against another source and a flag above the tolerance."""
    rel = (F.col(ours) - F.col(theirs)) / F.nullif(F.col(theirs), F.lit(0.0))
    return df.withColumn("rel_error", rel).withColumn("off", F.coalesce(F.abs(rel) > tolerance, F.lit(False)))


def run_consistency(runs: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Per group whether each recorded setting has exactly one value."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *[
        (F.count_distinct(f) == 1).alias(f"one_{f}") for f in fields])


def flag_drift(records: DataFrame, recorded: str, flags: Column) -> DataFrame:
    """Records whose stored flag list differs from the flags recomputed now."""
    return records.withColumn("recomputed", F.array_join(F.array_compact(flags), ",")).where(
        ~F.col(recorded).eqNullSafe(F.col("recomputed")))


def reflag(records: DataFrame, recorded: str, flags: Column) -> DataFrame:
    """Corrected copies of the drifted records, to append to the ledger; the stale flags stay listed."""
    return flag_drift(records, recorded, flags).withColumn("stale_flags", F.col(recorded)).withColumn(
        recorded, F.col("recomputed")).drop("recomputed")


def manifest(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of every file of a ``binaryFile`` scan."""
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against a manifest."""
    e = expected.select("path", F.col("sha256").alias("want"))
    d = manifest(files).join(e, "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(
        F.col("sha256") != F.col("want"), "changed")
    return d.withColumn("state", state).where("state IS NOT NULL").select("path", "state")


def repeatability(stored: DataFrame, recompute, n: int, columns: list[str], seed: int = 42) -> DataFrame:
    """Recompute n sampled subjects with ``recompute(ids) -> DataFrame`` and diff them with the stored rows."""
    from nightjar.operators.align import KEY, frame_diff
    from nightjar.operators.splits import sample_subjects

    ids = sample_subjects(stored, n, seed)
    return frame_diff(stored.join(ids, "subject_id", "left_semi"), recompute(ids), KEY, columns)
