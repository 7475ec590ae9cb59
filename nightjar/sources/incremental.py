"""Which subjects to (re)process: versions, batches, coverage and the attempt ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.operators.quality import latest

PARTS = ["val", "test", "train"]
GATED = ("val", "test")


def stale_subjects(ids: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Ids without output of the current version."""
    return ids.join(done.where(F.col("features_version") == version).select("subject_id").distinct(), "subject_id", "left_anti")


def version_histogram(done: DataFrame) -> DataFrame:
    """Subjects per stored features version, most common first."""
    return done.groupBy("features_version").agg(F.count_distinct("subject_id").alias("n_subjects")).orderBy(
        F.desc("n_subjects"), "features_version")


def next_batch(ids: DataFrame, done: DataFrame, start: int, n: int) -> DataFrame:
    """The first n unprocessed ids from ``start`` on (top-k, no full sort)."""
    return ids.where(F.col("subject_id") >= start).join(done.select("subject_id").distinct(), "subject_id", "left_anti").orderBy(
        "subject_id").limit(n)


def pilot_subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Restrict to a fixed id list; Spark broadcasts the list when its size allows."""
    return df.join(ids.select("subject_id").distinct(), "subject_id", "left_semi")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; torn lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def latest_attempts(ledger: DataFrame) -> DataFrame:
    """Last attempt per subject."""
    return latest(ledger.where("subject_id IS NOT NULL"), ["subject_id"], ["ts"])


def subject_states(split: DataFrame, files: DataFrame, cached: DataFrame, last: DataFrame, transient: list[str],
                   retry_failed: bool = False) -> DataFrame:
    """Each subject's state: cached, file missing, failed before, automatic retry, or to do."""
    d = (
        split.join(cached.select("subject_id", F.lit(True).alias("_cached")), "subject_id", "left")
        .join(files.select("subject_id", F.lit(True).alias("_file")), "subject_id", "left")
        .join(last.select("subject_id", "status", "error_type"), "subject_id", "left")
    )
    failed = (F.col("status") == "failed") & F.lit(not retry_failed)
    retry = failed & F.col("part").isin(*GATED) & F.col("error_type").isin(*transient)
    state = F.when(F.col("_cached"), "cached").when(F.col("_file").isNull(), "file_missing").when(
        retry, "todo_transient_auto_retry").when(failed, "failed_before_skipped").otherwise("todo")
    return d.select("subject_id", "part", state.alias("state"))


def ingest_status(split: DataFrame, files: DataFrame, cached: DataFrame, last: DataFrame, transient: list[str]) -> DataFrame:
    """State by split counts."""
    s = subject_states(split, files, cached, last, transient)
    return s.groupBy("state").pivot("part", PARTS).count().fillna(0)


def gated_incomplete(states: DataFrame) -> DataFrame:
    """Validation and test subjects that block a complete run."""
    return states.where(F.col("part").isin(*GATED) & F.col("state").isin("file_missing", "failed_before_skipped"))
