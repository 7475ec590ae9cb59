"""Ids and runs discovered from file names; the metrics registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECT_PATTERN = r"shhs1-(\d{6})"

# Registry column <- (extended key, basic key).
REGISTRY = {
    "model": ("model", "model"), "filter_used": ("filter_used", "filter_used"),
    "cv_auc_mean": ("cv_mean_auc", "cv_mean_auc"), "cv_auc_std": ("cv_std_auc", "cv_std_auc"),
    "test_auc": ("auc_roc", "test_auc_roc"), "test_auc_ci_low": ("auc_roc_ci_low", "test_auc_ci_low"),
    "test_auc_ci_high": ("auc_roc_ci_high", "test_auc_ci_high"), "test_auprc": ("auc_pr", "test_auc_pr"),
    "test_auprc_ci_low": ("auc_pr_ci_low", "auc_pr_ci_low"), "test_auprc_ci_high": ("auc_pr_ci_high", "auc_pr_ci_high"),
    "f1": ("f1", "test_f1_tuned"), "sens": ("sensitivity", "test_recall_tuned"), "spec": ("specificity", "specificity"),
    "precision": ("precision", "test_precision_tuned"), "balanced_acc": ("balanced_accuracy", "balanced_accuracy"),
    "brier": ("brier", "brier"), "ece": ("ece", "ece"), "ahi_mae": ("ahi_mae", "ahi_mae"), "ahi_corr": ("ahi_corr", "ahi_corr"),
    "sev_acc": ("severity_accuracy", "severity_accuracy"), "sev_kappa": ("severity_weighted_kappa", "severity_weighted_kappa"),
    "n_test_epochs": ("n_test_epochs", "n_test"), "n_test_subjects": ("n_test_subjects", "n_test_subjects"),
    "threshold": ("best_threshold", "best_threshold"), "n_optuna_trials": ("n_trials_completed", "n_trials_completed"),
}


def discover_subject_ids(spark: SparkSession, path: str, pattern: str = SUBJECT_PATTERN) -> DataFrame:
    """Sorted distinct ids from file names; only the path column is read, never the content."""
    files = spark.read.format("binaryFile").load(path).select("path")
    found = F.regexp_extract("path", pattern, 1)
    return files.select(found.alias("s")).where("s <> ''").select(F.col("s").cast("int").alias("subject_id")).distinct().orderBy("subject_id")


def discover_runs(spark: SparkSession, root: str, file_name: str, pattern: str = r"([^/]+)_seed(\d+)/") -> DataFrame:
    """Run folders that hold ``file_name``: (config, seed, path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).load(root).select("path")
    return files.select(F.regexp_extract("path", pattern, 1).alias("config"), F.regexp_extract("path", pattern, 2).alias("_s"), "path").where(
        "config <> ''").select("config", F.col("_s").cast("int").alias("seed"), "path")


def strict_json(doc: str) -> Column:
    """JSON text with the non-standard NaN and Infinity tokens turned into null."""
    return F.regexp_replace(doc, r":\s*-?(NaN|Infinity)\b", ": null")


def read_metrics(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Every ``file_name`` under the root as (run_id, date, one JSON text); underscored folders are skipped."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).option("wholetext", "true").text(root)
    base = root.rstrip("/").split(":", 1)[-1]
    run = F.regexp_extract(F.col("_metadata.file_path"), base + r"/(.*)/[^/]+$", 1)
    return d.select(run.alias("run_id"), F.date_format("_metadata.file_modification_time", "yyyy-MM-dd").alias("date"),
                    strict_json("value").alias("doc")).where(
        ~F.col("run_id").rlike("(^|/)_"))


def infer_filter(name: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Row filter of an old run: the tag of the first (pattern, tag) found in its name, else NULL."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(F.lower(name).rlike(pattern), F.lit(tag)) for pattern, tag in patterns])


def registry(basic: DataFrame, extended: DataFrame, filter_patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row per run from (run_id, date, doc) texts; extended keys win over basic ones, sorted by run.

    ``filter_patterns`` names the row filter of runs whose record does not: their owner knows the names.
    """
    b = basic.select("run_id", F.col("date").alias("_bd"), F.col("doc").alias("_b"))
    e = extended.select("run_id", F.col("date").alias("_ed"), F.col("doc").alias("_e"))
    d = b.join(e, "run_id", "full_outer")

    def key(k: str, doc: str) -> Column:
        return F.get_json_object(doc, f"$.{k}")

    def value(new: str, old: str) -> Column:
        return F.coalesce(key(new, "_e"), key(new, "_b"), key(old, "_e"), key(old, "_b"))

    text = {"model", "filter_used"}
    cols = []
    for out, (new, old) in REGISTRY.items():
        v = value(new, old)
        if out == "filter_used":
            v = F.coalesce(v, infer_filter(F.col("run_id"), filter_patterns))
        cols.append((v if out in text else v.try_cast("double")).alias(out))
    features = F.from_json(F.get_json_object("_b", "$.feature_cols"), "array<string>")
    return d.select(
        "run_id", F.coalesce("_ed", "_bd").alias("date"), *cols[:2],
        F.when(features.isNotNull(), F.size(features)).alias("n_features"), *cols[2:],
        F.when(F.col("_e").isNotNull(), "subject").otherwise("epoch").alias("ci_basis")).orderBy("run_id")
