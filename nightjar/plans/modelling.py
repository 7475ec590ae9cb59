"""Split, fit, threshold, predict and compare: the ablation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import is_sleep
from nightjar.operators import fitting as FT
from nightjar.operators import metrics as M
from nightjar.operators.epochs import trim_window
from nightjar.operators.columns import of_kind, select_features
from nightjar.operators.running import union_all
from nightjar.operators.splits import group_split
from nightjar.session import cut_lineage


MODES = {"full": of_kind("aasm", "physio", "unknown"), "physio_only": of_kind("physio", "unknown"), "aasm_only": of_kind("aasm")}


def prepare(rows: DataFrame, seed: int = 42, sleep_only: bool = True) -> DataFrame:
    """Rows with their split part, written once for all fits of an analysis."""
    d = rows.where(is_sleep("sleep_stage")) if sleep_only else rows
    return cut_lineage(d.join(group_split(d, seed=seed), "subject_id"))


def fit_and_score(prepared: DataFrame, columns: list[str], family: str, categorical: list[str] | None = None,
                  **options) -> DataFrame:
    """Test predictions of one model: weighted fit on the training subjects, validation subjects held
    out for early stopping (boosted trees) and for the F1 threshold."""
    fit_rows = prepared.where("part <> 'test'").withColumn("is_val", F.col("part") == "val")
    validation = "is_val" if family == "boosted" else None
    train = fit_rows if validation else fit_rows.where("NOT is_val")
    model = FT.fit_binary(train, columns, family=family, categorical=categorical, validation=validation, **options)
    keep = ["subject_id", "epoch_idx", "apnoea_label", "part"]
    scored = cut_lineage(FT.predict(model, prepared.where("part <> 'train'"), keep))
    best = M.threshold_f1max(scored.where("part = 'val'"), []).select("threshold").scalar()
    return scored.where("part = 'test'").drop("part").withColumn(
        "pred_label", (F.col("pred_prob") > F.coalesce(best, F.lit(0.5))).cast("bigint"))


def ablation(rows: DataFrame, modes: list[str], families: list[str], seed: int = 42, **options) -> DataFrame:
    """Same split, every feature mode by every family: one comparison row each."""
    prepared = prepare(rows, seed)
    scored = []
    for mode in modes:
        columns = select_features(rows.columns, MODES[mode])
        for family in families:
            run = fit_and_score(prepared, columns, family, **options)
            scored.append(run.withColumn("run", F.lit(f"{mode}/{family}")).withColumn("n_features", F.lit(len(columns))))
    allp = cut_lineage(union_all(scored))
    auc = M.discrimination(allp, ["run", "n_features"]).select("run", "n_features", "auc", "average_precision")
    return auc.join(M.confusion(allp, ["run"]).select("run", "f1", "sensitivity", "specificity"), "run").orderBy("run")


def staging(rows: DataFrame, columns: list[str], label: str, n_classes: int, seed: int = 42, **options) -> DataFrame:
    """Multiclass fit on the training subjects, per-subject confusion counts of the test subjects."""
    d = cut_lineage(rows.join(group_split(rows, seed=seed), "subject_id"))
    model = FT.fit_multiclass(d.where("part = 'train'"), columns, label, **options)
    p = FT.predict_classes(model, d.where("part = 'test'"), ["subject_id", label], n_classes)
    return p.groupBy("subject_id", F.col(label).cast("int").alias("true"), "pred").agg(F.count("*").alias("n"))


def staging_windows(rows: DataFrame, columns: list[str], label: str, n_classes: int, seed: int = 42, margin: int = 60, **options) -> DataFrame:
    """As ``staging``, fitted on the in-bed window of the training subjects and scored on two windows of the
    test subjects: the in-bed one and the whole scored night."""
    d = cut_lineage(rows.join(group_split(rows.select("subject_id").distinct(), seed=seed), "subject_id"))
    bed = trim_window(d, margin)
    model = FT.fit_multiclass(bed.where("part = 'train'"), columns, label, **options)
    scored = []
    for name, window in (("in_bed", bed), ("whole_night", trim_window(d, margin, whole_night=True))):
        p = FT.predict_classes(model, window.where("part = 'test'"), ["subject_id", label], n_classes)
        scored.append(p.groupBy("subject_id", F.col(label).cast("int").alias("true"), "pred").agg(F.count("*").alias("n")).withColumn("window", F.lit(name)))
    return union_all(scored)
