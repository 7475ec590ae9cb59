"""Whole-run evaluation: event indices, the extended metric record, run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import severity_tier, subject_number
from nightjar.operators import metrics as M
from nightjar.operators import resample as R
from nightjar.operators.epochs import count_runs, sleep_event_counts
from nightjar.session import cut_lineage


def event_indices(pred: DataFrame, epochs: DataFrame, events: DataFrame) -> DataFrame:
    """Per subject events per hour by epoch count and by run collapse, predicted, labelled and scored."""
    hours = F.count("*") * 30 / 3600.0
    base = pred.groupBy("subject_id").agg(hours.alias("tst_h"), (F.sum("pred_label") / hours).alias("epoch_pred"),
                                          (F.sum("apnoea_label") / hours).alias("epoch_true"))
    rp = count_runs(pred, F.col("pred_label") == 1, ["subject_id"], "_rp")
    rt = count_runs(pred, F.col("apnoea_label") == 1, ["subject_id"], "_rt")
    ev = sleep_event_counts(epochs, events).select("subject_id", "n_sleep_events")
    d = base.join(rp, "subject_id", "left").join(rt, "subject_id", "left").join(ev, "subject_id", "left")
    zero = F.lit(0)
    return d.select("subject_id", "tst_h", "epoch_pred", (F.coalesce("_rp", zero) / F.col("tst_h")).alias("run_pred"), "epoch_true",
                    (F.coalesce("_rt", zero) / F.col("tst_h")).alias("run_true"), (F.col("n_sleep_events") / F.col("tst_h")).alias("xml_ahi"))


#: Estimators of an event index and the references they are held against.
ESTIMATORS = ("run_pred", "epoch_pred", "run_true", "epoch_true")
REFERENCES = ("xml_ahi", "rdi0p", "ahi_a0h3a", "ahi_a0h4")
#: Pairs whose agreement says how far the reference definitions lie apart, whatever the model.
GAPS = (("xml_ahi", "rdi0p"), ("xml_ahi", "ahi_a0h3a"), ("run_true", "xml_ahi"))


def event_index_table(per: DataFrame, by: list[str], estimators: tuple = ESTIMATORS, references: tuple = REFERENCES) -> DataFrame:
    """Agreement of every estimator with every reference, one row per (by, estimator, reference).

    ``per`` has one row per (by, subject) with a column for each; a subject without one of the two is left out of that
    pair. Subjects are stacked once, all pairs are one aggregate.
    """
    keep = [*by, "subject_id"]
    one = per.unpivot([*keep, *references], list(estimators), "estimator", "x")
    long = one.unpivot([*keep, "estimator", "x"], list(references), "reference", "y")
    return M.agreement(long, [*by, "estimator", "reference"], "x", "y")


def reference_gaps(per: DataFrame, references: tuple = REFERENCES, gaps: tuple = GAPS) -> DataFrame:
    """(kind, estimator, reference, median, and the agreement columns): the median of each reference, then the agreement of the ``gaps``.

    ``per`` has one row per subject; a model plays no part.
    """
    from nightjar.operators.running import grouped_quantiles, union_all

    long = per.unpivot(["subject_id"], list(references), "reference", "y").where("y IS NOT NULL")
    medians = grouped_quantiles(long, ["reference"], "y", {"median": 0.5}).select(F.lit("median").alias("kind"), "reference", "median")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("estimator"), F.lit(b).alias("reference"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in gaps]))
    apart = M.agreement(per.select(pairs.alias("g")).select("g.*"), ["estimator", "reference"], "x", "y").withColumn("kind", F.lit("gap"))
    return union_all([medians, apart])


def extended_metrics(pred: DataFrame, metadata: DataFrame | None, n_boot: int = 1000, seed: int = 42,
                     min_clinical: int = 10, by: list[str] | None = None) -> DataFrame:
    """The full metric record, one row per prediction set, with notes for absent metrics.

    ``metadata`` carries subject_id (number or prefixed text) and ahi_a0h3a; ``by`` names the sets
    (for example the run), which share the same subject resamples.
    """
    p = pred if by else pred.withColumn("_k", F.lit(1))
    by = by or ["_k"]
    main = M.discrimination(p, by).select(*by, F.col("auc").alias("auc_roc"), F.col("average_precision").alias("auc_pr"))
    weights = R.boot_weights(pred.select("subject_id").distinct(), n_boot, seed)
    boots = R.replicate_discrimination(p, weights, n_boot, by)
    q = F.array(F.lit(0.025), F.lit(0.975))
    ci = boots.groupBy(*by).agg(F.percentile("auc", q).alias("_r"), F.percentile("average_precision", q).alias("_p")).select(
        *by, F.col("_r")[0].alias("auc_roc_ci_low"), F.col("_r")[1].alias("auc_roc_ci_high"),
        F.col("_p")[0].alias("auc_pr_ci_low"), F.col("_p")[1].alias("auc_pr_ci_high"))
    conf = M.confusion(p, by).drop("tn", "fp", "fn", "tp")
    cal = M.calibration_summary(M.subject_bins(p, by, M.linspace(0.0, 1.0, 11)[1:-1]), by).select(*by, "brier", "ece")
    rates = cut_lineage(M.event_rates(p, by))  # one row per set and subject
    size = rates.groupBy(*by).agg(F.sum("n_epochs").alias("n_test_epochs"), F.count("*").alias("n_test_subjects"))
    out = main.join(ci, by).join(conf, by).join(cal, by).join(size, by)
    clinical = ["ahi_mae", "ahi_corr", "severity_accuracy", "severity_weighted_kappa"]
    if metadata is None:
        out = out.withColumns({c: F.lit(None).cast("double") for c in clinical}).withColumn(
            "n_subjects_with_nsrr_ahi", F.lit(None).cast("bigint"))
    else:
        meta = metadata.select(subject_number("subject_id").alias("subject_id"), F.col("ahi_a0h3a").cast("double").alias("ref")).where("ref IS NOT NULL")
        s = rates.join(meta, "subject_id")
        tp, tr = severity_tier("ahi_proxy_pred"), severity_tier("ref")
        kappa = M.quadratic_kappa(s.groupBy(*by, tr.alias("a"), tp.alias("b")).agg(F.count("*").alias("n")), by, "a", "b")
        c = s.groupBy(*by).agg(
            F.count("*").alias("n_subjects_with_nsrr_ahi"), F.avg(F.abs(F.col("ahi_proxy_pred") - F.col("ref"))).alias("ahi_mae"),
            F.corr("ahi_proxy_pred", "ref").alias("ahi_corr"), F.avg((tp == tr).cast("double")).alias("severity_accuracy")).join(
            kappa.withColumnRenamed("kappa", "severity_weighted_kappa"), by)
        out = out.join(c, by, "left").fillna(0, ["n_subjects_with_nsrr_ahi"])
        enough = F.col("n_subjects_with_nsrr_ahi") >= min_clinical
        out = out.withColumns({k: F.when(enough, F.col(k)) for k in clinical})
    empty = F.create_map().cast("map<string,string>")
    notes = F.map_concat(
        F.create_map(F.lit("calibration"), F.lit("Brier and ECE on raw model output")),
        F.when(F.col("ahi_mae").isNull(), F.create_map(F.lit("clinical"), F.lit("too few subjects with a reference index")))
        .otherwise(F.create_map(F.lit("ahi_mae"), F.lit("epoch-overlap proxy, counts every epoch of a long event"))),
        F.when(F.col("balanced_accuracy").isNull(), F.create_map(F.lit("balanced_accuracy"), F.lit("a class is absent"))).otherwise(empty))
    return out.withColumn("metric_notes", notes).drop("_k")


def anatomy_deltas(cells: DataFrame, a: str, b: str, n_boot: int, seed: int = 42) -> DataFrame:
    """Paired AUC difference of two runs inside every (cut, cell) on shared subject resamples.

    ``cells`` is in long form: (cut, cell, run) plus the prediction columns. Resamples that leave a
    cell with a single class are dropped, cells without 20 rows of each class are not tested.
    """
    by = ["cut", "cell"]
    d = cut_lineage(cells.where(F.col("run").isin(a, b)))
    size = d.where(F.col("run") == a).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("apnoea_label").cast("bigint")).alias("n_pos"))
    tested = d.join(size.where((F.col("n_pos") >= 20) & (F.col("n_pos") <= F.col("n") - 20)).select(*by), by, "left_semi")
    weights = R.boot_weights(cells.select("subject_id").distinct(), n_boot, seed)
    boots = cut_lineage(R.replicate_discrimination(tested, weights, n_boot, [*by, "run"]))
    return R.paired_delta(boots.where(F.col("run") == a), boots.where(F.col("run") == b), by, convention="capped")


def compare_runs(runs: DataFrame, pairs: list[tuple[str, str]], n_boot: int, seed: int = 42,
                 convention: str = "uncapped") -> DataFrame:
    """Paired bootstrap of the AUC for each (a, b) pair of run names on shared resamples.

    ``runs`` holds the prediction columns plus ``run``. Pairs that name an absent run yield no row.
    """
    spark = runs.sparkSession
    weights = R.boot_weights(runs.select("subject_id").distinct(), n_boot, seed)
    # runs x replicates rows, read once per side of every pair
    boots = cut_lineage(R.replicate_discrimination(runs, weights, n_boot, ["run"]))
    point = M.discrimination(runs, ["run"]).select("run", F.col("auc").alias("point"))
    names = spark.createDataFrame(pairs, "a string, b string")
    left = names.join(boots, names.a == boots.run).select("a", "b", "replicate", "auc")
    right = names.join(boots, names.b == boots.run).select("a", "b", "replicate", "auc")
    delta = R.paired_delta(left, right, ["a", "b"], convention=convention)
    pa = point.select(F.col("run").alias("a"), F.col("point").alias("auc_a"))
    pb = point.select(F.col("run").alias("b"), F.col("point").alias("auc_b"))
    return delta.join(pa, "a").join(pb, "b").withColumn("delta_point", F.col("auc_a") - F.col("auc_b"))
