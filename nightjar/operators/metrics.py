"""Discrimination, threshold, calibration and agreement metrics as grouped aggregates.

Every function takes ``by``: the columns that name one prediction set (run, cell, replicate, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import digitize, severity_tier
from nightjar.operators.running import join_by_value, midranks, running_totals


def linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


def score_counts(df: DataFrame, by: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(by, score) -> pos, neg: all later discrimination work runs on distinct scores."""
    w = weight if weight is not None else F.lit(1)
    y = F.col(label).cast("int")
    return df.groupBy(*by, score).agg(F.sum(F.when(y == 1, w).otherwise(w * 0)).alias("pos"),
                                      F.sum(F.when(y == 0, w).otherwise(w * 0)).alias("neg"))


def discrimination(df: DataFrame, by: list[str], label: str = "apnoea_label", score: str = "pred_prob",
                   weight: Column | None = None) -> DataFrame:
    """AUC (midrank Mann-Whitney, ties one half) and average precision; NULL for a single class."""
    r = running_totals(score_counts(df, by, label, score, weight), by, score, ["pos", "neg"])
    p, n = F.max("pos_total"), F.max("neg_total")
    hits = F.col("pos_total") - F.col("pos_before")
    seen = hits + F.col("neg_total") - F.col("neg_before")
    return r.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)), (p * n).cast("double")).alias("auc"),
        F.when((p > 0) & (n > 0), F.sum(F.col("pos") * hits / seen) / p).alias("average_precision"),
        p.alias("n_pos"), n.alias("n_neg"))


def confusion(df: DataFrame, by: list[str], label: str = "apnoea_label", pred: str = "pred_label") -> DataFrame:
    """Binary confusion counts and the ratios derived from them."""
    y, h = F.col(label).cast("int"), F.col(pred).cast("int")
    g = df.groupBy(*by).agg(
        F.sum(((y == 0) & (h == 0)).cast("int")).alias("tn"), F.sum(((y == 0) & (h == 1)).cast("int")).alias("fp"),
        F.sum(((y == 1) & (h == 0)).cast("int")).alias("fn"), F.sum(((y == 1) & (h == 1)).cast("int")).alias("tp"))
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return g.select(
        *by, "tn", "fp", "fn", "tp", sens.alias("sensitivity"), spec.alias("specificity"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
        ((sens + spec) / 2).alias("balanced_accuracy"))


def threshold_f1max(df: DataFrame, by: list[str], label: str = "apnoea_label", score: str = "pred_prob",
                    grid: list[float] | None = None) -> DataFrame:
    """Threshold with the largest F1 of ``score > t`` over the grid; the first maximum wins.

    Each row is reduced to how many grid thresholds lie strictly below it, so the search runs on at
    most len(grid) + 1 rows per group.
    """
    grid = grid or linspace(0.05, 0.95, 91)
    edges = F.array(*[F.lit(t) for t in grid])
    bin_ = F.size(F.filter(edges, lambda t: t < F.col(score)))
    y = F.col(label).cast("int")
    h = df.groupBy(*by, bin_.alias("_bin")).agg(F.sum((y == 1).cast("int")).alias("_p"), F.count("*").alias("_n"))
    tot = h.groupBy(*by).agg(F.sum("_p").alias("_P"), F.collect_list(F.struct("_bin", "_p", "_n")).alias("_h"))

    def above(i: Column, field: str) -> Column:
        return F.aggregate(F.filter("_h", lambda x: x["_bin"] > i), F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])

    scored = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.struct(
        F.coalesce(F.try_divide(2.0 * above(i, "_p"), above(i, "_n") + F.col("_P")), F.lit(0.0)).alias("f1"),
        (-i).alias("neg_i")))
    best = F.array_max(scored)
    return tot.withColumn("_best", best).select(
        *by, F.element_at(edges, 1 - F.col("_best.neg_i")).alias("threshold"), F.col("_best.f1").alias("f1"))


def choose_aggregator(aucs: DataFrame, tie: float = 0.002) -> DataFrame:
    """``mean`` when its AUC is within ``tie`` of the best (name, auc) row, else the best one."""
    best = aucs.where("auc IS NOT NULL").agg(
        F.max_by("name", F.struct("auc", F.col("name") == "mean")).alias("best"), F.max("auc").alias("best_auc"),
        F.max(F.when(F.col("name") == "mean", F.col("auc"))).alias("mean_auc"))
    return best.withColumn("chosen", F.when(F.col("mean_auc") >= F.col("best_auc") - tie, "mean").otherwise(F.col("best")))


# ---- calibration ------------------------------------------------------------------------------

def subject_bins(df: DataFrame, by: list[str], edges: Column | list[float], label: str = "apnoea_label",
                 score: str = "pred_prob") -> DataFrame:
    """Sufficient statistics per (by, subject, bin); bin = number of interior edges at or below the score."""
    if isinstance(edges, list):
        bin_ = digitize(score, edges)
    else:
        bin_ = F.size(F.filter(edges, lambda e: e <= F.col(score)))
    y, p = F.col(label).cast("double"), F.col(score)
    return df.groupBy(*by, "subject_id", bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(y).alias("sum_y"), F.sum(p).alias("sum_p"), F.sum((p - y) * (p - y)).alias("sum_sq"))


def calibration_summary(bins: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """ECE, Brier, Brier skill and calibration in the large from per-bin sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    per = bins.groupBy(*by, "bin").agg(*[F.sum(F.col(c) * w).alias(c) for c in ("n", "sum_y", "sum_p", "sum_sq")])
    n = F.sum("n")
    prev, brier = F.sum("sum_y") / n, F.sum("sum_sq") / n
    return per.groupBy(*by).agg(
        (F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))) / n).alias("ece"), brier.alias("brier"),
        (F.lit(1.0) - F.try_divide(brier, prev * (1 - prev))).alias("brier_skill"),
        (F.sum("sum_p") / n - prev).alias("citl"), prev.alias("prevalence"), (F.sum("sum_p") / n).alias("mean_predicted"))


def reliability_curve(df: DataFrame, by: list[str], label: str = "apnoea_label", score: str = "pred_prob") -> DataFrame:
    edges = linspace(0.0, 1.0, 11)[1:-1]
    return df.groupBy(*by, digitize(score, edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("observed"))


# ---- per-subject event rates and tiers --------------------------------------------------------

def event_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Per subject: epochs, labelled and predicted apnoea epochs and both per hour."""
    hours = F.count("*") * 30 / 3600.0
    return df.groupBy(*by, "subject_id").agg(
        F.count("apnoea_label").alias("n_epochs"), F.sum(F.col("apnoea_label").cast("bigint")).alias("n_apnoea_gt"),
        F.sum(F.col("pred_label").cast("bigint")).alias("n_apnoea_pred"),
        (F.sum("apnoea_label") / hours).alias("ahi_proxy_gt"), (F.sum("pred_label") / hours).alias("ahi_proxy_pred"))


def tier_crosstab(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """4 x 4 tier table in long form with absent cells as zero."""
    counts = df.groupBy(*by, severity_tier(truth).alias("true_tier"), severity_tier(pred).alias("pred_tier")).agg(
        F.count("*").alias("n")).where("true_tier IS NOT NULL AND pred_tier IS NOT NULL")
    wide = counts.groupBy(*by, "true_tier").pivot("pred_tier", [0, 1, 2, 3]).agg(F.sum("n"))
    tiers = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("true_tier")
    spine = counts.select(*by, tiers).distinct()
    out = spine.join(wide, [*by, "true_tier"], "left").fillna(0)
    return out.select(*by, "true_tier", *[F.col(str(i)).alias(f"pred_{i}") for i in range(4)])


def quadratic_kappa(counts: DataFrame, by: list[str], a: str, b: str, n: str = "n", k: int = 4) -> DataFrame:
    """Quadratic-weighted kappa from (by, a, b, n) counts.

    The expected disagreement sum_ij w_ij r_i c_j / N needs only first and second moments:
    sum (i - j)^2 r_i c_j = N (sum i^2 r_i + sum j^2 c_j) - 2 (sum i r_i)(sum j c_j).
    """
    x, y, w = F.col(a).cast("double"), F.col(b).cast("double"), F.col(n)
    total = F.sum(w)
    observed = F.sum(w * (x - y) * (x - y))
    expected = (F.sum(w * x * x) + F.sum(w * y * y)) - 2 * F.sum(w * x) * F.sum(w * y) / total
    return counts.groupBy(*by).agg((F.lit(1.0) - F.try_divide(observed, expected)).alias("kappa"))


def multiclass_metrics(counts: DataFrame, by: list[str], classes: list) -> DataFrame:
    """Accuracy, Cohen kappa, per-class and macro F1 from (by, true, pred, n) counts."""
    t, p, n = F.col("true"), F.col("pred"), F.col("n")
    aggs = [F.sum(n).alias("_n"), F.sum(F.when(t == p, n).otherwise(0)).alias("_d")]
    for i, c in enumerate(classes):
        aggs += [F.sum(F.when(t == c, n).otherwise(0)).alias(f"_r{i}"), F.sum(F.when(p == c, n).otherwise(0)).alias(f"_c{i}"),
                 F.sum(F.when((t == c) & (p == c), n).otherwise(0)).alias(f"_d{i}")]
    g = counts.groupBy(*by).agg(*aggs)
    po = F.col("_d") / F.col("_n")
    pe = sum((F.col(f"_r{i}") * F.col(f"_c{i}") for i in range(len(classes))), F.lit(0)) / (F.col("_n") * F.col("_n"))
    f1 = [F.try_divide(2.0 * F.col(f"_d{i}"), F.col(f"_r{i}") + F.col(f"_c{i}")) for i in range(len(classes))]
    seen = sum((x.isNotNull().cast("int") for x in f1), F.lit(0))
    macro = sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)) / seen
    return g.select(*by, po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), macro.alias("macro_f1"),
                    *[x.alias(f"f1_{c}") for x, c in zip(f1, classes)])


# ---- agreement of two per-subject measurements ------------------------------------------------

def bland_altman(df: DataFrame, est: str, ref: str) -> DataFrame:
    """Pair mean and difference rows."""
    return df.where(F.col(est).isNotNull() & F.col(ref).isNotNull()).select(
        "*", ((F.col(est) + F.col(ref)) / 2).alias("pair_mean"), (F.col(est) - F.col(ref)).alias("diff"))


def icc_a1(x: Column, y: Column) -> Column:
    """ICC(A,1) in one aggregate: two-way random effects, absolute agreement, single measurement.

    With two measurements the mean squares are variances of the pair's mean and difference, which Spark
    accumulates around their running means: a large common offset costs no digits.
    """
    n = F.count(x + y)
    rows = 2 * F.var_samp((x + y) / 2)
    error = F.var_samp(x - y) / 2
    columns = n * F.avg(x - y) * F.avg(x - y) / 2
    return F.try_divide(rows - error, rows + error + (columns - error) * 2 / n)


def agreement(df: DataFrame, by: list[str], est: str, ref: str) -> DataFrame:
    """MAE, bias, limits, Pearson, Spearman, ICC, tier accuracy and kappa of est against ref."""
    d = df.where(F.col(est).isNotNull() & F.col(ref).isNotNull()).select(
        *by, F.col(est).cast("double").alias("x"), F.col(ref).cast("double").alias("y"))
    rx = midranks(d, by, "x", "rx").select(*by, "x", "rx", "n")
    ry = midranks(d, by, "y", "ry").select(*by, "y", "ry", "n")
    ranked = join_by_value(join_by_value(d, rx, [*by, "x"], "n"), ry, [*by, "y"], "n")
    diff = F.col("x") - F.col("y")
    sd = F.stddev_samp(diff)
    tx, ty = severity_tier("x"), severity_tier("y")
    main = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"),
        (F.avg(diff) - 1.96 * sd).alias("loa_low"), (F.avg(diff) + 1.96 * sd).alias("loa_high"),
        F.corr("x", "y").alias("pearson_r"), F.corr("rx", "ry").alias("spearman_rho"),
        icc_a1(F.col("x"), F.col("y")).alias("icc_a1"),
        F.avg((tx == ty).cast("double")).alias("severity_accuracy"))
    cells = d.groupBy(*by, tx.alias("a"), ty.alias("b")).agg(F.count("*").alias("n"))
    kappa = quadratic_kappa(cells, by, "a", "b").withColumnRenamed("kappa", "severity_quadratic_kappa")
    if by:
        return main.join(kappa, by)
    return main.withColumn("severity_quadratic_kappa", kappa.scalar())


def null_fraction(df: DataFrame, by: str, value: str) -> DataFrame:
    """Share of missing values per group."""
    return df.groupBy(by).agg(F.avg(F.col(value).isNull().cast("double")).alias("null_fraction"))


def null_fraction_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Distribution of the per-group missing share: mean, median, 90th percentile, max, counts above 0.2 and 0.5."""
    from nightjar.operators.running import grouped_quantiles

    f = null_fraction(df, by, value).withColumn("_all", F.lit(1))
    q = grouped_quantiles(f, ["_all"], "null_fraction", {"median": 0.5, "p90": 0.9}).drop("n_values")
    x = F.col("null_fraction")
    return f.groupBy("_all").agg(
        F.count("*").alias("n_subjects"), F.avg(x).alias("mean"), F.max(x).alias("max"),
        F.sum((x > 0.2).cast("int")).alias("n_gt_0_2"), F.sum((x > 0.5).cast("int")).alias("n_gt_0_5")).join(q, "_all").drop("_all")


def seed_mean_sd(long: DataFrame, n_seeds: int) -> DataFrame:
    """(seed, key, value) -> mean and sample SD of the keys every seed reports."""
    return long.where("value IS NOT NULL").groupBy("key").agg(
        F.count_distinct("seed").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where(
        F.col("n") == n_seeds)


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value)


#: Names of the severity tiers.
TIER_NAMES = ("none", "mild", "moderate", "severe")
#: The six cuts of an error anatomy.
ANATOMY_CUTS = ("sleep_stage", "severity_tier", "event_duration", "event_type", "desat_depth", "position")


def anatomy_cells(context: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per epoch the cell of each of the six cuts: (subject_id, epoch_idx, ANATOMY_CUTS).

    ``context`` has sleep_stage, event_duration_s, event_kind, desat_depth and position per epoch, ``subjects`` the reference
    index ahi_a0h3a per subject. Durations are cut at 20 and 40 s and depths at 6 and 9 %, closed on the left. Epochs outside an
    event have no duration and no kind; those without a desaturation are a cell of their own. A subject without a
    reference has no tier.
    """
    d, depth = F.col("event_duration_s"), F.col("desat_depth")
    tier = F.element_at(F.array(*map(F.lit, TIER_NAMES)), severity_tier("ahi_a0h3a").cast("int") + 1)
    kind = F.when(F.col("event_kind") != "", F.col("event_kind"))
    posture = F.when(F.col("position").isin("supine", "unknown"), F.col("position")).otherwise(F.lit("non-supine"))
    tiers = subjects.where("ahi_a0h3a IS NOT NULL").select("subject_id", tier.alias("severity_tier"))
    return context.join(tiers, "subject_id", "left").select(
        "subject_id", "epoch_idx", "sleep_stage", "severity_tier",
        F.when(d >= 40, "long >=40 s").when(d >= 20, "medium 20-40 s").when(d >= 0, "short <20 s").alias("event_duration"),
        kind.alias("event_type"),
        F.when(depth >= 9, ">=9 %").when(depth >= 6, "6-9 %").when(depth.isNotNull(), "<6 %").otherwise("no desat").alias("desat_depth"),
        posture.alias("position"))


def error_anatomy(df: DataFrame, cuts: list[str], runs: list[str]) -> DataFrame:
    """Per (cut, cell, run): sizes, sensitivity, specificity and AUC where both classes have 20 rows.

    ``df`` has one row per (run, epoch) with the cut columns; the cuts are stacked to long form once.
    """
    long = df.where(F.col("run").isin(*runs)).unpivot(
        ["run", "subject_id", "apnoea_label", "pred_prob", "pred_label"], cuts, "cut", "cell").where("cell IS NOT NULL")
    by = ["cut", "cell", "run"]
    y, h = F.col("apnoea_label"), F.col("pred_label").cast("double")
    base = long.groupBy(*by).agg(
        F.count("*").alias("n_epochs"), F.sum(y.cast("bigint")).alias("n_pos"), F.count_distinct("subject_id").alias("n_subjects"),
        F.avg(F.when(y == 1, h)).alias("sens"), (F.lit(1.0) - F.avg(F.when(y == 0, h))).alias("spec"))
    auc = discrimination(long, by).select(*by, "auc")
    enough = (F.col("n_pos") >= 20) & (F.col("n_pos") <= F.col("n_epochs") - 20)
    return base.join(auc, by).withColumn("auc", F.when(enough, F.col("auc")))
