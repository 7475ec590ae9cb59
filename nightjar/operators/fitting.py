"""Model fitting with pyspark.ml: assembling, imputation, classifiers, folds, calibration line."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.expressions import logit
from nightjar.operators.imputing import chained_impute, exact_medians  # noqa: F401 (the imputer is part of this module's interface)
from nightjar.operators.running import dealt
from nightjar.session import cut_lineage

MEDIANS = 64  # medians sought in the same passes; a task holds about a megabyte of counters for each


def calibration_lines(pred: DataFrame, by: list[str], label: str = "apnoea_label", score: str = "pred_prob", iterations: int = 15) -> DataFrame:
    """Per group the unpenalised logistic fit of the label on the logit of the score: (by, calibration_slope, calibration_intercept, n_rows).

    Rows fold to (group, score) cells once. Newton's method runs for all groups side by side, from slope 1 and
    intercept 0, a fixed number of times: an iteration is one aggregate of five sums over the cells. A group of one class,
    of one score, or whose last step still moves gets no line.
    """
    d = pred.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = cut_lineage(d.groupBy(*by, logit(score).alias("_x")).agg(F.count("*").cast("double").alias("_n"), F.sum(F.col(label).cast("double")).alias("_y")))
    fit = cut_lineage(cells.groupBy(*by).agg(F.lit(0.0).alias("_a"), F.lit(1.0).alias("_b"), F.lit(0.0).alias("_step"),
                                             F.sum("_n").alias("_all"), F.sum("_y").alias("_ones")).where("_ones > 0 AND _ones < _all"))
    x, n = F.col("_x"), F.col("_n")
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_a") + F.col("_b") * x))))
    kept = [*by, "_a", "_b", "_all", "_ones"]
    for _ in range(iterations):
        sums = cells.join(fit, by).withColumn("_p", p).withColumn("_w", n * F.col("_p") * (1 - F.col("_p"))).withColumn("_r", F.col("_y") - n * F.col("_p"))
        sums = sums.groupBy(*kept).agg(F.sum("_r").alias("_g"), F.sum(F.col("_r") * x).alias("_gx"), F.sum("_w").alias("_w"),
                                       F.sum(F.col("_w") * x).alias("_wx"), F.sum(F.col("_w") * x * x).alias("_wxx"))
        spread = F.col("_w") * F.col("_wxx") - F.col("_wx") * F.col("_wx")
        det = F.when(spread > 1e-12 * F.col("_w") * F.col("_wxx"), spread)  # of a single score only rounding is left
        steps = sums.withColumns({"_da": F.try_divide(F.col("_wxx") * F.col("_g") - F.col("_wx") * F.col("_gx"), det),
                                  "_db": F.try_divide(F.col("_w") * F.col("_gx") - F.col("_wx") * F.col("_g"), det)})
        fit = cut_lineage(steps.select(*by, (F.col("_a") + F.col("_da")).alias("_a"), (F.col("_b") + F.col("_db")).alias("_b"),
                                       (F.abs("_da") + F.abs("_db")).alias("_step"), "_all", "_ones"))
    found = fit.where("_step < 1e-6 AND NOT isnan(_step)").select(*by, F.col("_b").alias("calibration_slope"), F.col("_a").alias("calibration_intercept"))
    return cells.groupBy(*by).agg(F.sum("_n").cast("bigint").alias("n_rows")).join(found, by, "left").select(*by, "calibration_slope", "calibration_intercept", "n_rows")


def calibration_line(pred: DataFrame, label: str = "apnoea_label", score: str = "pred_prob") -> DataFrame:
    """The one line of all rows."""
    return calibration_lines(pred.withColumn("_k", F.lit(1)), ["_k"], label, score).select("calibration_slope", "calibration_intercept")


def ensemble(runs: DataFrame, cv_auc: dict[str, float], scale: float = 50.0) -> DataFrame:
    """Mean, softmax-weighted mean and mean rank share of aligned runs (columns run, keys, pred_prob).

    Runs become columns by a conditional aggregate on the row key; a row missing from a run has no
    ensemble score.
    """
    from nightjar.operators.running import join_by_value, midranks

    names = list(cv_auc)
    centre = sum(cv_auc.values()) / len(names)
    raw = {n: math.exp((a - centre) * scale) for n, a in cv_auc.items()}
    weights = {n: w / sum(raw.values()) for n, w in raw.items()}
    d = runs.where(F.col("run").isin(*names))
    ranks = midranks(d, ["run"], "pred_prob", "_mid").select("run", "pred_prob", (F.col("_mid") / F.col("n_total")).alias("_rank"), "n")
    wide = join_by_value(d, ranks, ["run", "pred_prob"], "n").groupBy("subject_id", "epoch_idx").agg(
        F.max("apnoea_label").alias("apnoea_label"), F.count("*").alias("_n"),
        *[F.max(F.when(F.col("run") == n, F.col("pred_prob"))).alias(f"_p_{n}") for n in names],
        *[F.max(F.when(F.col("run") == n, F.col("_rank"))).alias(f"_r_{n}") for n in names])

    def total(fmt: str, w: dict[str, float]):
        out = F.lit(0.0)
        for n in names:
            out = out + F.lit(w[n]) * F.col(fmt.format(n))
        return out

    even = {n: 1.0 / len(names) for n in names}
    return wide.select("subject_id", "epoch_idx", "apnoea_label", total("_p_{}", even).alias("p_mean"),
                       total("_p_{}", weights).alias("p_weighted"), total("_r_{}", even).alias("p_rank_mean"))



# ---- estimators --------------------------------------------------------------------------------

def _boosted(features: str, label: str, **kw):
    return GBTClassifier(featuresCol=features, labelCol=label, maxDepth=kw.get("max_depth", 5), maxIter=kw.get("max_iter", 20),
                         stepSize=kw.get("step", 0.1), subsamplingRate=0.9, seed=kw.get("seed", 42), weightCol=kw.get("weight"),
                         validationIndicatorCol=kw.get("validation"))


def _forest(features: str, label: str, **kw):
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=kw.get("trees", 20), maxDepth=kw.get("max_depth", 5),
                                  seed=kw.get("seed", 42), weightCol=kw.get("weight"))


def _logistic(features: str, label: str, **kw):
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=kw.get("reg", 0.0), maxIter=kw.get("max_iter", 50), weightCol=kw.get("weight"))


# pluggable model families: name -> builder(features column, label column, options) of a pyspark.ml estimator
FAMILIES = {"boosted": _boosted, "forest": _forest, "logistic": _logistic}


def register_family(name: str, builder) -> None:
    FAMILIES[name] = builder


class MedianFillScale(Estimator):
    """``<c>_scaled``: gaps (NULL, NaN) filled with the exact median, then centred and divided by the population SD.

    A column without any value is 0 everywhere, one of a single value too.
    """

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        fill = _fills(exact_medians(dataset, self.columns))
        return _scaler(fill, dataset.agg(*[f(F.expr(x)) for x in fill.values() for f in (F.avg, F.stddev_pop)]).first())


def _fills(medians: dict[str, float | None]) -> dict[str, str]:
    return {c: f"nvl(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), double('{m or 0.0!r}'))" for c, m in medians.items()}


def _scaler(fill: dict[str, str], moments) -> SQLTransformer:
    scaled = [f"({x} - double('{moments[2 * i] or 0.0!r}')) / double('{moments[2 * i + 1] or 1.0!r}') AS `{c}_scaled`" for i, (c, x) in enumerate(fill.items())]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def fold_scalers(d: DataFrame, folds: list[int], columns: list[str]) -> dict[int, SQLTransformer | None]:
    """Per fold the fitted ``MedianFillScale`` of the rows outside it; ``d`` carries ``fold``.

    All folds share the passes over the rows, and all options of a search share the result: it does not depend on them.
    """
    if not columns:
        return dict.fromkeys(folds)
    pairs, medians = [(i, c) for i in folds for c in columns], {}
    for a in range(0, len(pairs), MEDIANS):
        some = pairs[a:a + MEDIANS]
        wide = d.select(*[F.when(F.col("fold") != i, F.col(c)).alias(f"v{n}") for n, (i, c) in enumerate(some)])
        medians |= dict(zip(some, exact_medians(wide, wide.columns).values()))
    fills = {i: _fills({c: medians[i, c] for c in columns}) for i in folds}
    outside = [f(F.when(F.col("fold") != i, F.expr(x))) for i in folds for x in fills[i].values() for f in (F.avg, F.stddev_pop)]
    moments = d.agg(*outside).first() if outside else ()
    width = 2 * len(columns)
    return {i: _scaler(fills[i], moments[n * width:(n + 1) * width]) for n, i in enumerate(folds)}


def build(family: str, columns: list[str], label: str, categorical: list[str] | None = None, scaler: SQLTransformer | None = None, **options) -> Pipeline:
    """Median fill and scaling, category codes, assembly and the classifier as one pipeline, so all of it is fitted on training rows only.

    ``scaler`` is a fill and scaling already fitted on these rows.
    """
    stages = []
    ready = [f"{c}_scaled" for c in columns]
    if columns:
        stages.append(scaler or MedianFillScale(columns))
    for c in categorical or []:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep"))
        ready.append(f"{c}_code")
    stages.append(VectorAssembler(inputCols=ready, outputCol="features"))
    options = {k: v for k, v in options.items() if v is not None}
    estimator = FAMILIES[family]("features", label, **options)
    for unset in ("weightCol", "validationIndicatorCol"):
        if estimator.hasParam(unset) and estimator.isSet(unset) and estimator.getOrDefault(unset) is None:
            estimator.clear(estimator.getParam(unset))
    stages.append(estimator)
    return Pipeline(stages=stages)


def fit_binary(train: DataFrame, columns: list[str], label: str = "apnoea_label", family: str = "boosted",
               categorical: list[str] | None = None, validation: str | None = None, weighted: bool = True, scaler: SQLTransformer | None = None, **options):
    """Class-weighted binary fit; ``validation`` names a boolean column of held-out subjects for early stopping."""
    from nightjar.operators.splits import balanced_weights

    d = train.withColumn(label, F.col(label).cast("double"))
    if weighted:
        d = balanced_weights(d, label)
    return build(family, columns, label, categorical, scaler, weight="weight" if weighted else None, validation=validation, **options).fit(d)


def predict(model, rows: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Scores in prediction form: kept columns, pred_prob and pred_label."""
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(*keep, p.alias("pred_prob"), (p > threshold).cast("bigint").alias("pred_label"))


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """``rows`` with their ``fold``, written once: each fit passes over them many times.

    They are dealt and sorted by their own values and the files named in order, so a family that draws rows draws the same ones
    whatever job fits it: a folder alone is listed in any order.
    """
    d = rows.join(folds.select("subject_id", "fold"), "subject_id")
    own = [f.name for f in d.schema if isinstance(f.dataType, T.AtomicType)]
    d = cut_lineage(dealt(d, *own).sortWithinPartitions(*own))
    return d.sparkSession.read.schema(d.schema).parquet(*sorted(d.inputFiles()))


def score_fold(d: DataFrame, fold: int, scaler: SQLTransformer | None, columns: list[str], family: str, keep: list[str], **options) -> DataFrame:
    """The rows of ``fold`` scored by the model of the other folds."""
    model = fit_binary(d.where(F.col("fold") != fold), columns, family=family, scaler=scaler, **options)
    return predict(model, d.where(F.col("fold") == fold), [*keep, "fold"])


def out_of_fold(rows: DataFrame, folds: DataFrame, k: int, columns: list[str], family: str = "logistic",
                keep: list[str] | None = None, only: list[int] | None = None, **options) -> DataFrame:
    """Every row scored by the model of the folds that do not hold its subject; ``only`` names the folds to score."""
    keep, which = keep or ["subject_id", "epoch_idx", "apnoea_label"], list(range(k) if only is None else only)
    d = fold_rows(rows, folds)
    scalers = fold_scalers(d, which, columns)
    return reduce(DataFrame.unionByName, [score_fold(d, i, scalers[i], columns, family, keep, **options) for i in which])


def _trial_aucs(d: DataFrame, scalers: dict, columns: list[str], family: str, trials: list[tuple[int, dict]], folds: list[int]) -> DataFrame:
    """Exact AUC per trial and fold, all of them in one job."""
    from nightjar.operators.metrics import discrimination

    scored = [score_fold(d, i, scalers[i], columns, family, ["apnoea_label"], **options).withColumn("trial", F.lit(t)) for t, options in trials for i in folds]
    return discrimination(reduce(DataFrame.unionByName, scored), ["trial", "fold"])


def search(rows: DataFrame, folds: DataFrame, k: int, columns: list[str], grid: list[dict], family: str = "logistic") -> DataFrame:
    """Mean held-out-fold AUC of each option set (exact AUC), best first."""
    spark = rows.sparkSession
    d = fold_rows(rows, folds)
    auc = _trial_aucs(d, fold_scalers(d, list(range(k)), columns), columns, family, list(enumerate(grid)), list(range(k)))
    names = spark.createDataFrame([(i, str(sorted(o.items()))) for i, o in enumerate(grid)], "trial int, options string")
    return auc.groupBy("trial").agg(F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd_auc")).join(names, "trial").orderBy(F.desc("mean_auc"))


def halving_search(rows: DataFrame, folds: DataFrame, k: int, columns: list[str], grid: list[dict], family: str = "logistic",
                   keep_share: float = 0.5) -> DataFrame:
    """The search by successive halving: (trial, options, n_folds, mean_auc, rank), the winner first.

    All trials meet the same folds. Rungs end after 1, 2, 4, ... and k folds; after each but the last the best ``keep_share``
    of the trials (at least one; by mean AUC so far, ties to the earlier trial) go on and the others stop with the folds they have. Trials
    that ran further rank higher. Scores of a rung are one exact AUC job over trials and folds; the driver holds one number a trial
    and fold. A fold of one class has no AUC and counts for no trial; a trial without any ranks last.
    """
    spark = rows.sparkSession
    d = fold_rows(rows, folds)
    scalers = fold_scalers(d, list(range(k)), columns) if grid else {}
    ends = [e for e in (1 << i for i in range(k.bit_length())) if e < k] + [k]
    alive, found = list(range(len(grid))), {t: {} for t in range(len(grid))}

    def mean(t: int) -> float:
        known = [x for x in found[t].values() if x is not None]
        return sum(known) / len(known) if known else float("-inf")

    done = 0
    for end in ends:
        for r in _trial_aucs(d, scalers, columns, family, [(t, grid[t]) for t in alive], list(range(done, end))).collect() if alive else []:
            found[r.trial][r.fold] = r.auc
        for t in alive:
            found[t] |= {f: None for f in range(done, end) if f not in found[t]}
        alive.sort(key=lambda t: (-mean(t), t))
        if end < k:
            alive = alive[:max(1, math.ceil(len(alive) * keep_share))]
        done = end
    order = sorted(found, key=lambda t: (-len(found[t]), -mean(t), t))
    out = [(t, str(sorted(grid[t].items())), len(found[t]), mean(t) if mean(t) > float("-inf") else None, i + 1) for i, t in enumerate(order)]
    return spark.createDataFrame(out, "trial int, options string, n_folds int, mean_auc double, rank int")


def fit_multiclass(train: DataFrame, columns: list[str], label: str, **options):
    return build("forest", columns, label, **options).fit(train.withColumn(label, F.col(label).cast("double")))


def predict_classes(model, rows: DataFrame, keep: list[str], n_classes: int) -> DataFrame:
    """Class probabilities as columns (0 for a class above all training labels) and the arg-max class (lowest on ties)."""
    p = vector_to_array("probability")
    d = model.transform(rows).select(*keep, *[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(n_classes)])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("i")) for i in range(n_classes)]))
    return d.withColumn("pred", (-best["i"]).cast("int"))


def standardise(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - training mean) / training population std, both read as one aggregate row."""
    s = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in columns})


def top_features(model, columns: list[str], spark, n: int = 40) -> DataFrame:
    """The n most important columns of a fitted tree pipeline, ties in column order."""
    scores = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(i, c, float(v)) for i, (c, v) in enumerate(zip(columns, scores))], "position int, feature string, importance double")
    return rows.orderBy(F.desc("importance"), "position").limit(n).select("feature", "importance")
