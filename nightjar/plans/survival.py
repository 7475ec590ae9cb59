"""Survival analyses: null model, preprocessing, model ladder, bootstrap and cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.operators import resample as R
from nightjar.operators import survival as S
from nightjar.operators.cox import CoxFits, baseline_hazard, cox_fit, cox_fits, equal_rows, survival_at
from nightjar.operators.running import union_all
from nightjar.operators.splits import stratified_kfold
from nightjar.session import cut_lineage


def null_survival(train: DataFrame, strata: list[str], t: float, weight: str | None = None) -> DataFrame:
    """KM survival of each stratum at t."""
    return S.km_risk(train, strata, t, weight).select(*strata, (1 - F.col("risk")).alias("null_survival"))


def predict_ladder(train: DataFrame, test: DataFrame, ladder: dict[str, list[str]], strata: list[str],
                   times: list[float], penalizer: float = 0.01, weight: str | None = None) -> DataFrame:
    """Test rows stacked per model with lp, score = 1 - S(times[1]) and survival at every time."""
    frames = []
    for name, terms in ladder.items():
        fit = cox_fit(train, terms, strata, penalizer, weight=weight)
        frames.append(survival_at(test, fit, baseline_hazard(train, fit, weight), times).withColumn("model", F.lit(name)))
    return union_all(frames).withColumn("score", 1 - F.col("s_1"))


def evaluate_ladder(df: DataFrame, is_test: Column, ladder: dict[str, list[str]], strata: list[str], h5: float,
                    h10: float, grid: list[float]) -> DataFrame:
    """The eight test metrics of every model of a nested ladder fitted on the training rows."""
    terms = list(dict.fromkeys(t for own in ladder.values() for t in own))
    kept = [*strata, "time", "event", *terms]
    rows = equal_rows(df.select(*kept, is_test.alias("_test")), [*kept, "_test"])
    train, test = rows.where("NOT _test"), rows.where("_test")
    null = null_survival(train, strata, h10, "_n")
    pred = predict_ladder(train, test, ladder, strata, [h5, h10, *grid], weight="_n")
    return _metrics(pred.join(null, strata), ["model"], strata, h5, h10, grid)


def _metrics(pred: DataFrame, by: list[str], strata: list[str], h5: float, h10: float, grid: list[float]) -> DataFrame:
    """The eight metrics of predictions numbered by ``_n``; rows of a stratum with the same lp, so the same survival, at the same time count as one."""
    curve = [f"s_{i + 2}" for i in range(len(grid))]
    pred = cut_lineage(pred.groupBy(*by, *strata, "time", "event", "lp").agg(
        F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("score", "s_0", "s_1", *curve, "null_survival")]))
    return S.metric_row(pred, by, strata, h5, h10, "s_0", "s_1", "null_survival", grid, [F.col(c) for c in curve], "_n")


@dataclass
class Analyses:
    """Every outcome x definition x model fitted on the training rows and scored on the test rows.

    ``rows`` holds (analysis, strata, time, event, terms, is_test) with the number ``_n`` of subjects that are equal in them and in
    all other analyses, ``pred`` the test rows once per fit with lp, score and survival columns. ``fit`` numbers outcome, definition
    and model in the order given.
    """

    outcomes: list[str]
    definitions: list[str]
    models: list[str]
    strata: list[str]
    rows: DataFrame
    fits: CoxFits
    pred: DataFrame
    horizons: tuple[float, float]
    grid: list[float]

    def _named(self, df: DataFrame, number: str, models: bool) -> DataFrame:
        """``number`` spelled out as outcome, definition and, for a fit, model."""
        pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), i.cast("int") + 1)
        per = len(self.models) if models else 1
        a = F.floor(F.col(number) / per)
        names = [pick(self.outcomes, F.floor(a / len(self.definitions))).alias("outcome"), pick(self.definitions, a % len(self.definitions)).alias("definition")]
        names += [pick(self.models, F.col(number) % per).alias("model")] if models else []
        return df.select(*names, *[c for c in df.columns if c != number])

    def sizes(self) -> DataFrame:
        """Subjects and events per outcome, definition, part and stratum."""
        g = self.rows.groupBy("analysis", "is_test", *self.strata).agg(F.sum("_n").alias("n"), F.sum(F.col("event") * F.col("_n")).alias("events"))
        return self._named(g, "analysis", False)

    def hazard_ratios(self) -> DataFrame:
        return self._named(self.fits.hazard_ratios(self.rows.sparkSession), "fit", True)

    def metrics(self) -> DataFrame:
        """The eight test metrics per outcome, definition and model."""
        m = _metrics(self.pred, ["fit"], self.strata, *self.horizons, self.grid)
        return self._named(m, "fit", True)

    def subgroup_concordance(self, subgroups: dict[str, Column]) -> DataFrame:
        """Harrell's C inside each named subgroup, per outcome, definition and model; a row counts in every subgroup it meets."""
        own = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subgroups.items()]), lambda x: x.isNotNull())
        return self._named(S.harrell_c(self.pred.withColumn("subgroup", F.explode(own)), ["fit", "subgroup"], weight="_n"), "fit", True)


def analyse(df: DataFrame, outcomes: dict[str, tuple[Column, Column]], definitions: dict[str, Column], ladder: dict[str, list[str]],
            is_test: Column, strata: list[str], h5: float, h10: float, grid: list[float], penalizer: float = 0.01,
            carry: list[str] | None = None) -> Analyses:
    """The model ladder for every outcome (time, event) under every cohort definition, as grouped jobs.

    A subject enters the analyses whose definition holds and whose time is positive and event known; rows with a null term, stratum
    or part take no part. The fits share their data passes, so the number of jobs follows the slowest fit, not their number. Test
    rows of a stratum without training events keep the null survival of 1. ``carry`` names columns kept for subgroups.
    """
    terms = list(dict.fromkeys(t for own in ladder.values() for t in own))
    entries = [(time.cast("double"), event.cast("int"), inside & (time > 0) & event.isNotNull()) for time, event in outcomes.values() for inside in definitions.values()]
    kept = list(dict.fromkeys([*strata, *terms, *(carry or [])]))
    flat = [F.when(ok, x).alias(f"_{n}{a}") for a, (time, event, ok) in enumerate(entries) for n, x in (("t", time), ("e", event))]
    rows = df.select(*kept, is_test.alias("is_test"), *flat).dropna(subset=[*strata, *terms, "is_test"])
    rows = equal_rows(rows.where(F.coalesce(*[F.col(f"_e{a}") for a in range(len(entries))]).isNotNull()), rows.columns)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("analysis"), F.col(f"_t{a}").alias("time"), F.col(f"_e{a}").alias("event")) for a in range(len(entries))]))
    rows = rows.withColumn("_a", each).where("_a.event IS NOT NULL").select("_a.*", "is_test", *kept, "_n")
    train, test = rows.where("NOT is_test"), rows.where("is_test")
    models = [(a, own) for a in range(len(entries)) for own in ladder.values()]
    fits = cox_fits(train, "analysis", models, strata, penalizer, weight="_n")
    null = S.km_risk(train, ["analysis", *strata], h10, "_n").select("analysis", *strata, (1 - F.col("risk")).alias("null_survival"))
    hazard = cut_lineage(baseline_hazard(fits.expand(train), fits, "_n"))
    known = fits.expand(test).join(null, ["analysis", *strata], "left").fillna(1.0, ["null_survival"])
    levels = hazard.unionByName(known.select("fit", *strata).distinct().withColumns({"time": F.lit(0.0), "hazard": F.lit(0.0)}))
    pred = survival_at(known, fits, levels, [h5, h10, *grid]).withColumn("score", 1 - F.col("s_1"))
    return Analyses(list(outcomes), list(definitions), list(ladder), strata, rows, fits, cut_lineage(pred), (h5, h10), grid)


def bootstrap_metrics(pred: DataFrame, strata: list[str], h5: float, h10: float, grid: list[float], n_boot: int,
                      seed: int = 42) -> DataFrame:
    """The metrics per (model, replicate) on resamples shared by all models.

    Replicate weights ride along as an integer column, and the censoring model is refitted inside
    every replicate because its risk tables are weighted and grouped by replicate too.
    """
    w = R.boot_weights(pred.select("subject_id"), n_boot, seed)
    d = cut_lineage(pred.join(w, "subject_id"))
    return S.metric_row(d, ["model", "replicate"], strata, h5, h10, "s_0", "s_1", "null_survival", grid,
                        [F.col(f"s_{i + 2}") for i in range(len(grid))], weight="w")


def paired_metrics(boots: DataFrame, pairs: list[tuple[str, str]], metric: str) -> DataFrame:
    """Interval and +1-corrected p of the metric difference for each (model, model) pair."""
    names = boots.sparkSession.createDataFrame(pairs, "a string, b string")
    a = names.join(boots, names.a == boots.model).select("a", "b", "replicate", metric)
    b = names.join(boots, names.b == boots.model).select("a", "b", "replicate", metric)
    return R.paired_delta(a, b, ["a", "b"], metric, convention="plus_one")


def cross_validate(df: DataFrame, ladder: dict[str, list[str]], strata: list[str], k: int = 5, repeats: int = 3) -> DataFrame:
    """Repeated stratified folds: mean and SD of the concordance of each model on the held-out folds."""
    ids = df.select("subject_id", *strata, "event").withColumn("_cell", F.concat_ws("|", *strata, "event"))
    folds = cut_lineage(stratified_kfold(ids.select("subject_id", "_cell").distinct(), ["_cell"], k, repeats))
    scored = []
    for rep in range(repeats):
        d = df.join(folds.where(F.col("repeat") == rep).select("subject_id", "fold"), "subject_id")
        for i in range(k):
            train, held = d.where(F.col("fold") != i), d.where(F.col("fold") == i)
            for name, terms in ladder.items():
                fit = cox_fit(train, terms, strata, 0.01)
                scored.append(held.select(*strata, "time", "event", fit.linear_predictor().alias("score"),
                                          F.lit(name).alias("model"), F.lit(rep * k + i).alias("split")))
    c = S.harrell_c(union_all(scored), ["model", "split"], strata)
    return c.groupBy("model").agg(F.avg("c_index").alias("mean_c"), F.stddev_samp("c_index").alias("sd_c"), F.count("*").alias("n_splits"))


def within_stratum_slope(pred: DataFrame, strata: list[str], lp: str = "lp") -> float:
    """Calibration slope of a linear predictor: the coefficient of its own unpenalised Cox fit with a baseline per stratum."""
    return float(cox_fit(pred, [lp], strata, penalizer=0.0).beta[0])


def subgroup_concordance(pred: DataFrame, subgroups: dict[str, Column]) -> DataFrame:
    """Harrell's C of each model inside each named subgroup."""
    return union_all([S.harrell_c(pred.where(c), ["model"]).withColumn("subgroup", F.lit(n)) for n, c in subgroups.items()])
