"""Stratified Cox regression by Newton steps: every data pass is an aggregate, the p x p solve is local.

With p terms the driver sees one row of p + p(p+1)/2 numbers per step, whatever the cohort size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.operators.running import quantile_bucket, running_totals
from nightjar.session import cut_lineage


@dataclass
class CoxFit:
    terms: list[str]
    strata: list[str]
    beta: np.ndarray
    se: np.ndarray
    steps: int
    gradient_norm: float

    def hazard_ratios(self, spark) -> DataFrame:
        """coef, hazard ratio with 95 % interval and two-sided Wald p per term."""
        rows = []
        for t, b, s in zip(self.terms, self.beta, self.se):
            p = math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else 1.0
            rows.append((t, float(b), float(np.exp(b)), float(np.exp(b - 1.96 * s)), float(np.exp(b + 1.96 * s)), p))
        return spark.createDataFrame(rows, "term string, coef double, hr double, hr_low double, hr_high double, p double")

    def linear_predictor(self) -> Column:
        return _linear(self.terms, self.beta)


def equal_rows(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Rows equal in ``columns`` as one, with their number in ``_n`` (the sum of ``weight``, if the rows have one); written once."""
    return cut_lineage(df.groupBy(*columns).agg((F.sum(weight) if weight else F.count("*")).alias("_n")))


def _standard(df: DataFrame, group: str, strata: list[str], terms: list[str], weight: str | None) -> tuple[dict, DataFrame]:
    """Per group n, means and deviations of the terms, and the rows with standardised terms z0, z1, ..., equal ones folded.

    The rows lie in the order of (group, strata, time), in files of about equal size, so a batch read by a later pass holds few
    times and leaves its task as few sums. Their order takes in the terms, so many rows at one time do not meet in one file.
    """
    died = F.coalesce((F.col("event") == 1).cast("int"), F.lit(0))
    columns = [group, *strata, "time", "event", *terms]
    rows = df.select(F.col(group).cast("int").alias(group), *strata, F.col("time").cast("double").alias("time"), died.alias("event"),
                     *[F.col(t).cast("double").alias(t) for t in terms], *([weight] if weight else [])).dropna(subset=columns)
    rows = equal_rows(rows, columns, weight)
    # deviations by a second look, since sums of squares would cancel; a constant term has exactly none
    means = {r[group]: r for r in rows.groupBy(group).agg(F.sum("_n").alias("n"), *[
        F.when(F.min(t) == F.max(t), F.min(t)).otherwise(F.sum(F.col("_n") * F.col(t)) / F.sum("_n")).alias(f"m{i}") for i, t in enumerate(terms)]).collect()}
    last = max(means, default=0)
    mean = [_pick([means[g][f"m{i}"] if g in means else 0.0 for g in range(last + 1)], group) for i in range(len(terms))]
    moments = rows.groupBy(group).agg(*[
        F.sqrt(F.try_divide(F.sum(F.col("_n") * (F.col(t) - m) * (F.col(t) - m)), F.sum("_n") - 1)).alias(f"s{i}") for i, (t, m) in enumerate(zip(terms, mean))])
    stats = {r[group]: {"n": means[r[group]]["n"]} | {f"m{i}": means[r[group]][f"m{i}"] for i in range(len(terms))} | {f"s{i}": r[f"s{i}"] or 1.0 for i in range(len(terms))}
             for r in moments.collect()}
    sd = [_pick([stats[g][f"s{i}"] if g in stats else 1.0 for g in range(last + 1)], group) for i in range(len(terms))]
    z = [f"z{i}" for i in range(len(terms))]
    scaled = rows.select(group, *strata, "time", "event", "_n", *[((F.col(t) - m) / d).alias(n) for t, m, d, n in zip(terms, mean, sd, z)])
    order = [group, *strata, "time", *z]
    return stats, cut_lineage(quantile_bucket(scaled, "time", "_slice").repartitionByRange(*order).sortWithinPartitions(*order))


def _sums(df: DataFrame, group: str, strata: list[str], k: int, fits: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    """Per (fit, strata, time) with deaths: risk-set sums and death sums of 1, z and z z' weighted by exp(eta).

    ``fits`` gives each fit's group, coefficients and the terms it uses; sums of other terms are 0. A task adds up the rows of equal
    keys that follow each other in a batch, for all fits of their group, so no row is repeated per fit. What is left, a row per key, is
    written, since the offsets of the time slices read it too.
    """
    keys = [*strata, "_slice", "time"]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    parts = ["s0", *[f"s1_{i}" for i in range(k)], *[f"s2_{i}_{j}" for i, j in pairs]]
    names = [*parts, *[f"d_{p}" for p in parts], "deaths", "sum_eta", *[f"x_{i}" for i in range(k)]]
    types = dict(df.dtypes)

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in [group, *keys]]
            starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
            lengths = np.diff(np.append(starts, batch.num_rows))
            of = batch.column(group).to_numpy()
            n, died = (batch.column(c).to_numpy().astype(float) for c in ("_n", "event"))
            z = [batch.column(f"z{i}").to_numpy() for i in range(k)]
            found = []
            for f, (g, beta, on) in fits.items():
                runs = np.flatnonzero(of[starts] == g)
                if not len(runs):
                    continue
                own = slice(None) if len(runs) == len(starts) else of == g
                first = np.concatenate([[0], np.cumsum(lengths[runs])[:-1]])
                total = lambda v: np.add.reduceat(v, first)
                x = {i: z[i][own] for i in np.flatnonzero(on)}
                eta = sum((beta[i] * v for i, v in x.items()), np.zeros(lengths[runs].sum()))
                dead = n[own] * died[own]
                zero = np.zeros(len(runs))
                sums = {}
                for mark, e in (("", n[own] * np.exp(eta)), ("d_", dead * np.exp(eta))):
                    sums[f"{mark}s0"] = total(e)
                    sums |= {f"{mark}s1_{i}": total(e * v) for i, v in x.items()}
                    sums |= {f"{mark}s2_{i}_{j}": total(e * x[i] * x[j]) for i, j in pairs if i in x and j in x}
                sums |= {"deaths": total(dead), "sum_eta": total(dead * eta)} | {f"x_{i}": total(dead * v) for i, v in x.items()}
                at = pa.array(starts[runs])
                found.append(pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(runs), f, np.int32)), *[batch.column(c).take(at) for c in keys], *[pa.array(sums.get(c, zero)) for c in names]],
                    names=["fit", *keys, *names]))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    schema = ", ".join(["fit int", *[f"`{c}` {types[c]}" for c in keys], *[f"{c} double" for c in names]])
    g = cut_lineage(df.mapInArrow(add, schema).groupBy("fit", *keys).agg(*[F.sum(c).alias(c) for c in names]))
    r = running_totals(g, ["fit", *strata], "time", parts, bucket="_slice")
    # at risk at t: everybody with time >= t
    return r.withColumns({f"r_{n}": F.col(f"{n}_total") - F.col(f"{n}_before") for n in parts}).where("deaths > 0")


def _shifted(x: np.ndarray, term, shift: int = 8) -> np.ndarray:
    """Sum of ``term`` over x, x + 1, ..., x + shift - 1."""
    return sum(term(x + k) for k in range(shift))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series eight steps up."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - _shifted(x, np.log)


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - _shifted(x, lambda v: 1 / v)


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    return 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) - 1 / (30 * y**9) + _shifted(x, lambda v: 1 / (v * v))


def _efron_sums(d: np.ndarray, r: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Efron's sums over the d tied deaths of each time, l = 0 ... d - 1, in closed form: ln phi, 1 / phi, f / phi, 1 / phi^2, f / phi^2, f^2 / phi^2.

    The risk sum of death l is phi = r - f e with f = l / d, that is (e / d)(a - l) with a = r d / e, so the sums of ln(a - l),
    1 / (a - l) and 1 / (a - l)^2 are differences of log gamma, digamma and trigamma: one step per
    time however many deaths it ties. A single death needs no sum.
    """
    a = r * d / e
    one = d == 1
    s1, s2 = digamma(a + 1) - digamma(a - d + 1), trigamma(a - d + 1) - trigamma(a + 1)
    return (
        np.where(one, np.log(r), d * np.log(e / d) + log_gamma(a + 1) - log_gamma(a - d + 1)),
        np.where(one, 1 / r, d / e * s1),
        np.where(one, 0.0, (a * s1 - d) / e),
        np.where(one, 1 / (r * r), d * d / (e * e) * s2),
        np.where(one, 0.0, d / (e * e) * (a * s2 - s1)),
        np.where(one, 0.0, (a * a * s2 - 2 * a * s1 + d) / (e * e)))


def _linear(terms: list[str], beta: np.ndarray) -> Column:
    return reduce(lambda eta, x: eta + F.lit(float(x[1])) * F.col(x[0]), zip(terms, beta), F.lit(0.0))


def _derivatives(df: DataFrame, group: str, strata: list[str], k: int, fits: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> dict:
    """Efron log likelihood, score and information of each of the ``fits``, from one row per (fit, strata, time).

    A task folds the rows it holds to one row of sums per fit. In numpy, since the closed sums as column
    expressions pass what Java compiles into one method.
    """
    by = "fit"
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["ll", *[f"g{i}" for i in range(k)], *[f"h{i}_{j}" for i, j in pairs]]

    def fold(batches):
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names if c != by}
            log, p, fp, pp, fpp, ffpp = _efron_sums(x["deaths"], x["r_s0"], x["d_s0"])
            r1, e1 = [x[f"r_s1_{i}"] for i in range(k)], [x[f"d_s1_{i}"] for i in range(k)]
            parts = [x["sum_eta"] - log, *[x[f"x_{i}"] - (r1[i] * p - e1[i] * fp) for i in range(k)]]
            parts += [x[f"r_s2_{i}_{j}"] * p - x[f"d_s2_{i}_{j}"] * fp
                      - (r1[i] * r1[j] * pp - (r1[i] * e1[j] + e1[i] * r1[j]) * fpp + e1[i] * e1[j] * ffpp) for i, j in pairs]
            values, at = np.unique(batch.column(by).to_numpy(), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int32()), *[pa.array(np.bincount(at, v, len(values))) for v in parts]], names=[by, *names])

    wide = _sums(df, group, strata, k, fits)
    used = [by, "deaths", "sum_eta", *[f"x_{i}" for i in range(k)], *[c for c in wide.columns if c.startswith(("r_s", "d_s"))]]
    sums = wide.select(F.col(by).cast("int").alias(by), *used[1:]).mapInArrow(fold, f"{by} int, " + ", ".join(f"{n} double" for n in names))
    return {
        row[by]: (row["ll"], np.array([row[f"g{i}"] for i in range(k)]),
                  np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))
        for row in sums.groupBy(by).agg(*[F.sum(n).alias(n) for n in names]).collect()}


def cox_fit(df: DataFrame, terms: list[str], strata: list[str] | None = None, penalizer: float = 0.0,
            max_steps: int = 20, tol: float = 1e-7, weight: str | None = None) -> CoxFit:
    """Fit on (time, event, terms, strata); the ridge acts on standardised terms, scaled by n.

    Rows with a null take no part; ``weight`` is the number of equal rows that a row stands for. The standardised input is
    written to the checkpoint folder once, with its time slice, so every step is a scan of the same table and survives lost executors.
    """
    strata, k = strata or [], len(terms)
    stats, scaled = _standard(df.withColumn("_group", F.lit(0)), "_group", strata, terms, weight)
    n, sd = stats[0]["n"], np.array([stats[0][f"s{i}"] for i in range(k)])
    at = lambda beta: _derivatives(scaled, "_group", strata, k, {0: (0, beta, np.ones(k, bool))})[0]
    ridge = penalizer * n
    beta = np.zeros(k)
    ll, grad, info = at(beta)
    ll -= 0.5 * ridge * beta @ beta
    steps = 0
    for steps in range(1, max_steps + 1):
        full = info + ridge * np.eye(k)
        move = np.linalg.solve(full, grad - ridge * beta)
        size = 1.0
        while True:  # halve a step that lowers the likelihood
            trial = beta + size * move
            new_ll, new_grad, new_info = at(trial)
            new_ll -= 0.5 * ridge * trial @ trial
            if new_ll >= ll - _noise(ll) or size < 1e-3:
                break
            size /= 2
        beta, ll, grad, info = trial, new_ll, new_grad, new_info
        if np.abs(grad - ridge * beta).max() < tol * max(1.0, n) ** 0.5 or np.abs(size * move).max() < tol:
            break
    cov = np.linalg.inv(info + ridge * np.eye(k))
    return CoxFit(list(terms), strata, beta / sd, np.sqrt(np.diag(cov)) / sd, steps, float(np.abs(grad - ridge * beta).max()))


def _noise(ll: float) -> float:
    """What a log likelihood may fall by without being lower: the rounding of its sum grows with it."""
    return max(1e-9, 1e-12 * abs(ll))


# ---- many fits side by side ---------------------------------------------------------------------

def _pick(values, index: str) -> Column:
    """Entry ``index`` of a short list of numbers."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(index) + 1)


@dataclass
class CoxFits:
    """Fits numbered 0, 1, ...: fit f uses the rows of group ``groups[f]``; beta and se are (fit, term), 0 where a term is not in the fit.

    A fit whose rows hold no event has NaN throughout.
    """

    group: str
    groups: list[int]
    terms: list[str]
    used: np.ndarray
    strata: list[str]  # "fit" first, so that baseline_hazard and survival_at keep fits apart
    beta: np.ndarray
    se: np.ndarray
    passes: int

    def expand(self, df: DataFrame, only: list[int] | None = None) -> DataFrame:
        """Each row once per fit of its group, with the number in ``fit``."""
        keep = set(range(len(self.groups)) if only is None else only)
        own = [[f for f, g in enumerate(self.groups) if g == k and f in keep] for k in range(max(self.groups) + 1)]
        lists = F.array(*[F.array(*[F.lit(f) for f in fs]).cast("array<int>") for fs in own])
        return df.withColumn("fit", F.explode(F.element_at(lists, F.col(self.group) + 1)))

    def linear_predictor(self) -> Column:
        return reduce(lambda eta, i: eta + _pick(self.beta[:, i], "fit") * F.col(self.terms[i]), range(len(self.terms)), F.lit(0.0))

    def hazard_ratios(self, spark) -> DataFrame:
        """coef, standard error, hazard ratio with 95 % interval and two-sided Wald p per fit and term; null for a fit without events."""
        rows = []
        for f, i in zip(*np.nonzero(self.used)):
            b, s = float(self.beta[f, i]), float(self.se[f, i])
            known = (b, s, math.exp(b), math.exp(b - 1.96 * s), math.exp(b + 1.96 * s), math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else 1.0)
            rows.append((int(f), self.terms[i], *(known if math.isfinite(b) else [None] * 6)))
        return spark.createDataFrame(rows, "fit int, term string, coef double, se double, hr double, hr_low double, hr_high double, p double")


def cox_fits(df: DataFrame, group: str, fits: list[tuple[int, list[str]]], strata: list[str] | None = None, penalizer: float = 0.0,
             max_steps: int = 20, tol: float = 1e-7, weight: str | None = None) -> CoxFits:
    """Many fits in the data passes of the slowest one; fit f is (group number, terms), as ``cox_fit`` would fit it on that group.

    ``df`` holds (group, time, event, strata, all terms), and ``weight`` if a row stands for several; rows with a null take no part. A pass gives the likelihoods, scores and informations of
    all fits still moving, one row a fit; every fit keeps its own step and halves it on its own. The driver holds numbers per
    (fit, term) only. A task adds its rows up for all fits of their group; they leave it as sums per (fit, strata, time).
    """
    strata = strata or []
    terms = list(dict.fromkeys(t for _, own in fits for t in own))
    groups, k = [g for g, _ in fits], len(terms)
    used = np.array([[t in own for t in terms] for _, own in fits])
    stats, scaled = _standard(df, group, strata, terms, weight)
    sd = np.array([[stats[g][f"s{i}"] if g in stats else 1.0 for i in range(k)] for g in range(max(groups) + 1)])
    size = np.array([stats[g]["n"] if g in stats else 0 for g in groups])
    out = CoxFits(group, groups, terms, used, ["fit", *strata], np.zeros(used.shape), np.full(used.shape, np.nan), 0)
    ridge = penalizer * size
    beta, move, length = np.zeros(used.shape), np.zeros(used.shape), np.ones(len(fits))
    held: dict = {}  # fit -> log likelihood, score and information at beta, all with the ridge
    moving, halvings = list(range(len(fits))), 12
    steps = np.zeros(len(fits), int)
    while moving:
        trial = beta + length[:, None] * move
        found = _derivatives(scaled, group, strata, k, {f: (groups[f], trial[f], used[f]) for f in moving})
        out.passes += 1
        still = []
        for f in moving:
            if f not in found:
                beta[f] = np.nan
                continue
            at, on = trial[f], used[f]
            ll, grad, info = found[f]
            ll, grad = ll - 0.5 * ridge[f] * at @ at, (grad - ridge[f] * at)[on]
            info = info[np.ix_(on, on)] + ridge[f] * np.eye(on.sum())
            flat = np.abs(grad).max() < tol * max(1, size[f]) ** 0.5
            if f in held and not flat and ll < held[f][0] - _noise(ll) and length[f] > 0.5 ** halvings:
                length[f] /= 2
                still.append(f)
                continue
            moved = length[f] * np.abs(move[f]).max()
            beta[f], held[f] = at, (ll, grad, info)
            steps[f] += 1
            if steps[f] > max_steps or flat or (steps[f] > 1 and moved < tol):
                move[f] = 0.0
                continue
            move[f], length[f] = 0.0, 1.0
            move[f, on] = np.linalg.lstsq(info, grad, rcond=None)[0]
            still.append(f)
        moving = still
    for f in held:
        on = used[f]
        out.se[f, on] = np.sqrt(np.diag(np.linalg.pinv(held[f][2]))) / sd[groups[f]][on]
    out.beta = np.where(used, beta / sd[groups], np.where(np.isnan(beta), np.nan, 0.0))
    return out


def baseline_hazard(df: DataFrame, fit: CoxFit | CoxFits, weight: str | None = None) -> DataFrame:
    """Breslow cumulative hazard per stratum at each event time: running sum of deaths / risk sum."""
    n = F.col(weight) if weight else F.lit(1)
    d = df.withColumn("_e", n * F.exp(fit.linear_predictor()))
    g = d.groupBy(*fit.strata, "time").agg(F.sum("_e").alias("s0"), F.sum((F.col("event") == 1).cast("int") * n).alias("deaths"))
    r = running_totals(g, fit.strata, "time", ["s0"]).withColumn(
        "step", F.col("deaths") / (F.col("s0_total") - F.col("s0_before"))).select(*fit.strata, "time", "step")
    h = running_totals(r.where("step > 0"), fit.strata, "time", ["step"])
    return h.select(*fit.strata, "time", (F.col("step_before") + F.col("step")).alias("hazard"))


def survival_at(df: DataFrame, fit: CoxFit | CoxFits, hazard: DataFrame, times: list[float]) -> DataFrame:
    """S(t | x) = exp(-H0(t) exp(lp)) per subject and horizon, from each stratum's own step function.

    The baseline at the few horizons is one aggregate row per stratum, joined to the subjects.
    """
    at = hazard.groupBy(*fit.strata).agg(*[
        F.coalesce(F.max(F.when(F.col("time") <= t, F.col("hazard"))), F.lit(0.0)).alias(f"_h{i}") for i, t in enumerate(times)])
    if fit.strata:
        d = df.join(at, fit.strata)
    else:
        d = df.withColumns({f"_h{i}": at.select(f"_h{i}").scalar() for i in range(len(times))})
    lp = fit.linear_predictor()
    return d.withColumn("lp", lp).withColumns({
        f"s_{i}": F.exp(-F.col(f"_h{i}") * F.exp("lp")) for i in range(len(times))}).drop(*[f"_h{i}" for i in range(len(times))])
