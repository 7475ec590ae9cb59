"""Right-censored evaluation metrics as ordered aggregates; no pair of subjects is ever materialised.

Input columns: ``time`` (> 0), ``event`` (1/0), ``score``; ``by`` names independent samples (models,
replicates, subgroups), ``strata`` the groups of the censoring model, ``weight`` an integer-like
replicate weight. A subject censored at the time of an event counts as having survived longer.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions.kernels import dominated
from nightjar.operators.asof import step_lookup
from nightjar.operators.metrics import discrimination
from nightjar.operators.running import bucket_count, running_totals
from nightjar.session import cut_lineage

CELLS = 500_000  # cells of a slice of the time axis, or of a chunk of the score axis, at most
SLICES = 512     # unless these would be more, since one task holds the sums of all slices and chunks of a group


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def risk_table(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Per distinct time: events ``d``, censorings ``c`` and ``at_risk`` (all with time >= t)."""
    w = _w(weight)
    g = df.groupBy(*by, "time").agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col("event") == 1, w).otherwise(0)).alias("d"),
        F.sum(F.when(F.col("event") == 0, w).otherwise(0)).alias("c"))
    return running_totals(g, by, "time", ["n"]).withColumn("at_risk", F.col("n_total") - F.col("n_before")).drop("n_before")


def product_limit(table: DataFrame, by: list[str], removed: Column, at_risk: Column) -> DataFrame:
    """Add the product of (1 - removed / at_risk) over earlier times (``left``) and up to now (``surv``).

    The running product is a running sum of logs; a factor of zero is counted instead of logged.
    """
    full = removed >= at_risk
    t = table.withColumns({
        "_log": F.when((removed > 0) & ~full, F.log(F.lit(1.0) - removed / at_risk)).otherwise(F.lit(0.0)),
        "_zero": F.when((removed > 0) & full, 1).otherwise(0)})
    r = running_totals(t, by, "time", ["_log", "_zero"])
    left = F.when(F.col("_zero_before") > 0, F.lit(0.0)).otherwise(F.exp("_log_before"))
    surv = F.when(F.col("_zero_before") + F.col("_zero") > 0, F.lit(0.0)).otherwise(F.exp(F.col("_log_before") + F.col("_log")))
    return r.withColumns({"left": left, "surv": surv}).drop(
        "_log", "_zero", "_log_before", "_log_total", "_zero_before", "_zero_total")


def censoring_km(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """G(t) = P(C > t) and its left limit at every observed time; events precede tied censorings.

    Pass the strata inside ``by`` for a stratified censoring model.
    """
    t = risk_table(df, by, weight)
    return product_limit(t, by, F.col("c"), F.col("at_risk") - F.col("d")).select(
        *by, "time", F.col("left").alias("g_left"), F.col("surv").alias("g"), "c")


def survival_km(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Kaplan-Meier survival at every observed time."""
    t = risk_table(df, by, weight)
    return product_limit(t, by, F.col("d"), F.col("at_risk")).select(*by, "time", "d", "c", "at_risk", "left", "surv")


def g_at(km: DataFrame, by: list[str], t: float) -> DataFrame:
    """G at one fixed time per group: the last step not after t, 1 before the first."""
    return km.groupBy(*by).agg(F.coalesce(F.max_by(
        F.when(F.col("time") <= t, F.col("g")), F.when(F.col("time") <= t, F.col("time"))), F.lit(1.0)).alias("g_t"))


def with_censoring(df: DataFrame, by: list[str], strata: list[str], km: DataFrame) -> DataFrame:
    """Attach each subject's own G(time-), unless ``with_horizons`` has done so."""
    if "g_left" in df.columns:
        return df
    return df.join(km.select(*by, *strata, "time", "g_left"), [*by, *strata, "time"])


def _g_name(t: float) -> str:
    return f"_g_{float(t)!r}".replace(".", "_")


def with_horizons(df: DataFrame, by: list[str], strata: list[str], times: list[float], km: DataFrame) -> DataFrame:
    """Each subject's own G(time-) and G at the given times, for metrics that then join no censoring model; written once."""
    groups = [*by, *strata]
    last = lambda t, v: F.coalesce(F.max_by(F.when(F.col("time") <= t, v), F.when(F.col("time") <= t, F.col("time"))), F.lit(1.0))
    fixed = km.groupBy(*groups).agg(*[last(t, F.col("g")).alias(_g_name(t)) for t in dict.fromkeys(map(float, times))])
    own = with_censoring(df, by, strata, km)
    return cut_lineage(own.join(fixed, groups) if groups else own.crossJoin(fixed))


def _inverse(g: Column) -> Column:
    return F.when(g > 0, F.lit(1.0) / g).otherwise(F.lit(0.0))


def km_risk(df: DataFrame, by: list[str], t: float, weight: str | None = None) -> DataFrame:
    """1 - KM(t) with a log(-log) Greenwood 95 % interval."""
    r = risk_table(df, by, weight).where(F.col("time") <= t)
    d, n = F.col("d"), F.col("at_risk")
    g = r.groupBy(*by).agg(
        F.max(((d > 0) & (d >= n)).cast("int")).alias("_zero"),
        F.sum(F.when((d > 0) & (d < n), F.log(F.lit(1.0) - d / n)).otherwise(0.0)).alias("_log"),
        F.sum(F.when((d > 0) & (d < n), d / (n * (n - d))).otherwise(0.0)).alias("_var"))
    s = F.when(F.col("_zero") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    ok = (s > 0) & (s < 1) & (F.col("_var") > 0)
    se = F.sqrt("_var") / F.abs(F.log(s))
    return g.select(*by, (1 - s).alias("risk"), F.when(ok, 1 - F.pow(s, F.exp(-1.96 * se))).alias("risk_low"),
                    F.when(ok, 1 - F.pow(s, F.exp(1.96 * se))).alias("risk_high"))


# ---- concordance ------------------------------------------------------------------------------

def _late() -> Column:
    """1 for a row censored at its time, which outlives an event at that time."""
    return (F.col("event") == 0).cast("int")


def _numbered(cells: DataFrame, by: list[str], times: list[float], scores: list[float]) -> DataFrame:
    """Add ``_slice`` of the time and ``_chunk`` of the score, even between two cut points and odd for a cut point itself, and ``_order``.

    ``_order`` is the slice, cut once more at a single time: rows that end there come before rows censored there.
    """
    def number(value: pa.ChunkedArray, cuts: np.ndarray) -> np.ndarray:
        x = value.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        below = np.searchsorted(cuts, x)
        found = np.append(cuts, np.inf)[below]
        return np.where(value.is_null().to_numpy(zero_copy_only=False), 0, 2 * below + ((below < len(cuts)) & ((found == x) | np.isnan(found) & np.isnan(x))))

    edges = [np.unique(np.array(c or [], float)) for c in (times, scores)]

    def run(batches):
        for batch in batches:
            piece, chunk = (number(batch.column(c), e) for c, e in zip(("time", "score"), edges))
            order = 2 * piece + np.where(piece % 2, batch.column("late").to_numpy(), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int32()) for x in (piece, chunk, order)]], names=[*batch.schema.names, "_slice", "_chunk", "_order"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in cells.dtypes], "_slice int", "_chunk int", "_order int"])
    return cells.mapInArrow(run, schema)


def _counted(rows: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """Per (by, _part, _block): ``num`` and ``den`` over the pairs of its rows, in numpy over what a task holds.

    Part 0 counts pairs with their ties, part 1 only the scores of pairs, part 2 takes equal scores for pairs that are scored elsewhere.
    """
    keys = [*by, "_part", "_block"]

    def ranks(new: np.ndarray, *sorted_by: np.ndarray) -> np.ndarray:
        """Distinct values numbered inside each group; ``new`` marks its first row."""
        other = reduce(np.logical_or, [(x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])) for x in sorted_by], new[1:])
        up = np.cumsum(np.append(True, other))
        return up - up[np.flatnonzero(new)][np.cumsum(new) - 1]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        group = np.zeros(table.num_rows, np.int64)
        for c in keys:
            code = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
        empty = table.column("score").is_null().to_numpy()
        score = np.where(empty, -np.inf, table.column("score").fill_null(0.0).to_numpy())
        at = np.lexsort((score, ~empty, group))  # null is the least score, NaN the largest
        group, score, kept = group[at], score[at], ~empty[at]
        time, late, case, ctrl = (table.column(c).to_numpy()[at] for c in ("time", "late", "case", "ctrl"))
        new = np.append(True, group[1:] != group[:-1])
        tied = ranks(new, kept.astype(float), score)
        by_time = np.lexsort((late, time, group))
        order = np.empty(len(at), np.int64)
        order[by_time] = ranks(new, time[by_time], late[by_time])
        below, equal, pairs = dominated(group, order, tied, case, ctrl).T
        first = at[new]
        part = table.column("_part").to_numpy()[first]
        found = [pa.array(below + np.where(part == 2, 0.0, equal / 2)), pa.array(np.where(part == 1, 0.0, pairs))]
        yield from pa.table([*[table.column(c).take(pa.array(first)) for c in by], *found], names=[*by, "num", "den"]).combine_chunks().to_batches()

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "num double", "den double"])
    return rows.repartition(tasks, F.xxhash64(*keys)).mapInArrow(run, schema)


def _dominance(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sum over (case i, control j that outlives i) of case weight x (score order), without listing pairs.

    The time axis is cut into slices and the score axis into chunks, at quantiles of all cells; a value that is a cut point lies in
    one of its own. A pair of one slice meets there, a pair of two slices in its common chunk; of two slices and two chunks only
    sums are compared. So a cell is sent to two tasks, each holding one slice or chunk of a group at most, and
    a hot time or score to none whole. ``cells``: (by, time, late, score, case, ctrl).
    """
    number = lambda *cs: [F.col(c).cast("double").alias(c) for c in cs]
    cells = cut_lineage(cells.select(*by, "late", *number("time", "score", "case", "ctrl")).dropna(subset=[*by, "time", "late"]))
    total = cells.count()
    n = min(max(bucket_count(cells), total // CELLS + 1), SLICES)
    cuts = cells.agg(*[F.percentile_approx(c, [i / n for i in range(1, n)]).alias(c) for c in ("time", "score")]).first()
    d = _numbered(cells, by, cuts["time"], cuts["score"])
    hot = F.col("_chunk") % 2 == 1
    row = lambda keep, part, block, time, late, score: F.struct(
        keep.alias("_keep"), F.lit(part).alias("_part"), block.alias("_block"), time.cast("double").alias("time"), late.alias("late"), score.cast("double").alias("score"))
    inside = row(F.col("_slice") % 2 == 0, 0, F.col("_slice"), F.col("time"), F.col("late"), F.col("score"))
    across = row(~hot, 1, F.col("_chunk"), F.col("_order"), F.lit(0), F.col("score"))
    far, tied = row(F.lit(True), 2, F.lit(0), F.col("_order"), F.lit(0), F.col("_chunk")), row(hot, 1, F.col("_chunk"), F.col("_order"), F.lit(0), F.lit(0))
    sums = d.groupBy(*by, "_order", "_chunk").agg(F.sum("case").alias("case"), F.sum("ctrl").alias("ctrl"))
    sent = [x.select(*by, "case", "ctrl", F.explode(F.array(*rows)).alias("_r")).where("_r._keep").select(*by, "_r.*", "case", "ctrl").drop("_keep")
            for x, rows in ((d, (inside, across)), (sums, (far, tied)))]
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, bucket_count(cells) // 2, 3 * total // CELLS)
    return _counted(sent[0].unionByName(sent[1]), by, tasks).groupBy(*by).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def harrell_c(df: DataFrame, by: list[str], within: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Harrell's C; with ``within`` only pairs that share those columns count."""
    groups = [*by, *(within or [])]
    w = _w(weight)
    cells = df.groupBy(*groups, "time", _late().alias("late"), "score").agg(
        F.sum(F.when(F.col("event") == 1, w).otherwise(0)).cast("double").alias("case"), F.sum(w).alias("ctrl"))
    d = _dominance(cells, groups)
    return d.groupBy(*by).agg(F.try_divide(F.sum("num"), F.sum("den")).alias("c_index"), F.sum("den").alias("n_pairs"))


def uno_c(df: DataFrame, by: list[str], strata: list[str], tau: float, weight: str | None = None,
          km: DataFrame | None = None) -> DataFrame:
    """IPCW concordance truncated at tau; a pair is weighted by both members' own G at the earlier time.

    With strata, cases are folded to (time, score) first, whatever their own stratum, then entered once
    per stratum and compared with the controls of that stratum only, so a pair's weight depends on the case alone.
    """
    w = _w(weight)
    km = censoring_km(df, [*by, *strata], weight) if km is None else km
    zs = [f"z_{s}" for s in strata]
    ctrl = df.select(*by, *[F.col(s).alias(z) for s, z in zip(strata, zs)], "time", _late().alias("late"), "score",
                     F.lit(0.0).alias("case"), w.alias("ctrl"))
    own = with_censoring(df.where((F.col("event") == 1) & (F.col("time") < tau)), by, strata, km)
    if strata:
        folded = own.groupBy(*by, "time", "score").agg(F.sum(w * _inverse(F.col("g_left"))).alias("_case"))
        levels = df.select(F.struct(*[F.col(s).alias(z) for s, z in zip(strata, zs)]).alias("z")).distinct().agg(F.collect_list("z").alias("z")).scalar()
        steps = km.where("c > 0").select(*by, *[F.col(s).alias(z) for s, z in zip(strata, zs)], "time", F.col("g").alias("_gz"))
        probes = folded.select(*by, "time").distinct().withColumn("_z", F.explode(levels)).select(*by, "time", "_z.*")
        at = step_lookup(probes, steps, [*by, *zs], "time", "_gz", left_limit=True)
        cases = folded.join(at, [*by, "time"]) if by else folded.join(at, "time")
        value = F.col("_case") * _inverse(F.col("_gz"))
    else:
        cases, value = own, w * _inverse(F.col("g_left")) * _inverse(F.col("g_left"))
    case = cases.select(*by, *zs, "time", F.lit(0).alias("late"), "score", value.alias("case"), F.lit(0).alias("ctrl"))
    cells = ctrl.unionByName(case).groupBy(*by, *zs, "time", "late", "score").agg(
        F.sum("case").alias("case"), F.sum("ctrl").alias("ctrl"))
    return _dominance(cells, [*by, *zs]).groupBy(*by).agg(F.try_divide(F.sum("num"), F.sum("den")).alias("uno_c"))


# ---- inverse-probability-of-censoring metrics -------------------------------------------------

def _ipcw(df: DataFrame, by: list[str], strata: list[str], t: float, weight: str | None, km: DataFrame | None) -> DataFrame:
    """Add ``_died`` and ``_alive`` weights at horizon t; ``km`` is a censoring model already at hand, not read for rows of ``with_horizons``."""
    groups = [*by, *strata]
    if _g_name(t) in df.columns:
        d = df.withColumn("g_t", F.col(_g_name(t)))
    else:
        km = censoring_km(df, groups, weight) if km is None else km
        own, fixed = with_censoring(df, by, strata, km), g_at(km, groups, t)
        d = own.join(fixed, groups) if groups else own.withColumn("g_t", fixed.scalar())
    w = _w(weight)
    return d.withColumns({
        "_died": F.when((F.col("event") == 1) & (F.col("time") <= t), w * _inverse(F.col("g_left"))).otherwise(F.lit(0.0)),
        "_alive": F.when(F.col("time") > t, w * _inverse(F.col("g_t"))).otherwise(F.lit(0.0))})


def cumulative_dynamic_auc(df: DataFrame, by: list[str], strata: list[str], t: float, weight: str | None = None,
                           km: DataFrame | None = None) -> DataFrame:
    """IPCW AUC at t: events by t against subjects still at risk after t, ties one half."""
    d = _ipcw(df, by, strata, t, weight, km)
    cases = d.where((F.col("event") == 1) & (F.col("time") <= t)).select(*by, "score", F.lit(1).alias("_y"), F.col("_died").alias("_v"))
    ctrls = d.where(F.col("time") > t).select(*by, "score", F.lit(0).alias("_y"), F.col("_alive").alias("_v"))
    return discrimination(cases.unionByName(ctrls), by, "_y", "score", F.col("_v")).select(*by, "auc")


def brier(df: DataFrame, by: list[str], strata: list[str], t: float, surv: str, weight: str | None = None,
          km: DataFrame | None = None) -> DataFrame:
    """Graf's IPCW Brier score of the predicted survival ``surv`` at t."""
    d, s = _ipcw(df, by, strata, t, weight, km), F.col(surv)
    return d.groupBy(*by).agg(
        (F.sum(F.col("_died") * s * s + F.col("_alive") * (1 - s) * (1 - s)) / F.sum(_w(weight))).alias("brier"))


def ipcw_risk(df: DataFrame, by: list[str], strata: list[str], t: float, weight: str | None = None,
              km: DataFrame | None = None) -> DataFrame:
    """Observed cumulative risk by t: mean of 1[event by t] / G(time-)."""
    d = _ipcw(df, by, strata, t, weight, km)
    return d.groupBy(*by).agg((F.sum("_died") / F.sum(_w(weight))).alias("risk"))


def brier_curve(df: DataFrame, by: list[str], strata: list[str], grid: list[float], surv: list[Column],
                weight: str | None = None, km: DataFrame | None = None) -> DataFrame:
    """Brier score at every grid time; one scan, the grid is exploded per subject.

    ``surv`` gives the predicted survival at each grid time. G at the grid times comes from one
    aggregate with a column per grid point.
    """
    groups = [*by, *strata]
    if all(_g_name(t) in df.columns for t in grid):
        own = df.withColumn("_gg", F.array(*[F.col(_g_name(t)) for t in grid]))
    else:
        km = censoring_km(df, groups, weight) if km is None else km
        g_grid = km.groupBy(*groups).agg(F.array(*[F.coalesce(F.max_by(
            F.when(F.col("time") <= t, F.col("g")), F.when(F.col("time") <= t, F.col("time"))), F.lit(1.0)) for t in grid]).alias("_gg"))
        own = with_censoring(df, by, strata, km)
        own = own.join(g_grid, groups) if groups else own.withColumn("_gg", g_grid.scalar())
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(t)).alias("t"), s.cast("double").alias("s"))
                                 for i, (t, s) in enumerate(zip(grid, surv))])).alias("_p")
    d = own.select("*", points).withColumns({"t": F.col("_p.t"), "_s": F.col("_p.s"), "_g": F.element_at("_gg", F.col("_p.k") + 1)})
    w = _w(weight)
    died = F.when((F.col("event") == 1) & (F.col("time") <= F.col("t")), w * _inverse(F.col("g_left"))).otherwise(F.lit(0.0))
    alive = F.when(F.col("time") > F.col("t"), w * _inverse(F.col("_g"))).otherwise(F.lit(0.0))
    return d.groupBy(*by, "t").agg((F.sum(died * F.col("_s") * F.col("_s") + alive * (1 - F.col("_s")) * (1 - F.col("_s"))) / F.sum(w)).alias("brier"))


def integrated_brier(curve: DataFrame, by: list[str], value: str = "brier") -> DataFrame:
    """Trapezoid of the Brier curve over the grid divided by its span (a few dozen grid rows per group)."""
    pts = F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("b"))))
    g = curve.groupBy(*by).agg(pts.alias("_p"))
    n = F.size("_p")
    area = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, i: acc + (
        F.element_at("_p", i + 1)["t"] - F.element_at("_p", i)["t"]) * (F.element_at("_p", i + 1)["b"] + F.element_at("_p", i)["b"]) / 2)
    return g.select(*by, (area / (F.element_at("_p", -1)["t"] - F.element_at("_p", 1)["t"])).alias("ibs"))


def aalen_johansen(df: DataFrame, by: list[str], t: float, cause: str = "cause") -> DataFrame:
    """Cumulative incidence of cause 1 by t with cause 2 competing: sum of S(u-) d1(u) / n(u)."""
    any_event = df.withColumn("event", (F.col(cause) > 0).cast("int"))
    km = survival_km(any_event, by).select(*by, "time", "left", "at_risk")
    d1 = df.where(F.col(cause) == 1).groupBy(*by, "time").agg(F.count("*").alias("d1"))
    x = km.join(d1, [*by, "time"], "left").where(F.col("time") <= t)
    return x.groupBy(*by).agg(F.sum(F.col("left") * F.coalesce("d1", F.lit(0)) / F.col("at_risk")).alias("cif"))


def quantile_groups(df: DataFrame, by: list[str], value: str, k: int = 5) -> DataFrame:
    """Right-closed quantile groups 1..k with the smallest value included; equal edges collapse."""
    from nightjar.operators.running import grouped_quantiles

    edges = grouped_quantiles(df, by, value, {f"e{i}": i / k for i in range(k + 1)})
    arr = F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(k + 1)]))
    cuts = edges.select(*by, F.slice(arr, 2, F.size(arr) - 2).alias("_cuts"))
    d = df.join(cuts, by) if by else df.withColumn("_cuts", cuts.scalar())
    return d.withColumn("quantile", F.size(F.filter("_cuts", lambda e: e < F.col(value))) + 1).drop("_cuts")


def calibration_quintiles(df: DataFrame, strata: list[str], t: float, k: int = 5) -> DataFrame:
    """Per risk quintile: size, events, predicted, IPCW, KM with interval and Aalen-Johansen risk.

    IPCW weights come from the whole sample; ``cause`` is 1 for the event, 2 for a competing death. The rows and the rows with
    their weights are each written once: six aggregates read them.
    """
    df = cut_lineage(df.select(*strata, "time", "event", "cause", "score"))
    weighted = cut_lineage(_ipcw(df, [], strata, t, None, None).select("time", "event", "cause", "score", "_died"))
    d = quantile_groups(weighted, [], "score", k)
    base = d.groupBy("quantile").agg(
        F.count("*").alias("n"), F.sum(F.col("event").cast("bigint")).alias("events"), F.avg("score").alias("pred"),
        F.avg("_died").alias("obs_ipcw"))
    km = km_risk(d, ["quantile"], t).select("quantile", F.col("risk").alias("obs_km"), F.col("risk_low").alias("obs_km_low"),
                                            F.col("risk_high").alias("obs_km_high"))
    aj = aalen_johansen(d, ["quantile"], t).select("quantile", F.col("cif").alias("obs_aj"))
    return base.join(km, "quantile", "left").join(aj, "quantile", "left").withColumnRenamed("quantile", "quintile")


def calibration_by_stratum(df: DataFrame, strata: list[str], t: float) -> DataFrame:
    """Per stratum: size, mean predicted and observed (KM) risk and their ratio."""
    base = df.groupBy(*strata).agg(F.count("*").alias("n"), F.avg("score").alias("pred"))
    obs = km_risk(df, strata, t).select(*strata, F.col("risk").alias("obs_km"))
    return base.join(obs, strata).withColumn("oe", F.when(F.col("pred") > 0, F.col("obs_km") / F.col("pred")))


def calibration_overall(df: DataFrame, strata: list[str], t: float) -> DataFrame:
    """Calibration in the large at t: size, mean predicted risk, IPCW and pooled KM risk and their ratios to it."""
    d = _ipcw(df, [], strata, t, None, None)
    base = d.agg(F.count("*").alias("n"), F.avg("score").alias("pred"), F.avg("_died").alias("obs_ipcw"))
    d = base.withColumn("obs_km", km_risk(df, [], t).select("risk").scalar())
    ratio = lambda c: F.when(F.col("pred") > 0, F.col(c) / F.col("pred"))
    return d.withColumns({"oe_ipcw": ratio("obs_ipcw"), "oe_km": ratio("obs_km")})


def metric_row(df: DataFrame, by: list[str], strata: list[str], h5: float, h10: float, surv5: str, surv10: str,
               null10: str, grid: list[float], surv_grid: list[Column], weight: str | None = None) -> DataFrame:
    """The eight test metrics of one model per ``by``; the censoring model is fitted once for all of them and meets the rows once."""
    km = cut_lineage(censoring_km(df, [*by, *strata], weight))
    own = with_horizons(df, by, strata, [h5, h10, *grid], km)
    parts = [
        harrell_c(df, by, None, weight).select(*by, F.col("c_index").alias("harrell_c")),
        harrell_c(df, by, strata, weight).select(*by, F.col("c_index").alias("within_cohort_c")),
        uno_c(own, by, strata, h10, weight, km).withColumnRenamed("uno_c", "uno_c_10y"),
        cumulative_dynamic_auc(own, by, strata, h5, weight, km).withColumnRenamed("auc", "auc_5y"),
        cumulative_dynamic_auc(own, by, strata, h10, weight, km).withColumnRenamed("auc", "auc_10y"),
        brier(own, by, strata, h10, surv10, weight, km).withColumnRenamed("brier", "brier_10y"),
        brier(own, by, strata, h10, null10, weight, km).withColumnRenamed("brier", "_null"),
        integrated_brier(brier_curve(own, by, strata, grid, surv_grid, weight, km), by).withColumnRenamed("ibs", "ibs_1_10y"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.withColumn(p.columns[0], p.scalar())
    return out.withColumn("scaled_brier_10y", 1 - F.try_divide("brier_10y", "_null")).drop("_null")
