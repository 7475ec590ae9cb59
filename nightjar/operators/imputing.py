"""Imputation: exact medians of many columns at once, and chained regressions with stratum effects."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.operators.running import bucket_count
from nightjar.session import cut_lineage

DIGIT = 16  # bits a pass of the median search settles
HELD = 4096  # cells a task folds before it lets them go
BLOCK_BYTES = 32 << 20  # cells that one task refills at a time


# ---- exact medians -----------------------------------------------------------------------------

def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one value."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _from_bits(key: int) -> float:
    bits = np.array([key ^ (1 << 63)], np.uint64).view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Median of every column, the mean of the middle two where their number is even; NULL and NaN take no part.

    The values' bits are settled sixteen at a time: a pass counts, for all columns together, the next digit of the values
    that share the digits found so far. Tasks hold 2 x 65,536 counters a column, whatever the number of rows. A column
    without values gives None.
    """
    d = cut_lineage(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]))
    sizes = d.agg(*[F.count(c) for c in d.columns]).first()
    open_at = {(i, side): (0, (n - 1 + side) // 2) for i, n in enumerate(sizes) if n for side in (0, 1)}
    for shift in range(64 - DIGIT, -1, -DIGIT):

        def count(batches, shift=shift, open_at=open_at):
            seen = {}
            for batch in batches:
                for i in {i for i, _ in open_at}:
                    key = _ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                    for side in (0, 1):
                        same = key if shift + DIGIT == 64 else key[key >> np.uint64(shift + DIGIT) == np.uint64(open_at[i, side][0])]
                        digit = ((same >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                        seen[i, side] = seen.get((i, side), 0) + np.bincount(digit, minlength=1 << DIGIT)
            for (i, side), n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(at), i), pa.int32()), "side": pa.array(np.full(len(at), side), pa.int32()),
                                                  "digit": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

        counts = d.mapInArrow(count, "i int, side int, digit bigint, n bigint").groupBy("i", "side", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i", "side").orderBy("digit"))
        ranks = F.create_map(*[F.lit(x) for (i, side), (_, rank) in open_at.items() for x in (f"{i},{side}", rank)]) if open_at else F.lit(None)
        own = counts.select("*", upto.alias("upto"), ranks[F.concat_ws(",", "i", "side")].alias("rank")) if open_at else None
        found = own.where("upto > rank AND upto - n <= rank").collect() if open_at else []
        open_at = {(r.i, r.side): (open_at[r.i, r.side][0] << DIGIT | r.digit, r.rank - (r.upto - r.n)) for r in found}
    value = {at: _from_bits(key) for at, (key, _) in open_at.items()}
    return {c: (value[i, 0] + value[i, 1]) / 2 if (i, 0) in value else None for i, c in enumerate(columns)}


# ---- chained regressions ------------------------------------------------------------------------

@dataclass
class ChainedImputer:
    """Linear forms found on training rows, one per step, in standardised units.

    ``steps`` are (column, weights over the columns and 1); ``levels`` holds every stratum's addition to each step
    (stratum, effects), one row a stratum, or is None. The base stratum, an unseen and a NULL one add nothing.
    """

    columns: list[str]
    binary: list[str]
    strata: str | None
    means: list[float]
    sds: list[float]
    steps: list[tuple[int, np.ndarray]]
    levels: DataFrame | None

    def fill(self, rows: DataFrame) -> DataFrame:
        """``rows`` with gaps filled; known values stay as they are, binary columns become 0 or 1 (half to even).

        A column without any known training value keeps its gaps. Strata meet their effects salted by the rows'
        partition, so a stratum with most of the rows is spread.
        """
        steps, k = self.steps, len(self.columns)
        x = F.array(*_standardised(self.columns, self.means, self.sds))
        gaps = F.array(*[F.col(c).isNull() for c in self.columns])
        own = rows
        if self.levels is not None:
            salts = 16
            spread = self.levels.select(F.col("stratum").alias("_stratum"), "effects", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
            own = rows.withColumns({"_stratum": F.col(self.strata).cast("string"), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
            own = own.join(spread, ["_stratum", "_salt"], "left").drop("_stratum", "_salt").withColumnRenamed("effects", "_effects")
        else:
            own = rows.withColumn("_effects", F.lit(None).cast("array<double>"))
        none = F.array_repeat(F.lit(0.0), len(steps))

        @F.arrow_udf("array<double>")
        def refill(x: pa.Array, gaps: pa.Array, effects: pa.Array) -> pa.Array:
            n = len(x)
            full = np.concatenate([pc.list_flatten(x).to_numpy(zero_copy_only=False).reshape(n, k), np.ones((n, 1))], axis=1)
            gap = pc.list_flatten(gaps).to_numpy(zero_copy_only=False).reshape(n, k)
            extra = pc.list_flatten(effects).to_numpy(zero_copy_only=False).reshape(n, len(steps))
            for i, (c, weights) in enumerate(steps):
                full[gap[:, c], c] = full[gap[:, c]] @ weights + extra[gap[:, c], i]
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(full[:, :k].ravel()))

        own = own.withColumn("_y", refill(x, gaps, F.coalesce("_effects", none)))
        fitted = {c for c, _ in steps}
        out = {}
        for i, c in enumerate(self.columns):
            y = F.coalesce(F.col(c).cast("double"), F.col("_y")[i] * self.sds[i] + self.means[i] if i in fitted or self.sds[i] else F.lit(None))
            out[c] = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))) if c in self.binary else y
        return own.withColumns(out).drop("_y", "_effects")


def _standardised(columns: list[str], means: list[float], sds: list[float]) -> list[Column]:
    return [F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s or 1.0), F.lit(0.0)) for c, m, s in zip(columns, means, sds)]


def _cells(d: DataFrame, k: int) -> DataFrame:
    """(stratum, pattern, block): the cross products of all rows of a stratum that miss the same columns."""
    width = k + 1

    def fold(batches):
        held: dict = {}

        def out():
            keys = list(held)
            flat = np.concatenate([held[x].ravel() for x in keys])
            place = np.tile(np.arange(width * width, dtype=np.int32), len(keys))
            repeat = np.repeat(np.arange(len(keys)), width * width)
            return pa.RecordBatch.from_pydict({"stratum": pa.array([x[0] for x in keys], pa.string()).take(pa.array(repeat)),
                                               "pattern": pa.array([x[1] for x in keys], pa.string()).take(pa.array(repeat)),
                                               "place": pa.array(place), "v": pa.array(flat)})

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            full = np.concatenate([pc.list_flatten(batch.column("_x")).to_numpy(zero_copy_only=False).reshape(n, k), np.ones((n, 1))], axis=1)
            keys = np.array([f"{p}{'' if s is None else '=' + s}" for s, p in zip(batch.column("_stratum").to_pylist(), batch.column("_pattern").to_pylist())], object)
            names, code = np.unique(keys, return_inverse=True)
            order = np.argsort(code, kind="stable")
            for name, own in zip(names, np.split(full[order], np.flatnonzero(np.diff(code[order])) + 1)):
                key = (name[k + 1:] if len(name) > k else None, name[:k])
                held[key] = held.get(key, 0.0) + own.T @ own
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    long = d.mapInArrow(fold, "stratum string, pattern string, place int, v double")
    sums = long.groupBy("stratum", "pattern", "place").agg(F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "v")))
    return sums.groupBy("stratum", "pattern").agg(F.transform(ordered, lambda p: p["v"]).alias("block"))


class _Bucket:
    """Some strata's cells as arrays, refilled step by step."""

    def __init__(self, table: pa.Table, k: int, sizes: list[int], reg: float):
        n = table.num_rows
        self.sizes, self.reg = sizes, reg
        self.block = pc.list_flatten(table.column("block").combine_chunks()).to_numpy(zero_copy_only=False).reshape(n, k + 1, k + 1).copy()
        self.gap = np.array([[x == "1" for x in p] for p in table.column("pattern").to_pylist()], bool).reshape(n, k)
        base = table.column("base").to_numpy()
        names = [None if b else s for b, s in zip(base, table.column("stratum").to_pylist())]
        number = {s: i for i, s in enumerate(dict.fromkeys(s for s in names if s is not None))}
        self.level = np.array([number[s] if s is not None else -1 for s in names], int)
        self.n_levels = len(number)

    def _level_sums(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Per stratum the sums over rows that know column ``c``, and 1 / (their number + ridge)."""
        sums = np.zeros((self.n_levels, self.block.shape[1]))
        use = (self.level >= 0) & ~self.gap[:, c]
        np.add.at(sums, self.level[use], self.block[use, -1])
        n, total = sums[:, -1], self.sizes[c]
        ridge = self.reg * n * (1 - n / total) + 1e-12 * total
        return sums, np.where((n > 0) & (n < total), 1 / np.where(n > 0, n + ridge, 1.0), 0.0)  # all rows in one stratum: the constant's

    def equations(self, c: int) -> np.ndarray:
        """Cross products of the rows that know ``c``: whole, and with the strata's effects eliminated."""
        whole = self.block[~self.gap[:, c]].sum(axis=0)
        sums, inverse = self._level_sums(c)
        return np.stack([whole, whole - (sums * inverse[:, None]).T @ sums])

    def step(self, c: int, weights: np.ndarray) -> np.ndarray:
        """Refill column ``c``; returns the effect of every cell's stratum."""
        sums, inverse = self._level_sums(c)
        effects = np.append((sums[:, c] - sums @ weights) * inverse, 0.0)[self.level]
        at = np.flatnonzero(self.gap[:, c])
        change = np.tile(np.eye(len(weights)), (len(at), 1, 1))
        change[:, c] = weights
        change[:, c, -1] += effects[at]
        self.block[at] = change @ self.block[at] @ change.transpose(0, 2, 1)
        return effects


def fit_chained(train: DataFrame, columns: list[str], binary: list[str], strata: str | None = None, rounds: int = 10,
                reg: float = 1e-3, gappy: list[str] | None = None) -> ChainedImputer:
    """Fit each of ``gappy`` (default: all columns) in turn by ridge regression on the others and stratum effects.

    Gaps start at the training mean; a round refits every column on the current fill. The ridge acts on standardised
    columns and stratum indicators alike. Rows are read twice, for moments and for cells: one cell per stratum and set of missing
    columns holds the cross products of its rows, and since a fill is linear, refilling a column changes a cell by
    a matrix product. The normal equations are bordered block-diagonal: each stratum's effect is eliminated where its cells
    lie, so a step returns one (columns + 1)^2 block and the effects never leave their buckets. Cells are written once a
    round. The commonest stratum (of equals the first by name) is the base with effect 0, as are NULL ones.
    """
    k = len(columns)
    moments = train.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop, F.count)]).first()
    means = [float(moments[3 * i] or 0.0) for i in range(k)]
    sds = [float(moments[3 * i + 1] or 0.0) or (1.0 if moments[3 * i + 2] else 0.0) for i in range(k)]
    sizes = [int(moments[3 * i + 2]) for i in range(k)]
    todo = [i for i, c in enumerate(columns) if (gappy is None or c in gappy) and sizes[i]]
    named = F.col(strata).cast("string") if strata else F.lit(None).cast("string")
    rows = train.select(named.alias("_stratum"), F.array(*_standardised(columns, means, sds)).alias("_x"),
                        F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]).alias("_pattern"))
    cells = cut_lineage(_cells(rows, k))
    top = cells.where("stratum IS NOT NULL").groupBy("stratum").agg(F.sum(F.element_at("block", -1)).alias("n")).orderBy(F.desc("n"), "stratum").first()
    buckets = max(bucket_count(train), -(-cells.count() * (k + 1) ** 2 * 8 // BLOCK_BYTES))
    base = F.col("stratum").isNull() | (F.col("stratum") == F.lit(top.stratum if top else ""))
    apart = F.when(base, F.xxhash64("pattern")).otherwise(F.xxhash64("stratum"))  # cells of the base need not meet
    state = cut_lineage(cells.select(F.pmod(apart, F.lit(buckets)).cast("int").alias("bucket"), "stratum", base.alias("base"), "pattern", "block",
                                     F.array().cast("array<double>").alias("effects")))
    steps: list[tuple[int, np.ndarray]] = []

    def equations(c: int, done: list[tuple[int, np.ndarray]]) -> np.ndarray:
        def run(t: pa.Table) -> pa.Table:
            own = _Bucket(t, k, sizes, reg)
            for step in done:
                own.step(*step)
            flat = own.equations(c).ravel()
            return pa.table({"place": pa.array(np.arange(len(flat)), pa.int32()), "v": pa.array(flat)})

        found = state.groupBy("bucket").applyInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(2 * (k + 1) ** 2)
        out[[r.place for r in found]] = [r.v for r in found]
        return out.reshape(2, k + 1, k + 1)

    def advance(done: list[tuple[int, np.ndarray]]) -> DataFrame:
        schema = state.schema

        def run(t: pa.Table) -> pa.Table:
            own = _Bucket(t, k, sizes, reg)
            new = np.stack([own.step(*step) for step in done], axis=1)
            effects = [[*old, *add] for old, add in zip(t.column("effects").to_pylist(), new.tolist())]
            return pa.table({"bucket": t.column("bucket"), "stratum": t.column("stratum"), "base": t.column("base"), "pattern": t.column("pattern"),
                             "block": pa.array(list(own.block.reshape(len(t), -1)), pa.list_(pa.float64())),
                             "effects": pa.array(effects, pa.list_(pa.float64()))})

        return cut_lineage(state.groupBy("bucket").applyInArrow(run, schema))

    for _ in range(rounds if todo else 0):
        done: list[tuple[int, np.ndarray]] = []
        for c in todo:
            whole, left = equations(c, done)
            n = whole[-1, -1]
            others = [j for j in range(k + 1) if j != c]
            spread = np.diag(whole) / n - (whole[-1] / n) ** 2
            ridge = np.append((n * (reg * spread + 1e-12))[others[:-1]], 0.0)
            weights = np.zeros(k + 1)
            weights[others] = np.linalg.solve(left[np.ix_(others, others)] + np.diag(ridge), left[others, c])
            done.append((c, weights))
        state = advance(done)
        steps += done
    levels = state.where("NOT base").groupBy("stratum").agg(F.any_value("effects").alias("effects")) if strata else None
    return ChainedImputer(columns, binary, strata, means, sds, steps, levels)


def chained_impute(train: DataFrame, rows: DataFrame, columns: list[str], binary: list[str], strata: str | None = None,
                   rounds: int = 10, reg: float = 1e-3) -> DataFrame:
    """``rows`` filled by the chained regressions of ``train``; columns without a gap in either are not refitted."""
    gaps = train.select(*columns).unionByName(rows.select(*columns)).agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return fit_chained(train, columns, binary, strata, rounds, reg, [c for c in columns if gaps[c]]).fill(rows)


@dataclass
class Preparation:
    """Training-only imputation and scaling, then derived terms: what a ladder of survival models reads."""

    imputer: ChainedImputer
    scale: dict[str, tuple[float, float]]
    derived: dict[str, Column]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Gaps filled; derived terms from the filled, unscaled columns; continuous columns standardised."""
        scaled = {c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self.scale.items()}
        return self.imputer.fill(rows).withColumns({**scaled, **self.derived})


def fit_preparation(train: DataFrame, columns: list[str], binary: list[str], strata: str | None = None,
                    derived: dict[str, Column] | None = None, rounds: int = 10, reg: float = 1e-3) -> Preparation:
    """Fit the imputer, then mean and population SD of the filled continuous columns, on ``train`` alone."""
    imputer = fit_chained(train, columns, binary, strata, rounds, reg)
    plain = [c for c in columns if c not in binary]
    s = imputer.fill(train).agg(*[f(c) for c in plain for f in (F.avg, F.stddev_pop)]).first()
    return Preparation(imputer, {c: (float(s[2 * i] or 0.0), float(s[2 * i + 1] or 0.0)) for i, c in enumerate(plain)}, derived or {})
