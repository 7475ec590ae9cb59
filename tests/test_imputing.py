import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.operators import imputing as I


def nulled(spark, pdf, columns):
    return spark.createDataFrame(pdf).withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def dense_chained(train, rows, columns, strata, rounds, reg):
    """The same chain with stratum indicators as ordinary columns of one dense matrix."""
    counts = train[strata].value_counts()
    base = sorted(counts.index[counts == counts.max()])[0]
    levels = [s for s in sorted(counts.index) if s != base]
    mean, sd = train[columns].mean(), train[columns].std(ddof=0)

    def matrix(d):
        z = ((d[columns] - mean) / sd).fillna(0.0).to_numpy()
        return np.column_stack([z, *[(d[strata] == s).to_numpy(float) for s in levels]]), d[columns].isna().to_numpy()

    (a, ga), (b, gb) = matrix(train), matrix(rows)
    for _ in range(rounds):
        for c in range(len(columns)):
            known = a[~ga[:, c]]
            others = [j for j in range(a.shape[1]) if j != c]
            x, y = known[:, others], known[:, c]
            cx, cy = x - x.mean(axis=0), y - y.mean()
            w = np.linalg.solve(cx.T @ cx + len(y) * np.diag(reg * x.var(axis=0) + 1e-12), cx.T @ cy)
            const = y.mean() - x.mean(axis=0) @ w
            for m, g in ((a, ga), (b, gb)):
                m[g[:, c], c] = m[g[:, c]][:, others] @ w + const
    return b[:, :len(columns)] * sd.to_numpy() + mean.to_numpy()


def sample(n, n_strata, seed=3):
    rng = np.random.default_rng(seed)
    s = np.where(rng.random(n) < 0.33, 0, rng.integers(0, n_strata, n))
    effect = rng.normal(size=n_strata)
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "s": [f"s{i:05d}" for i in s], "a": a, "b": 1e4 + 30 * a + 20 * effect[s] + rng.normal(size=n),
                        "c": a - effect[s] + 0.3 * rng.normal(size=n)})
    for c, share in (("a", 0.1), ("b", 0.3), ("c", 0.2)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    return pdf


def test_chain_equals_the_dense_one(spark):
    pdf = sample(600, 9)
    pdf.loc[590:, "s"] = "unseen"
    train = pdf[pdf.id < 450]
    d = nulled(spark, pdf, ["a", "b", "c"])
    fit = I.fit_chained(d.where("id < 450"), ["a", "b", "c"], [], "s", rounds=3, reg=1e-2)
    got = fit.fill(d).toPandas().sort_values("id")
    want = dense_chained(train, pdf, ["a", "b", "c"], "s", 3, 1e-2)
    assert list(got.columns) == list(pdf.columns) and len(got) == len(pdf)
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want, rtol=1e-7, atol=1e-7)


def test_ten_thousand_strata_return_one_block_a_step(spark):
    pdf = sample(40_000, 10_000)
    d = nulled(spark, pdf, ["a", "b", "c"])
    fit = I.fit_chained(d, ["a", "b", "c"], [], "s", rounds=2)
    assert all(len(w) == 4 for _, w in fit.steps) and fit.levels.count() > 9_000
    out = fit.fill(d).toPandas().set_index("id").sort_index()
    assert len(out) == len(pdf) and not out.isna().any().any()
    known = pdf.set_index("id")["b"].dropna()
    np.testing.assert_array_equal(out.loc[known.index, "b"], known)


def test_chain_edges(spark):
    schema = "id int, s string, a double, b double, k double, none double"
    rows = [(i, None if i % 5 == 0 else "x", float(i), 2.0 * i if i % 3 else None, float(i % 2) if i % 4 else None, None) for i in range(40)]
    d = spark.createDataFrame(rows, schema)
    out = I.chained_impute(d, d, ["a", "b", "k", "none"], ["k"], "s").toPandas().sort_values("id")
    assert out["none"].isna().all() and set(out["k"]) <= {0.0, 1.0} and not out[["a", "b"]].isna().any().any()
    np.testing.assert_allclose(out["b"], 2.0 * out["id"], atol=0.1)
    plain = I.chained_impute(d, d, ["a", "b"], []).toPandas().sort_values("id")
    np.testing.assert_allclose(plain["b"], 2.0 * plain["id"], atol=0.1)
    assert I.fit_chained(d, ["a", "b"], [], "s", rounds=1).fill(d.where("id < 0")).count() == 0
    assert I.chained_impute(d.where("id < 0"), d.where("id < 0"), ["a", "b"], [], "s").count() == 0


def test_preparation_scales_and_derives_from_filled_values(spark):
    d = nulled(spark, sample(500, 4), ["a", "b", "c"])
    fit = I.fit_preparation(d.where("id < 300"), ["a", "b", "c"], [], "s", {"twice": 2 * F.col("b")}, rounds=2)
    got = fit.transform(d).where("id < 300").toPandas()
    np.testing.assert_allclose(got[["a", "b", "c"]].mean(), 0, atol=1e-9)
    np.testing.assert_allclose(got[["a", "b", "c"]].std(ddof=0), 1, atol=1e-9)
    m, s = fit.scale["b"]
    np.testing.assert_allclose(got["twice"], 2 * (got["b"] * s + m), rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_medians(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"x": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n), "ties": np.where(rng.random(n) < 0.6, -0.0, rng.integers(-3, 3, n)),
                        "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "empty": np.full(n, np.nan)})
    d = spark.createDataFrame(pdf).repartition(5)
    got = I.exact_medians(d, list(pdf.columns))
    for c in pdf.columns:
        want = pdf[c].median()
        assert got[c] is None if np.isnan(want) else got[c] == want
    assert I.exact_medians(d.where("false"), ["x"]) == {"x": None}


def test_numeric_stage(spark):
    from nightjar.operators.fitting import MedianFillScale

    d = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 5.0), (3, 4.0, 5.0), (4, float("nan"), None)], "id int, x double, one double")
    got = [r.x_scaled for r in MedianFillScale(["x", "one"]).fit(d).transform(d).orderBy("id").collect()]
    filled = np.array([1.0, 2.5, 4.0, 2.5])
    np.testing.assert_allclose(got, (filled - filled.mean()) / filled.std())
