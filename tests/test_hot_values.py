import numpy as np
import pandas as pd

from nightjar.operators import metrics as M
from nightjar.operators import running as R


def hot_frame(spark, n=6000, seed=2):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n).round(3))
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "id": np.arange(n), "x": x, "y": np.where(rng.random(n) < 0.3, 1.0, (x + rng.normal(size=n)).round(2))})
    return spark.createDataFrame(pdf), pdf


def test_join_by_value_equals_the_plain_join(spark):
    d, _ = hot_frame(spark)
    facts = R.midranks(d, ["g"], "x", "r").select("g", "x", "r", "n")
    got = R.join_by_value(d, facts, ["g", "x"], "n").select("g", "id", "x", "y", "r").toPandas().sort_values("id").reset_index(drop=True)
    want = d.join(facts, ["g", "x"]).select("g", "id", "x", "y", "r").toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    assert R.join_by_value(d.where("false"), facts.where("false"), ["g", "x"], "n").count() == 0


def test_hot_values_are_few_and_broadcast(spark):
    """Keys above the share are fewer than a thousand, and the plan sends them to the rows."""
    d, pdf = hot_frame(spark)
    facts = R.midranks(d, [], "x", "r").select("x", "r", "n")
    hot = pdf.x.value_counts()
    hot = hot[hot * R.HOT_KEYS > len(pdf)]
    assert 0.0 in hot.index and len(hot) < R.HOT_KEYS
    plan = R.join_by_value(d, facts, ["x"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_agreement_with_hot_values(spark):
    d, pdf = hot_frame(spark)
    got = {r.g: r for r in M.agreement(d, ["g"], "x", "y").collect()}
    for g, own in pdf.groupby("g"):
        assert got[g].n == len(own)
        assert abs(got[g].spearman_rho - own.x.rank().corr(own.y.rank())) < 1e-12
