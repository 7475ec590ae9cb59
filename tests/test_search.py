import numpy as np
import pandas as pd

from nightjar.operators import fitting as FT
from nightjar.operators.splits import group_kfold


def test_halving_finds_the_winner_of_the_full_search(spark):
    """Trees of growing depth on a step pattern: only the deep ones see it, on every fold."""
    rng = np.random.default_rng(6)
    x, z = rng.random(900), rng.random(900)
    y = ((x * 4).astype(int) % 2 ^ (rng.random(900) < 0.05)).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"subject_id": np.arange(900) // 10, "epoch_idx": np.arange(900) % 10, "apnoea_label": y, "x": x, "z": z}))
    grid = [{"max_depth": 1, "trees": 3}, {"max_depth": 4, "trees": 10}, {"max_depth": 2, "trees": 1}]
    folds = group_kfold(d, 3)
    full = FT.search(d, folds, 3, ["x", "z"], grid, "forest").first()
    got = FT.halving_search(d, folds, 3, ["x", "z"], grid, "forest").orderBy("rank").collect()
    assert got[0].trial == full.trial == 1 and got[0].n_folds == 3 and abs(got[0].mean_auc - full.mean_auc) < 1e-12
    assert sorted(r.trial for r in got) == [0, 1, 2] and sorted(r.n_folds for r in got) == [1, 2, 3]
    assert FT.halving_search(d, folds, 3, ["x", "z"], [], "forest").count() == 0


def test_medians_are_found_once_for_all_options_and_folds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=300)
    d = spark.createDataFrame(pd.DataFrame({"subject_id": np.arange(300) // 10, "epoch_idx": np.arange(300) % 10, "apnoea_label": (x + rng.normal(size=300) > 0).astype(int),
                                            "x": np.where(np.arange(300) % 9 == 0, np.nan, x), "z": np.round(x, 1)}))
    folds, calls, found = group_kfold(d, 3), [], FT.exact_medians
    monkeypatch.setattr(FT, "exact_medians", lambda rows, columns: calls.append(len(columns)) or found(rows, columns))
    FT.search(d, folds, 3, ["x", "z"], [{"reg": 0.0}, {"reg": 0.1}])
    FT.halving_search(d, folds, 3, ["x", "z"], [{"reg": 0.0}, {"reg": 0.1}])
    assert calls == [6, 6]
    own = FT.fold_rows(d, folds)
    together, key = FT.fold_scalers(own, [0, 2], ["x", "z"]), ["subject_id", "epoch_idx"]
    for i in (0, 2):
        apart = FT.MedianFillScale(["x", "z"]).fit(own.where(f"fold <> {i}"))
        got, want = (m.transform(own).orderBy(*key).toPandas()[["x_scaled", "z_scaled"]].to_numpy() for m in (together[i], apart))
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_rows_of_a_search_lie_in_one_order(spark):
    d = spark.createDataFrame([(i // 4, i % 4, i % 2, float(i * 7 % 50)) for i in range(200)], "subject_id int, epoch_idx int, apnoea_label int, x double")
    folds = group_kfold(d, 3)
    one, other = (FT.fold_rows(rows, folds).rdd.glom().collect() for rows in (d.repartition(3), d.orderBy("x").repartition(11)))
    assert one == other
