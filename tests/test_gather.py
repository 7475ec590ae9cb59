"""Windows meet their seconds by position, whatever order, gaps or plan."""

import numpy as np
from pyspark.sql import functions as F

from nightjar.operators import windows as W


def test_gather_finds_every_second_without_broadcasting_them(spark, tmp_path):
    r = np.random.default_rng(3)
    held = {(s, int(t)): (float(r.normal()), int(r.integers(2)), int(r.integers(2))) for s in (1, 2) for t in r.permutation(960) if s == 1 or r.random() < 0.8}
    seconds = spark.createDataFrame([(s, t, *v) for (s, t), v in held.items()], "subject_id bigint, sec int, x double, target int, asleep int")
    nights = spark.createDataFrame([(1, 32), (2, 31), (3, 4)], "subject_id bigint, n_epochs int")
    wins = [(s, j, j * 180 - 60 + 7 * s) for s in (1, 2, 3) for j in range(6)]
    got = W.gather(spark.createDataFrame(wins, "subject_id bigint, j int, start_sec int"), seconds, nights, ["x"])
    size = {1: 960, 2: 930, 3: 120}
    rows = got.collect()
    assert sorted((r.subject_id, r.j, r.start_sec) for r in rows) == wins
    for row in rows:
        at = [row.start_sec + k for k in range(300)]
        cell = [held.get((row.subject_id, t), (None, 0, 0)) for t in at]
        valid = [0 <= t < size[row.subject_id] for t in at]
        assert row.x == [c[0] for c in cell] and row.y == [c[1] for c in cell] and row.valid == valid
        assert row.mask == [v and c[2] == 1 for v, c in zip(valid, cell)]
    seconds.select("subject_id", F.floor(F.col("sec") / 30).alias("e"), "x", "target", "asleep").write.parquet(str(tmp_path / "few"))
    many = spark.read.parquet(str(tmp_path / "few")).select("*", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("s")).withColumn("sec", (F.col("e") * 30 + F.col("s")).cast("int"))
    plan = W.gather(spark.createDataFrame(wins, "subject_id bigint, j int, start_sec int"), many, nights, ["x"])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("sec#" in line or "_b#" in line)]
    assert joins and not any("Broadcast" in line for line in joins)


def test_keys_that_cost_more_than_their_bytes_are_dealt_to_all_tasks(spark):
    """Neither few bytes nor an equal shuffle before it may merge the tasks that write a file per key."""
    from nightjar.operators.running import dealt

    d = dealt(spark.range(4000).withColumn("key", F.col("id") % 400).groupBy("key").agg(F.count("*").alias("n")), "key")
    parts = d.select("key", F.spark_partition_id().alias("p"))
    assert parts.agg(F.countDistinct("p")).first()[0] == 8 and parts.count() == 400
