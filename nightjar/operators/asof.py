"""As-of lookup of step functions without ordering a whole stratum in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.operators.running import quantile_bucket
from nightjar.session import cut_lineage


def step_lookup(probes: DataFrame, steps: DataFrame, by: list[str], time: str, value: str,
                left_limit: bool = False, before_first: float = 1.0) -> DataFrame:
    """Value of a right-continuous step function at each probe, or its left limit.

    Distinct probe times and steps are sorted together per (by, time bucket); a probe before the first
    step of its bucket takes the last step of the earlier buckets, at most one row per (by, bucket).
    On equal times a probe sees the step unless ``left_limit``. The values go back to the probes by
    an equi join.
    """
    rank_probe = 0 if left_limit else 1
    kind = probes.schema[time].dataType
    p = probes.select(*by, time).distinct().withColumns(
        {"_v": F.lit(None).cast("double"), "_r": F.lit(rank_probe), "_probe": F.lit(True)})
    s = steps.select(*by, F.col(time).cast(kind).alias(time), F.col(value).cast("double").alias("_v"),
                     F.lit(1 - rank_probe).alias("_r"), F.lit(False).alias("_probe"))
    u = quantile_bucket(cut_lineage(p.unionByName(s)), time, "_bucket")
    w = Window.partitionBy(*by, "_bucket").orderBy(time, "_r").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = u.groupBy(*by, "_bucket").agg(
        F.max_by(F.when(~F.col("_probe"), F.col("_v")), F.when(~F.col("_probe"), F.col(time))).alias("_last")).select(
        *by, "_bucket", F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    found = (
        u.withColumn("_here", F.last("_v", ignorenulls=True).over(w))
        .join(carry, [*by, "_bucket"]).where("_probe")
        .select(*by, time, F.coalesce("_here", "_carry", F.lit(float(before_first))).alias(value))
    )
    return probes.join(found, [*by, time]).select(*probes.columns, value)
