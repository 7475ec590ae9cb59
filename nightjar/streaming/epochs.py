"""The causal epoch aggregate on a live sample stream.

The batch analytics need no stream. Thirty-second epoch statistics look at no later sample, so the
same aggregate runs under Structured Streaming: a tumbling window with a watermark for late samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_stats(samples: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """(subject_id, ts, value) -> mean, min, max and population std per subject and 30 s window."""
    return (
        samples.withWatermark("ts", watermark)
        .groupBy("subject_id", F.window("ts", "30 seconds").alias("w"))
        .agg(F.avg("value").alias("spo2_mean"), F.min("value").alias("spo2_min"), F.max("value").alias("spo2_max"),
             F.stddev_pop("value").alias("spo2_std"))
        .select("subject_id", F.col("w.start").alias("epoch_start"), "spo2_mean", "spo2_min", "spo2_max", "spo2_std")
    )
